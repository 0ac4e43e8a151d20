"""Training-data operators: decontamination, deduplication, archives, scoring, mixing."""
