"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldglass.llm import chat, collocations, decontaminate, lattice, licenses, mixing, near, negatives, quality, repeats, secrets, topk, warc
from fieldglass.llm.sql import SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_repeats": repeats.op2_repeats,
        "op3_warc": warc.op3_warc,
        "op4_lattice": lattice.op4_lattice,
        "op5_quality": quality.op5_quality,
        "op6_chat": chat.op6_chat,
        "op7_mixing": mixing.op7_mixing,
        "op8_secrets": secrets.op8_secrets,
        "op9_near": near.op9_near,
        "op10_licenses": licenses.op10_licenses,
        "op11_negatives": negatives.op11_negatives,
        "op12_collocations": collocations.op12_collocations,
        "op13_topk": topk.op13_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
