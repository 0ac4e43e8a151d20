"""128-bit names of words and of word sequences.

A word's name is its SipHash under two keys, a pseudo-random function of the whole word each, so equal words, and no
others, get equal names on every executor without a shared dictionary. Names of sequences mix the names of their parts,
lane by lane.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array

_LEFT, _RIGHT, _LAST = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xFF51AFD7ED558CCD)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Keys of the two lanes; fixed, as names must agree between tasks and runs.
KEYS = ("fieldglass words", "second lane here")
#: Bytes of text that are split at once.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= _LAST
    x ^= x >> np.uint64(29)
    x *= _LEFT
    x ^= x >> np.uint64(32)
    return x


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of each a followed by b."""
    x = (b ^ (b >> np.uint64(29))) * _RIGHT
    x += a * _LEFT
    x ^= x >> np.uint64(32)
    x *= _LAST
    x ^= x >> np.uint64(29)
    return x


def chunks(text: bytes, most: int = CHUNK) -> Iterator[bytes]:
    """text in parts of about `most` bytes that end at blanks."""
    at = 0
    while at < len(text):
        end = _BLANK.search(text, at + most) if at + most < len(text) else None
        stop = end.end() if end else len(text)
        yield text[at:stop]
        at = stop


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words `[^\\x20\\x09-\\x0D]+` of all texts in turn, as (two lanes, words), and the texts' bounds in them (one more than texts)."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))  # at \x20 and \x09-\x0D only
    coded = split.values.dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    lanes = np.stack([hash_array(words, hash_key=key, categorize=False) for key in KEYS])
    at = coded.indices.to_numpy()
    some = np.array([len(w) > 0 for w in words], bool)[at] if len(at) else np.empty(0, bool)  # blanks at an end leave an empty word
    bounds = np.concatenate([[0], np.cumsum(some)])[split.offsets.to_numpy()].astype(np.int64)
    return np.ascontiguousarray(lanes[:, at[some]]), bounds


def in_pieces(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of about `most` bytes together; a longer text is one by itself."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)
