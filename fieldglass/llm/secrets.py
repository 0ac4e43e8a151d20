"""Secret scans: patterns, then structural confirmation.

The base patterns report by shape alone. Other long tokens are candidates only: they are reported when base64 or hex
decodes to a key encoding (DER whose nested lengths fit, PEM armour around such DER), or when the first of three or
five dotted parts decodes to a JSON object that names an algorithm. Keys in base64 or hex may be wrapped over lines,
with escaped line breaks, quote marks or a prefix on each, and may begin within a longer run: the length in their DER tells
where they end. Everything is judged within one text, so a row needs no other row. The work is linear in the text: each
run is decoded once for each of its alignments, and what is looked at from each start is bounded by the format.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldglass.llm.shared import mapped, quoted, row_packed, row_unpacked

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # greedy runs: the same spans as all runs of which the short ones are dropped
MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----", re.A)
#: Line breaks as such or escaped, once or more often, as in JSON.
BREAK = re.compile(r"\r?\n|(?:\\+[rn])+")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{14,}+(?:\.[A-Za-z0-9_-]*){2,}", re.A)  # no header is shorter: {"alg":""}
#: Where a header can begin: at the start of a part or after - or _, with what { or blanks or a byte order mark are in base64.
HEADER = re.compile(r"(?<![A-Za-z0-9])[eICD7]", re.A)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]+", re.A)
HEX_DIGITS = re.compile(r"[0-9A-Fa-f]+", re.A)
#: A line break within a key: in the text or escaped, with the marks of a quotation or of string literals about it.
_WRAP = r"""(?:["'][ \t]*+[+,\\]?+)?+[ \t\r]*+\n[ \t]*+(?:[>|#*;][ \t]*+)*+["']?+|(?:\\++[rn])++(?:["'][ \t]*+[+,\\]?+[ \t\r]*+\n[ \t]*+["'])?+"""
WRAP = re.compile(_WRAP)
HEX_WRAP = re.compile(rf":?(?:{_WRAP})|[: ]")
#: Where a DER sequence can begin: base64 of 0x30 and a length. Its characters may be wrapped over lines.
SEQUENCE = re.compile(rf"M(?=(?:{_WRAP})?[A-I])")
BARE_SEQUENCE = re.compile(r"M(?=[A-I])")
HEX_SEQUENCE = re.compile(r"30")
#: In hex the whole head can be told at once: a sequence, its length, and a version of one byte.
HEX_HEAD = re.compile(r"30(?=(?:[0-7].|81..|82.{4}|83.{6}|84.{8})0201)")
PAD = re.compile(r"={0,2}")
BLANKS = b" \t\r\n"
JSON_MARKS = re.compile(rb'\\*"|[][{}]')
TO_PLAIN = str.maketrans("-_", "+/")
#: Items of a key's sequence: an RSA key has nine and, if it has more primes, a list of them. All other forms have fewer.
MOST_ITEMS = 10
#: Kinds in their order at one start; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "signed", "der", "der_hex")
NAMES = re.compile(r"passw|secret|token|api_?key")


def unpacked(text: str) -> bytes | None:
    """Base64, plain or for URLs, padded or not; None where it isn't."""
    bare = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly; None if the lengths don't fit or there are more than
    a key's."""
    found = []
    while at < end:
        if at + 2 > end or len(found) == MOST_ITEMS:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            more = n & 0x7F
            if not 1 <= more <= 4 or at + more > end or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + more], "big")
            at += more
            if n < 0x80:
                return None
        if at + n > end:
            return None
        found.append((tag, at, at + n))
        at += n
    return found


def is_key(data: bytes | None) -> bool:
    """A DER sequence, whole and with nothing after, of the shape of a private key."""
    return bool(data) and is_key_at(data, 0, len(data))


def is_key_at(data: bytes, at: int, end: int) -> bool:
    """data[at:end] is a sequence of a version, then the numbers of RSA or DSA, octets, or an algorithm and octets."""
    if end - at < 24 or data[at] != 0x30:
        return False
    whole = der_items(data, at, end)
    if not whole or len(whole) != 1:
        return False
    parts = der_items(data, whole[0][1], whole[0][2])
    if not parts or len(parts) < 2 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    tags = [p[0] for p in parts[1:]]
    if tags[0] == 0x30 and len(tags) >= 2 and tags[1] == 0x04:  # PKCS #8: algorithm, then wrapped key
        inner = der_items(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06
    more_primes = len(tags) == 9 and tags[8] == 0x30
    return (len(tags) >= 5 and set(tags[:8] if more_primes else tags) == {0x02}) or tags[0] == 0x04  # SEC 1: octets


def is_locked_key(data: bytes | None) -> bool:
    """DER of an encrypted key: a sequence of an algorithm, which begins with its identifier, and octets."""
    whole = der_items(data, 0, len(data)) if data else None
    if not whole or len(whole) != 1 or whole[0][0] != 0x30:
        return False
    parts = der_items(data, whole[0][1], whole[0][2])
    if not parts or [p[0] for p in parts] != [0x30, 0x04]:
        return False
    inner = der_items(data, parts[0][1], parts[0][2])
    return bool(inner) and inner[0][0] == 0x06


def is_openssh_key(data: bytes | None) -> bool:
    """The mark of the format, then cipher, key derivation and its options, the number of keys, and as many public keys and
    one private part, each with its length before it and nothing after."""
    if not data or not data.startswith(b"openssh-key-v1\0"):
        return False
    at, left, keys = 15, 3, None
    while left:
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at, left = at + 4 + n, left - 1
        if at > len(data):
            return False
        if not left and keys is None:
            keys = int.from_bytes(data[at : at + 4], "big")
            at, left = at + 4, keys + 1
            if not 0 < keys < 100:
                return False
    return at == len(data)


def armour_lines(text: str, start: int, body: str) -> list[str]:
    """The lines between the marks of a key that begins at start, without what else stands on each of them.

    Line breaks may be escaped. A prefix of the first line that every other line has too, as in quoted mail or comments, is no
    part of them, nor are the quotation marks of string literals.
    """
    lines = body.split("\n")
    if len(lines) > 1:
        prefix = text[text.rfind("\n", 0, start) + 1 : start].rstrip()
        if prefix and all(x.startswith(prefix) for x in lines[1:] if x.strip()):
            lines = [lines[0], *(x[len(prefix) :] for x in lines[1:])]
    parts = [x for line in lines for x in BREAK.split(line)]
    return [x for x in map(unquoted, parts) if x]


def unquoted(line: str) -> str:
    """A line without blanks and what string literals put about it, and its slashes without escapes."""
    line = line.strip()
    if line.endswith("+") and line[:-1].rstrip().endswith(("'", '"')):
        line = line[:-1]
    return line.strip(" \t\"',;\\").replace("\\/", "/")


def is_armoured_key(label: str, lines: list[str]) -> bool:
    headers = [x for x in lines if ":" in x]
    data = unpacked("".join("".join(x for x in lines if ":" not in x).split()))
    if any("4,ENCRYPTED" in x for x in headers) and any("DEK-Info:" in x for x in headers):  # then the key is whole blocks of a cipher
        return bool(data) and len(data) >= 24 and len(data) % 8 == 0
    return is_openssh_key(data) if "OPENSSH" in label else is_locked_key(data) if "ENCRYPTED" in label else is_key(data)


def armoured_spans(text: str) -> list[tuple[int, int]]:
    """Spans from the mark that begins a key to the next mark, if that ends the same kind of key and a key lies between."""
    marks, found = list(MARK.finditer(text)), []
    for one, two in zip(marks, marks[1:], strict=False):
        if (one[1], two[1]) == ("BEGIN", "END") and one[2] == two[2] and is_armoured_key(one[2], armour_lines(text, one.start(), text[one.end() : two.start()])):
            found.append((one.start(), two.end()))
    return found


def header_of(part: str) -> dict | None:
    """A signed or encrypted token's header: a JSON object that names its algorithm."""
    try:
        found = json.loads(unpacked(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) and isinstance(found.get("alg"), str) else None


def object_start(data: bytes) -> int | None:
    """Where the JSON object that ends data begins: at the brace that its last one closes.

    Seen from the end, what is within quotation marks is the same for every start, so there is one such brace.
    """
    if not data.rstrip(BLANKS).endswith(b"}"):
        return None
    marks = array("q", (m.end() - 1 for m in JSON_MARKS.finditer(data) if m[0][-1:] != b'"' or len(m[0]) % 2))  # an escaped one is part of its string
    depth, inside = 0, False
    for at in reversed(marks):
        if data[at] == 0x22:
            inside = not inside
        elif not inside:
            depth += 1 if data[at] in b"}]" else -1
            if depth == 0:
                return at if data[at] == 0x7B else None
    return None


def header_at(part: str) -> tuple[int, dict] | None:
    """The first place of a part from which on it is a header, and that header."""
    starts: dict[int, list[int]] = {}
    for h in HEADER.finditer(part):
        starts.setdefault(h.start() % 4, []).append(h.start())
    found = []
    for shift, places in starts.items():
        if (len(part) - shift) % 4 == 1:
            continue
        code = part[shift:].translate(TO_PLAIN)
        data = base64.b64decode(code + "=" * (-len(code) % 4))
        brace = object_start(data)
        if brace is None:
            continue
        least = brace
        while least and data[least - 1] in BLANKS:
            least -= 1
        i = bisect_left(places, shift + (least + 2) // 3 * 4)
        fits = places[i : i + 1] if i < len(places) and places[i] <= shift + brace // 3 * 4 else []
        if least % 3 == 0 and data[max(least - 3, 0) : least] == b"\xef\xbb\xbf":
            marked = shift + (least // 3 - 1) * 4
            fits = places[i - 1 : i] if i and places[i - 1] == marked else fits
        header = header_of(part[fits[0] :]) if fits else None
        found += [(fits[0], header)] if header else []
    return min(found, key=lambda x: x[0], default=None)


def signed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of signed (three parts) and encrypted tokens (five): any dotted parts of which the first is a header.

    Claims may be anything, also empty; the last part may be empty only if the header says that nothing is signed.
    """
    found = []
    for m in DOTTED.finditer(text):
        done = m.start()
        ends = [m.start() + i for i, x in enumerate(m[0]) if x == "."] + [m.end()]
        parts = list(zip([m.start(), *(e + 1 for e in ends)], ends, strict=False))
        for i, (start, end) in enumerate(parts[:-2]):
            if start < done or end - start < 14:
                continue
            told = header_at(text[start:end])
            if told is None:
                continue
            at, header = told
            n = 5 if "enc" in header and i + 5 <= len(parts) and parts[i + 4][0] < parts[i + 4][1] else 3
            last = parts[i + n - 1]
            if last[0] < last[1] or header["alg"].lower() == "none" and parts[i + 1][0] < parts[i + 1][1]:
                found.append((start + at, last[1]))
                done = last[1]
    return found


def runs(text: str, first: re.Pattern, digits: re.Pattern, wrap: re.Pattern) -> Iterator[tuple[str, list[int], list[int]]]:
    """Runs of digits over their line breaks, each from its first `first` on: the digits, and where (in the run, in the text)
    each unbroken part begins."""
    at = 0
    while m := first.search(text, at):
        at, n, parts, begins, places = m.start(), 0, [], [], []
        while c := digits.match(text, at):
            parts.append(c[0])
            begins.append(n)
            places.append(at)
            n, end = n + len(c[0]), c.end()
            w = wrap.match(text, end)
            at = w.end() if w else end
            if not w:
                break
        at = max(end, m.end())
        yield "".join(parts), begins, places


def key_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of base64 keys without armour, wherever they begin and however they are wrapped; none within `taken`."""
    found, outside = [], [s for s, _ in taken]
    for run, begins, places in runs(text, SEQUENCE, BASE64, WRAP):
        if len(run) < 32:
            continue
        done, decoded = 0, {}

        def place(i: int) -> int:
            k = bisect_right(begins, i) - 1
            return places[k] + i - begins[k]

        for m in BARE_SEQUENCE.finditer(run):
            i = m.start()
            if i < done or len(run) - i < 32:
                continue
            if i % 4 not in decoded:
                code = run[i % 4 :].translate(TO_PLAIN)
                decoded[i % 4] = base64.b64decode(code + "A" * (-len(code) % 4))
            data, at = decoded[i % 4], i // 4 * 3
            if data[at] != 0x30 or data[at + 1] == 0x80 or data[at + 1] > 0x84:
                continue
            more = data[at + 1] & 0x7F if data[at + 1] & 0x80 else 0
            size = 2 + more + (int.from_bytes(data[at + 2 : at + 2 + more], "big") if more else data[at + 1])
            want = -(-size * 4 // 3)
            if data[at + 2 + more : at + 4 + more] != b"\x02\x01" or want > len(run) - i:  # a private key's version
                continue
            start = place(i)
            near = bisect_right(outside, start) - 1
            if (near < 0 or taken[near][1] <= start) and is_key_at(data, at, at + size):
                done = i + want
                found.append((start, PAD.match(text, place(done - 1) + 1).end()))
    return found


def hex_key_spans(text: str) -> list[tuple[int, int]]:
    """Spans of keys in hex, wherever they begin, wrapped, or with a colon or blank between bytes."""
    found = []
    for run, begins, places in runs(text, HEX_SEQUENCE, HEX_DIGITS, HEX_WRAP):
        if len(run) < 48:
            continue
        done, decoded = 0, {}
        for m in HEX_HEAD.finditer(run):
            i = m.start()
            if i < done:
                continue
            if i % 2 not in decoded:
                decoded[i % 2] = bytes.fromhex(run[i % 2 : len(run) - (len(run) - i) % 2])
            data, at = decoded[i % 2], i // 2
            more = data[at + 1] & 0x7F if data[at + 1] & 0x80 else 0
            size = 2 + more + (int.from_bytes(data[at + 2 : at + 2 + more], "big") if more else data[at + 1])
            if at + size <= len(data) and is_key_at(data, at, at + size):
                done = i + 2 * size
                ends = [places[k] + j - begins[k] for j in (i, done - 1) for k in [bisect_right(begins, j) - 1]]
                found.append((ends[0], ends[1] + 1))
    return found


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of KINDS. Null and empty have none."""
    found: list[tuple[str, int, int]] = []
    if not text:
        return found
    if NAMES.search(text.lower()):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    long = max(map(len, text.split()), default=0)
    if long >= 24:
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [("pem", *span) for span in armoured_spans(text)]
    if long >= 18:
        found += [("signed", *span) for span in signed_spans(text)]
    found += [("der", *span) for span in key_spans(text, [(s, e) for k, s, e in found if k == "pem"])]
    found += [("der_hex", *span) for span in hex_key_spans(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with column `out`: array<struct<kind, start, end>> of the spans in each whole text, never null.

    Null and empty texts have no spans; repeated rows get equal ones; no rows give no rows. A column of docs that is
    named as `out` is replaced.
    """
    keep = [f for f in docs.schema if f.name != out]

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in secret_spans(x)] for x in batch.column(at).to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), pa.array(spans, kind)], names=[*(f.name for f in keep), out])

    made = StructType([*keep, *StructType.fromDDL(f"{quoted(out)} array<struct<kind:string,start:int,end:int>>")])
    return mapped(docs.select(*(quoted(f.name) for f in keep)), scan, made)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every secret in `text` written over by [kind]; overlapping spans merge under the first one's kind.

    A null text stays null.
    """
    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        return batch.set_column(at, batch.schema.field(at).with_type(pa.string()), pa.array([redacted(x) for x in batch.column(at).to_pylist()], pa.string()))

    return mapped(docs, clean, docs.schema)


def redacted(text: str | None) -> str | None:
    spans = secret_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    base = F.filter("secrets", lambda s: s.kind.isin("assign", "access", "hex"))
    def count(kind):
        return F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return find_secrets(docs).select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets written over; other columns stay as they are."""
    return row_unpacked(redact(row_packed(docs, "text")), docs.columns, "text")
