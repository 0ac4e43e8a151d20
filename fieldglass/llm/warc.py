"""WARC archives: writing captures as records, reading them back, assembling transactions.

A capture has a request, a response or revisit, and a metadata record. The request and metadata name the response in
WARC-Concurrent-To; grouping by that identifier brings the three together as one nested row. Archives are gzip files
that Spark's text writer commits (the record separator is its line separator), so a lost executor leaves no half
file; a file has a bounded number of records and is read as one piece.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.shared import new_path

END = "\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: A file holds at most FILE_RECORDS records and some FILE_BYTES, but a longer record whole.
FILE_RECORDS, FILE_BYTES = 3_000, 192 << 20
#: Pages are written by classes of size, each class up to STEP times the longest page of the one before.
STEP = 16


def _record(kind: str, rid: Column, concurrent: Column, uri: Column, extra: list[Column], content_type: str, block: Column) -> Column:
    """One record up to its block's end. Null headers are left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), rid), F.concat(F.lit("WARC-Concurrent-To: "), concurrent), F.concat(F.lit("WARC-Target-URI: "), uri), F.lit("WARC-Date: 2024-01-01T00:00:00Z"), *extra, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)


def write_archive(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as WARC files to path, files closed by records and by bytes.

    The text writer closes files by a number of records. So pages go by classes of size, four at most, each class with
    its own number; what a class holds tells from one count. Equal payloads are of one class, so that revisits are found
    within it. On the rows: see _write_class.
    """
    small = FILE_BYTES // FILE_RECORDS
    size = F.octet_length(F.coalesce("html", F.lit("")))
    kind = F.when(size <= small, 0).when(size <= small * STEP, 1).when(size <= small * STEP**2, 2).otherwise(3)
    present = sorted(r[0] for r in pages.select(kind.alias("kind")).distinct().collect()) or [0]  # four rows at most
    for k in present:
        _write_class(pages if present == [k] else pages.where(kind == k), f"{path}/class={k}", max(1, FILE_RECORDS // STEP**k))


def _write_class(pages: DataFrame, path: str, file_records: int) -> None:
    """Write pages (page_id, url, html) as WARC files to path.

    Null html is an empty payload; a null url leaves out the target. Of equal payloads of LEAST_REVISIT bytes or more
    that with the smallest page_id is a response and the others are revisits of it; a null page_id comes last. Rows that
    share a page_id are captures of their own; those with the payload of the response and its page_id are responses too.
    Line breaks in a url are percent-encoded. Other columns are ignored; no rows make an archive without records.
    """
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace("url", "[\\r\\n\\s]", "%20").alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    big = rows.where(F.octet_length("html") >= LEAST_REVISIT).select("digest", "page_id")
    heads = big.groupBy("digest").agg(F.min("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "head")
    # Both the window and the join go by the page alone, so that the payloads are dealt once.
    visits = big.join(heads, "digest").where(~F.col("page_id").eqNullSafe(F.col("head")))
    visits = visits.groupBy(page.alias("page")).agg(F.map_from_entries(F.collect_set(F.struct("digest", F.col("head").cast("string")))).alias("heads"))
    turn = F.row_number().over(Window.partitionBy("page").orderBy("digest", "url"))
    placed = rows.withColumn("page", page).withColumn("turn", turn)
    placed = placed.withColumn("turn", F.col("turn") - F.min("turn").over(Window.partitionBy("page", "digest")) + 1)
    placed = placed.join(visits.hint("merge"), "page", "left").withColumn("refers", F.try_element_at("heads", F.col("digest")))

    def rid(kind: str) -> Column:
        return F.concat(F.lit("<urn:capture:"), F.col("page"), F.lit(":"), F.substring("digest", 1, 16), F.lit("."), F.col("turn").cast("string"), F.lit(f":{kind}>"))

    main, size = rid("main"), F.octet_length("html").cast("string")
    shown = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size, F.lit(END + END))
    profile = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    refers = F.concat(F.lit("WARC-Refers-To: <urn:capture:"), F.col("refers"), F.lit(":"), F.substring("digest", 1, 16), F.lit(".1:main>"))
    none = F.lit(None).cast("string")
    main_record = F.when(F.col("refers").isNull(), _record("response", main, none, F.col("url"), [shown], "application/http; msgtype=response", F.concat(http, F.col("html")))).otherwise(
        _record("revisit", main, none, F.col("url"), [shown, profile, refers], "application/http; msgtype=response", http)
    )
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{END}Accept: text/html{END}{END}"))
    about = F.concat(F.lit("page-id: "), F.col("page"), F.lit(END))
    records = F.array(
        _record("request", rid("request"), main, F.col("url"), [], "application/http; msgtype=request", asked),
        main_record,
        _record("metadata", rid("metadata"), main, F.col("url"), [], "application/warc-fields", about),
    )
    lines = placed.select(F.explode(records).alias("value"))
    lines.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record in a WARC file, gzip members or plain.

    Blocks are taken by Content-Length, so nothing in them is mistaken for a record. Raises ValueError on a file that
    isn't WARC or breaks off. Gzip data are taken apart as they are read: beside the file, memory holds one record.
    """
    source = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := source.readline():
            if line == b"\r\n":
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record before byte {source.tell()}")
            headers = {}
            while (line := source.readline()) not in (b"\r\n", b""):
                name, _, value = line.partition(b":")
                headers[name.decode("ascii", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
            size = int(headers.get("content-length", "-1"))
            block = source.read(size) if line and size >= 0 else b""
            if len(block) != size:
                raise ValueError(f"a record breaks off at byte {source.tell()}")
            yield headers, block
    except EOFError as broken:
        raise ValueError("the gzip data break off") from broken


RECORD = "record_id string, type string, concurrent_to string, target_uri string, refers_to string, http_length long, payload_bytes long, payload_digest string, fields string"


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives below path. payload_bytes and payload_digest are of the payload that the
    record holds, or for a revisit those that its headers state for the full payload."""
    kinds = RECORD + (", payload binary" if with_payload else "")
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[k.split()[1]]) for n, k in zip(names, kinds.split(", "), strict=True)])
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for headers, block in parse_records(batch.column(0)[i].as_py()):
                    row = dict.fromkeys(names) | {"record_id": headers.get("warc-record-id"), "type": headers.get("warc-type"), "concurrent_to": headers.get("warc-concurrent-to"), "target_uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to")}
                    if row["type"] in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        stated = [line.split(b":")[1] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
                        row["http_length"] = int(stated[0]) if stated else None
                        if row["type"] == "response":
                            row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
                            if with_payload:
                                row["payload"] = payload
                                held += len(payload)
                        else:
                            row |= {"payload_bytes": row["http_length"], "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha256:")}
                    elif row["type"] == "metadata":
                        row["fields"] = block.decode("utf-8", "replace")
                    rows.append(row)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, kinds)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, request, main, metadata (structs, null where there is none) and n_records.

    Records belong to the capture that they name in concurrent_to, or by their own identifier if they name none, so
    an orphan makes a capture with what there is. Of several records of one kind the least stays; n_records tells.
    """
    row = F.struct(*[c for c in records.columns])
    part = {"request": F.col("type") == "request", "main": F.col("type").isin("response", "revisit"), "metadata": F.col("type") == "metadata"}
    found = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id"))
    return found.agg(*(F.min(F.when(test, row)).alias(name) for name, test in part.items()), F.count("*").alias("n_records"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = assemble(read_records(spark, path))

    def page(of: str) -> Column:
        return F.nullif(F.regexp_extract(of, "^<urn:capture:(-?[0-9]+):", 1), F.lit("")).cast("long")

    return captures.select(
        F.nullif(F.regexp_extract("metadata.fields", "page-id: (-?[0-9]+)", 1), F.lit("")).cast("long").alias("page_id"),
        F.col("main.payload_bytes").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        page("main.refers_to").alias("refers_to"),
    )
