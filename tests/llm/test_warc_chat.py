import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from fieldglass.llm import chat, warc
from fieldglass.llm.shared import new_path

PAGES, TURNS = "page_id long, url string, html string, type string", "conv_id long, turn long, role string, text string, seq int"


def captures(spark, rows):
    path = new_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame(rows, PAGES), path)
    return warc.assemble(warc.read_records(spark, path, with_payload=True)).collect()


def test_warc_round_trip(spark):
    long = "é WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\n" * 40
    rows = [(5, "http://a/ b\r\nc", long, "x"), (2, None, long, "x"), (9, "http://c", long, "x"), (1, "u", None, "x"), (3, "u", "", "x"), (4, "u", "short", "x"), (6, "u", "short", "x"), (7, "u", "x" * 99, ""), (8, "u", "x" * 99, ""), (10, "u", "y" * 100, ""), (11, "u", "y" * 100, ""), (-4, "u", "z" * 300_000, "")]
    rows += [(2, None, long, "x"), (None, "n", "none", "x")]
    found = captures(spark, rows)
    assert len(found) == len(rows)
    by = {}
    for c in found:
        assert c.n_records == 3 and c.request.concurrent_to == c.metadata.concurrent_to == c.capture_id == c.main.record_id
        by.setdefault(c.metadata.fields.strip(), []).append(c.main)
    kinds = {k: sorted(m.type for m in v) for k, v in by.items()}
    assert kinds["page-id: 2"] == ["response", "response"] and kinds["page-id: 5"] == kinds["page-id: 9"] == kinds["page-id: 11"] == ["revisit"]
    assert all(kinds[f"page-id: {i}"] == ["response"] for i in (1, 3, 4, 6, 7, 8, 10, -4)) and kinds["page-id: none"] == ["response"]
    assert by["page-id: 5"][0].refers_to.startswith("<urn:capture:2:") and by["page-id: 5"][0].refers_to in {m.record_id for m in by["page-id: 2"]}
    want = {str(i): (h or "").encode() for i, _, h, _ in rows}
    for i, payload in want.items():
        for m in by[f"page-id: {i.replace('None', 'none')}"]:
            assert (m.payload_bytes, m.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
            assert m.type == "revisit" or bytes(m.payload) == payload


def test_warc_empty_and_orphans(spark):
    assert captures(spark, []) == []
    path = new_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([(1, "u", "h", "")], PAGES), path)
    lone = warc.assemble(warc.read_records(spark, path).where("type = 'request'")).first()
    assert lone.request and not lone.main and not lone.metadata


def test_op3_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first = {}
    for r in pages:
        p = (r.html or "").encode()
        if len(p) >= 100:
            first[p] = min(r.page_id, first.get(p, r.page_id))
    want = set()
    for r in pages:
        p = (r.html or "").encode()
        head = first.get(p, r.page_id)
        want.add((r.page_id, len(p), hashlib.sha256(p).hexdigest(), "response" if head == r.page_id else "revisit", None if head == r.page_id else head))
    assert {tuple(r) for r in warc.op3_warc(spark, sf).collect()} == want


def expected(rows):
    out = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        n, turns, loss = out.get(conv, (0, "", ""))
        out[conv] = (n + 1, turns + f"{role or ''}\n{text or ''}\n", loss + (text or "") * (role == "assistant"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {k: (n, sha(t), len(x), sha(x)) for k, (n, t, x) in out.items()}


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\n\\<s>", "<\\s>", "[OUT", "A", "B", "", None, "<", "[INST", "é" * 5000, "a\\\n[/INST]\\", "</s", "x</s></s>"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text, 0) for c, role in ((1, "user"), (2, "assistant")) for t, text in enumerate(NASTY)]
    rows += [(3, t, ["user", "assistant", "sys\ntem", None, "[INST]"][t % 5], x, 0) for t, x in enumerate(NASTY * 40)]
    rows += [(None, None, "assistant", "no conv", 0), (None, 1, "assistant", "second", 0), (4, 0, "assistant", "same", 0), (4, 0, "assistant", "same", 0)]
    out = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, TURNS)))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out.collect()} == expected(rows)
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_chat_op6(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(*r, 0) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", NASTY[0], 0), (-7, 1, "assistant", NASTY[0], 0)]
    out = chat.op6_chat(spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == expected(rows)


def test_rewriting_template(spark):
    def last_thought_only(turns):
        return "".join(f"<{r}>{t}</{r}>" if i == len(turns) - 1 or r != "assistant" else f"<{r}></{r}>" for i, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "a", 0), (1, 1, "assistant", "b", 0), (1, 2, "user", "c", 0)]
    found = chat.rewriting_turns(spark.createDataFrame(rows, TURNS), last_thought_only).collect()
    assert [(r.conv_id, r.seq) for r in found] == [(1, 2)]


def test_rewriting_of_far_turns(spark):
    """Templates that rewrite turns well before the last: what is found agrees with rendering every whole prefix."""

    def thoughts_until_user(turns):
        last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
        return "".join(f"<{r}>{t if r != 'assistant' or i > last else ''}</{r}>" for i, (r, t) in enumerate(turns))

    def five_turns(turns):
        return "".join(f"<{r}>{t}</{r}>" for r, t in turns[-5:])

    def numbered(turns):
        return "".join(f"<{i} {r}>{t}</{r}>" for i, (r, t) in enumerate(turns))

    roles = ["user", "assistant", "tool", "tool", "tool", "user", "tool", "tool"]
    rows = [(1, i, r, f"text {i}", 0) for i, r in enumerate(roles)]
    turns = [(r[2], r[3]) for r in rows]
    for template, rewriting in ((thoughts_until_user, [5]), (five_turns, [5, 6, 7]), (numbered, [])):
        found = chat.format_conversations(spark.createDataFrame(rows, TURNS), template).collect()
        assert [r.seq for r in found if r.rewritten] == rewriting
        for r in found:
            was, now = template(turns[: r.seq]), template(turns[: r.seq + 1])
            assert r.chunk == (now if r.rewritten else now[len(was) :])
            assert r.rewritten or r.chunk[r.text_start : r.text_end] == turns[r.seq][1]


def test_files_are_closed_by_bytes(spark, monkeypatch):
    """Small pages by records, larger ones by their class, however they come; the rows are those of one class."""
    monkeypatch.setattr(warc, "FILE_RECORDS", 64)
    monkeypatch.setattr(warc, "FILE_BYTES", 64 * 100)
    sizes = [90, 120, 1500, 1700, 25_500, 26_000, 500_000]
    rows = [(100 * k + i, "u", f"{i % 20:02}" + "p" * (n - 2), "") for k, n in enumerate(sizes) for i in range(30)]
    path = new_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    files = [len(list(warc.parse_records(bytes(r.content)))) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).collect()]
    assert sum(files) == 3 * len(rows) and max(files) <= 64 and sum(n == 1 for n in files) >= 90
    for c in warc.assemble(warc.read_records(spark, path)).collect():
        k, i = divmod(int(c.metadata.fields.strip().removeprefix("page-id: ")), 100)
        assert c.n_records == 3 and c.main.payload_bytes == sizes[k]
        assert (c.main.type == "revisit") == (i >= 20 and sizes[k] >= 100)
        assert not c.main.refers_to or c.main.refers_to.startswith(f"<urn:capture:{100 * k + i - 20}:")


def test_broken_archives():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, b in warc.parse_records(record * 2)] == [b for _, b in warc.parse_records(gzip.compress(record) * 2)] == [b"abcd"] * 2
    whole = gzip.compress(record + bytes(range(256)))
    for bad in (b"no archive", record + b"x", record[:30], record[:-6], record.replace(b"Content-Length: 4\r\n", b""), gzip.compress(record)[:-9], whole):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


def test_spans_of_odd_templates():
    """A text shown once has its span; one shown twice, or within a frame that varies with it, has none."""
    def span(shown):
        return chat.text_span(lambda turns: "".join(shown(t) for _, t in turns), [("user", "x")], ("user", "hello"))

    assert span(lambda t: f"<{t}>") == (1, 6)
    assert span(lambda t: f"<{t}|{t}>") == span(lambda t: f"<{t}>{'!' * (len(t) > 3)}") == span(lambda t: "<>") == (0, 0)
    assert span(lambda t: f"{len(t)}:{t}") == (0, 0)


def test_op6_renders_every_whole_prefix():
    """The query's template is a black box: a rewriting of any earlier turn would show in the turns that it renders."""
    seen = []
    template = lambda turns: seen.append(len(turns)) or chat.inst_template(turns)
    template.__dict__.update(chat.inst_template.__dict__)
    state = chat.Rendering(template)
    for i in range(9):
        state.add(("user", f"text {i}"))
    assert max(seen) == 9
