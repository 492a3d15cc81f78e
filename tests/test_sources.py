"""Source mapping, prompt files, answers up to the model, load schedules."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from scrivenry.functions import parsing
from scrivenry.operators import answering, ingest, metrics
from scrivenry.sources.mapping import map_source


def plain_map(raw, max_pages, max_chars):
    """Pages, text and truncation of one source, told plainly."""
    pages, chars = [], 0
    listed = raw.get("pages") if isinstance(raw.get("pages"), list) else []
    for at, entry in enumerate(listed, 1):
        text = entry.get("text") if isinstance(entry, dict) else None
        if not isinstance(text, str):
            continue
        if len(pages) >= max_pages or chars + len(text) > max_chars:
            return pages, "" if pages else (raw.get("text") if isinstance(raw.get("text"), str) else "")[:max_chars], True if pages else None
        number = entry.get("page_no")
        try:
            number = None if isinstance(number, bool) else int(number)
        except (TypeError, ValueError):
            number = None
        pages.append((number if number and number >= 1 else at, text))
        chars += len(text)
    text = "" if pages or not isinstance(raw.get("text"), str) else raw["text"]
    return pages, text[:max_chars], len(text) > max_chars


def test_sources_are_mapped(spark):
    raws = [
        {"text": "only text", "doc_type": " memo ", "tags": "one", "version": "7", "acl_users": [" ann ", "", None, 5], "created_at": "2024-03-01T10:00:00Z"},
        {"pages": [{"page_no": 3, "text": "three"}, {"text": "no number"}, {"page_no": "x", "text": "y"}, {"page_no": True, "text": "z"}, {"page_no": 0, "text": "w"}, "odd", {"page_no": 9}, {"page_no": "12", "text": ""}], "text": "ignored"},
        {"pages": [{"text": "a" * 6}, {"text": "b" * 6}, {"text": "c"}]},
        {"pages": [{"text": "p"}] * 9, "tags": [], "version": True, "doc_type": 5},
        {"pages": {"text": "not a list"}, "text": "t" * 15, "version": 4.0, "doc_type": [1], "owner": None},
        {"pages": [{"page_no": 1}], "text": "kept"},
        {"text": 5},
        {},
    ]
    rows = [(str(i), json.dumps(r)) for i, r in enumerate(raws)] + [("bad", "{"), ("null", None)]
    got = {r.item_id: r for r in map_source(spark.createDataFrame(rows, "item_id string, source string"), max_pages=5, max_chars=10).collect()}
    for i, raw in enumerate(raws):
        pages, text, truncated = plain_map(raw, 5, 10)
        r = got[str(i)]
        assert ([tuple(p) for p in r.pages], r.text, r.truncated) == (pages, text, truncated), i
    a = got["0"]
    assert (a.doc_type, a.tags, a.version, a.acl_users, a.acl_groups, a.created_at.day) == ("memo", ["one"], 7, ["ann", "5"], [], 1)
    assert (got["3"].version, got["3"].doc_type, got["3"].tags) == (None, "5", [])
    assert (got["4"].version, got["4"].doc_type, got["4"].owner) == (4, None, None)
    for name in ("bad", "null"):
        assert (got[name].pages, got[name].text, got[name].truncated, got[name].tags) == ([], "", False, [])


def test_prompt_files(spark):
    base = spark.conf.get("spark.checkpoint.dir") + "/prompts-" + uuid.uuid4().hex
    folder = base.removeprefix("file://")
    import pathlib

    pathlib.Path(folder).mkdir(parents=True)
    files = {"answer.v1.txt": "### SYSTEM\nBe brief.\n### USER\n{{context}}\n\n{{question}} {{context}}\n", "answer.v2.txt": "x ### SYSTEM\na\n### USER\nb", "empty.v1.txt": "### SYSTEM\n### USER\nb", "b a d.v1.txt": "### SYSTEM\na\n### USER\nb", "none.v1.txt": "text"}
    for name, content in files.items():
        (pathlib.Path(folder) / name).write_text(content)
    got = {(r.name, r.version): r for r in answering.load_prompts(spark, base).collect()}
    one = got["answer", "v1"]
    assert (one.system, one.user, one.placeholders, one.problem) == ("Be brief.", "{{context}}\n\n{{question}} {{context}}", ["context", "question"], None)
    assert {k: r.problem for k, r in got.items() if r.problem} == {("answer", "v2"): "malformed", ("empty", "v1"): "malformed", (None, None): "invalid name", ("none", "v1"): "malformed"}


def test_answers_up_to_the_model(spark):
    hits = [(q, r, d, f"c{q}{r}", f"passage {r} of {q} " + "word " * 30, f"doc {d}", s, m) for q, r, d, s, m in [(1, 1, 5, 0.9, "hybrid+rerank"), (1, 2, 6, 0.5, "hybrid+rerank"), (2, 1, 5, 0.01, "hybrid+rerank"), (3, 1, 5, 0.01, "hybrid")]]
    h = spark.createDataFrame(hits, "qid long, rank long, doc_id long, chunk_id string, content string, label string, score double, mode_used string")
    q = spark.createDataFrame([(i, f"{{{{context}}}} question {i}") for i in range(1, 5)], "qid long, query string")
    got = {r.qid: r for r in answering.prepared(h, q, "Use:\n{{context}}\nAsk: {{question}}", least=0.1, budget=60).collect()}
    assert {i: r.reason for i, r in got.items()} == {1: None, 2: "low_score", 3: None, 4: "no_context"}
    assert [(x.ref, x.chunk_id, x.tokens) for x in got[1].refs] == [(1, "c11", 34), (2, "c12", 16)] or len(got[1].refs) == 1
    assert got[1].prompt.startswith("Use:\n[1] doc 5\npassage 1 of 1 word") and got[1].prompt.endswith("Ask: {{context}} question 1")
    assert got[2].prompt is None and got[4].refs is None
    with pytest.raises(ValueError):
        answering.prepared(h, q, "{{other}}")


def test_load_schedule(spark):
    q = spark.createDataFrame([(i, f"q{i}") for i in range(3)], "qid long, query string")
    rows = sorted(metrics.load_schedule(q, 2.0, 3.5).collect(), key=lambda r: r.number)
    assert [(r.number, r.due_s, r.qid) for r in rows] == [(i, i / 2, i % 3) for i in range(7)]
    for bad in ((q, 0, 1), (q, 1, 0), (q.limit(0), 1, 1)):
        with pytest.raises(ValueError):
            metrics.load_schedule(*bad)
    sent = spark.range(40).select(F.col("id").alias("number"), (F.col("id") * 0.5).alias("due_s"), (F.col("id") % 5 + 0.25).alias("took_s"))
    got = {r.number: r for r in metrics.in_flight(sent, 5).collect()}
    for i in range(40):
        running = sum(j * 0.5 + j % 5 + 0.25 > i * 0.5 for j in range(i))
        assert (got[i].waiting, got[i].dropped) == (running, running >= 5)


def test_safe_errors(spark):
    rows = spark.createDataFrame([("OwnError", "plain words"), ("KeyError", "secret"), ("OwnError", None)], "kind string, message string")
    assert [r[0] for r in rows.select(ingest.safe_error(F.col("kind"), F.col("message"), ["OwnError"])).collect()] == ["OwnError: plain words", "KeyError", "OwnError"]


def test_values_out_of_loose_input(spark):
    said = [('a {"x": {"y": {"z": "}{"}}} {"k": 1}', '{"x": {"y": {"z": "}{"}}}'), ("{no} {also: } { \"k\": [1, {}]}", '{ "k": [1, {}]}'), ("{", None), (None, None), ('{"a": "\\\\" }"}', '{"a": "\\\\" }')]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "i long, t string")
    assert {r.i: r.j for r in df.select("i", parsing.first_json(F.col("t")).alias("j")).collect()} == {i: want for i, (_, want) in enumerate(said)}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(parsing.backoff(F.lit(n))) for n in (0, 1, 9)] == [0.5, 1.0, 60.0]
    assert one(parsing.backoff(F.lit(2), jitter=F.lit(1.0))) == 1.0
    headers = F.create_map(F.lit("x-retry-count"), F.lit("3"), F.lit("x-origin"), F.lit("live/1/2"))
    assert one(parsing.header_number(headers)) == 3 and one(parsing.header_number(headers, "x-origin")) == 0
    assert one(parsing.origin(headers, F.lit("t"), F.lit(0), F.lit(1))) == "live/1/2"
    assert one(parsing.faithfulness(F.lit('so: {"supported": 2, "total": 4}'))) == 0.5 and one(parsing.faithfulness(F.lit('{"supported": 5, "total": 4}'))) is None
    assert one(parsing.relevance(F.lit('{"score": 5}'))) == 1.0 and one(parsing.relevance(F.lit('{"score": 6}'))) is None


def test_strict_mapping(spark):
    from scrivenry.sources.templates import Template, physical_name, strictly_mapped

    t = Template("chunks_v*", {"id": "keyword", "no": "integer", "n": "long", "body": "text", "tags": "keywords", "at": "date", "table": "boolean", "vec": "vector:2"}, longest=5)
    assert t.matches(physical_name("chunks", "v1", "BGE-m3")) and not t.matches("other_v1") and physical_name("chunks", "v1", "BGE-m3") == "chunks_v1_bgem3"
    good = '{"id": "a", "no": 3, "n": "9000000000", "body": "text", "tags": ["x", "longer than five"], "at": "2024-01-01", "table": true, "vec": [1, 0.5]}'
    cases = {
        1: (good, None), 2: ('{"id": "longer", "tags": "one", "no": null}', None), 3: ("{}", None), 4: ('{"id": 7, "z": 1, "b": {"no": 1}}', "unplanned b, unplanned z"), 5: ('{"no": 9000000000, "n": 1.5, "body": 4}', "bad no, bad n, bad body"),
        6: ('{"id": ["a"], "tags": {"a": 1}, "at": "soon", "table": "true"}', "bad id, bad tags, bad at, bad table"), 7: ('{"vec": [1]}', "bad vec"), 8: ('{"vec": [0, 0]}', "bad vec"), 9: ('{"vec": [1, "x"], "q": null}', "unplanned q, bad vec"), 10: ("[1]", "no object"), 11: ("{broken", "no object"), 12: (None, "no object"), 13: ("", "no object"),
    }
    out = {r["row"]: r for r in strictly_mapped(spark.createDataFrame([(i, s) for i, (s, _) in cases.items()], "row int, source string"), t).collect()}
    assert {i: r.problem for i, r in out.items()} == {i: p for i, (_, p) in cases.items()}
    r = out[1]
    assert (r.id, r.no, r.n, r.body, r.tags, r["at"].year, r.table, r.vec) == ("a", 3, 9_000_000_000, "text", ["x"], 2024, True, [1.0, 0.5])
    assert (out[2].id, out[2].tags, out[2].no, out[4].id) == (None, ["one"], None, None)
    assert strictly_mapped(spark.createDataFrame([], "row int, source string"), t).count() == 0
    with pytest.raises(ValueError, match="columns already"):
        strictly_mapped(spark.createDataFrame([], "id int, source string"), t)
