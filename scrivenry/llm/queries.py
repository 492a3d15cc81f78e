"""The queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontam, exact_dedup, line_dedup, near_dedup, packing, passages, pii, quality, runs, token_counts, toxicity, treaps, warc
from .store import bound_batches, new_path

BPE = "byte_bpe_50k"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    read = warc.sound_records(warc.read_archives(spark, path, payloads=False))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(f"{BPE}.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the lines to remove, joined by commas."""
    out = line_dedup.repeated_lines(table(spark, sf_dir, "documents"))
    return out.withColumn("removed_lines", F.array_join("removed_lines", ","))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(f"{BPE}.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_report(passages.without_repeated_passages(table(spark, sf_dir, "documents"), length=50))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(runs.periodic_runs(runs.spliced(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_warc, op3_token_counts, op4_decontamination, op5_line_dedup, op6_pii, op7_near_dedup, op8_toxicity, op9_packing, op10_quality, op11_ranked_search, op12_repeated_passages, op13_periodic_runs)
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
""",
    "op4_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS s FROM d),
si AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS s FROM i),
n AS (SELECT item_id, count(*) AS item_shingles FROM si GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, count(*) AS shared, count(*) / item_shingles AS containment
FROM si JOIN ds USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= 0.8 * item_shingles
""",
    "op5_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM d),
t AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS w FROM l),
c AS (SELECT row_number() OVER () AS k, w, len(w) AS n, min((doc_id, line_no)) AS place FROM t WHERE len(w) > 0 GROUP BY w),
x AS (SELECT k, n, unnest(w) AS word FROM c),
f AS (SELECT word, count(*) AS often FROM x GROUP BY word),
p AS (SELECT k, n, word FROM x JOIN f USING (word) QUALIFY row_number() OVER (PARTITION BY k ORDER BY often, word) <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b USING (word) WHERE a.k <> b.k AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
m AS (SELECT DISTINCT b FROM cand JOIN c ca ON ca.k = a JOIN c cb ON cb.k = b WHERE ca.place < cb.place AND 100 * len(list_intersect(ca.w, cb.w)) >= 80 * (ca.n + cb.n - len(list_intersect(ca.w, cb.w)))),
gone AS (SELECT doc_id, line_no FROM t JOIN c USING (w) WHERE (doc_id, line_no) <> place OR k IN (SELECT b FROM m))
SELECT d.doc_id, len(l) AS n_lines, count(g.line_no) AS n_removed, coalesce(string_agg(g.line_no::VARCHAR, ',' ORDER BY g.line_no), '') AS removed_lines FROM d LEFT JOIN gone g USING (doc_id) GROUP BY d.doc_id, l
""",
    "op7_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n_shingles FROM s),
e AS (SELECT doc_id, n_shingles, unnest(s) AS g FROM s JOIN n USING (doc_id)),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n_shingles, b.n_shingles HAVING 100 * count(*) >= 85 * (a.n_shingles + b.n_shingles - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT doc_id, n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n_shingles
""",
    "op11_ranked_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, n, term),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, n_docs),
x AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM i JOIN f USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10
""",
    "op12_repeated_passages": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
o AS (SELECT s, min(doc_id) AS first_id FROM g GROUP BY s),
m AS (SELECT doc_id, i, i > lag(i, 1, -51) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS fresh FROM g JOIN o USING (s) WHERE doc_id > first_id),
k AS (SELECT doc_id, i, count_if(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m),
sp AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, span),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM sp),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS rest, string_agg(substr(h, (2 * since + 1)::BIGINT, (2 * (a - since))::BIGINT), '' ORDER BY a) AS head FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(rest, 0) + 1)::BIGINT))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
""",
}
