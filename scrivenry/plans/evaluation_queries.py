"""Queries over retrieval metrics, load statistics, answers and sequential folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parsing, text
from ..operators import answering, context, evaluation, folds, ingest, metrics, retrieval
from ..operators import experiments as experiments_of
from ..operators.collectors import Collectors
from ..operators.experiments import Config
from ..sources.staging import staged
from . import fixtures as fx
from . import search_queries as sq
from .registry import query


def hits(spark, sf):
    """The ranked documents of each question; a hit's pages are one or two numbers."""
    return fx.ranked(spark, sf).withColumn("pages", F.expr("sequence(doc_id % 3 + 1, doc_id % 3 + 1 + doc_id % 2)"))


def wanted(spark, sf, relevant=None):
    return (fx.relevant(spark, sf) if relevant is None else relevant).withColumn("pages", F.expr("if(doc_id % 4 = 0, cast(array() AS array<bigint>), array(doc_id % 3 + 1))"))


def questions(spark, sf, relevant):
    n = relevant.groupBy("qid").agg(F.countDistinct("doc_id").alias("n_relevant"))
    return fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid")).join(n, "qid", "left").select("qid", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))


def judged(spark, sf, relevant=None):
    return metrics.correct_hits(hits(spark, sf), wanted(spark, sf, relevant))


def measured(spark, sf):
    relevant = staged(fx.relevant(spark, sf), "relevant")
    return metrics.question_metrics(judged(spark, sf, relevant), questions(spark, sf, relevant))


_JUDGED = """hits AS (SELECT *, range(doc_id % 3 + 1, doc_id % 3 + 2 + doc_id % 2) AS pages FROM ranked), wanted AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN [] ELSE [doc_id % 3 + 1] END AS pages FROM relevant),
 judged AS (SELECT h.qid, h.doc_id, h.rank, coalesce(bool_or(w.doc_id IS NOT NULL AND (len(w.pages) = 0 OR list_has_any(h.pages, w.pages))), false) AS correct FROM hits h LEFT JOIN wanted w USING (qid, doc_id) GROUP BY h.qid, h.doc_id, h.rank),
 n AS (SELECT b.item_id AS qid, count(DISTINCT r.doc_id) AS n_relevant FROM benchmark b LEFT JOIN relevant r ON r.qid = b.item_id GROUP BY b.item_id)"""


def _metric_sql(k: int) -> str:
    return f"""round(CASE WHEN n_relevant > 0 THEN coalesce(count(rank) FILTER (WHERE rank <= {k}), 0) / n_relevant ELSE 0 END, 6) AS recall_{k},
 round(CASE WHEN n_relevant > 0 THEN coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= {k}), 0) / list_sum(list_transform(range(1, least(n_relevant, {k}) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_{k}"""


_MEASURED = f"""{_JUDGED}, best AS (SELECT qid, doc_id, min(rank) AS rank FROM judged WHERE correct GROUP BY qid, doc_id), m AS (SELECT n.qid, n_relevant, min(rank) AS first_rank, coalesce(round(1 / min(rank), 6), 0) AS rr, {_metric_sql(1)}, {_metric_sql(5)}, {_metric_sql(10)}
 FROM n LEFT JOIN best USING (qid) GROUP BY n.qid, n_relevant)"""


def _s(body: str) -> str:
    return fx.sql(body, "ranked", "relevant")


@query("c09_hit_relevant", _s(f"WITH {_JUDGED} SELECT qid, doc_id, correct FROM judged"))
def c09(spark, sf):
    return judged(spark, sf).select("qid", "doc_id", "correct")


@query("d07_recall_at_k", _s(f"WITH {_MEASURED} SELECT qid, recall_1, recall_5, recall_10 FROM m"))
def d07(spark, sf):
    return measured(spark, sf).select("qid", "recall_1", "recall_5", "recall_10")


@query("d08_reciprocal_rank", _s(f"WITH {_MEASURED} SELECT qid, rr FROM m"))
def d08(spark, sf):
    return measured(spark, sf).select("qid", "rr")


@query("d09_ndcg_at_k", _s(f"WITH {_MEASURED} SELECT qid, ndcg_1, ndcg_5, ndcg_10 FROM m"))
def d09(spark, sf):
    return measured(spark, sf).select("qid", "ndcg_1", "ndcg_5", "ndcg_10")


@query("e03_first_correct_rank", _s(f"WITH {_MEASURED} SELECT qid, first_rank FROM m"))
def e03(spark, sf):
    return measured(spark, sf).select("qid", "first_rank")


@query("e04_document_once", _s(f"WITH {_MEASURED} SELECT qid, doc_id, rank FROM best WHERE rank <= 10"))
def e04(spark, sf):
    return judged(spark, sf).where("correct").groupBy("qid", "doc_id").agg(F.min("rank").alias("rank")).where("rank <= 10")


_MEANS = ", ".join(f"coalesce(round(avg({c}) FILTER (WHERE n_relevant > 0), 4), 0) AS {c}" for c in ("rr", "recall_1", "ndcg_1", "recall_5", "ndcg_5", "recall_10", "ndcg_10"))


@query("d10_retrieval_report", _s(f"WITH {_MEASURED} SELECT count(*) AS questions, count(*) FILTER (WHERE n_relevant > 0) AS answerable, {_MEANS} FROM m"))
def d10(spark, sf):
    return metrics.retrieval_report(measured(spark, sf))


@query("k12_retrieval_evaluation", _s(f"WITH {_MEASURED} SELECT qid % 3 AS slice, count(*) AS questions, count(*) FILTER (WHERE n_relevant > 0) AS answerable, {_MEANS} FROM m GROUP BY 1"))
def k12(spark, sf):
    return metrics.retrieval_report(measured(spark, sf).withColumn("slice", F.col("qid") % 3), ["slice"])


@query("k16_quality_gate", _s(f"WITH {_MEASURED}, r AS (SELECT {_MEANS} FROM m) SELECT 'recall_10' AS metric, recall_10 AS value FROM r WHERE recall_10 < 0.9 UNION ALL SELECT 'rr', rr FROM r WHERE rr < 0.8"))
def k16(spark, sf):
    r = metrics.retrieval_report(measured(spark, sf))
    limits = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(least).alias("least")) for m, least in (("recall_10", 0.9), ("rr", 0.8))))
    return r.select(F.explode(limits).alias("x")).where("x.value < x.least").select("x.metric", "x.value")


_EXPERIMENTS = "ex AS (SELECT 'run' || run AS name, run AS idx, round(avg(latency_s), 4) AS value FROM load_sample GROUP BY run)"


def experiments(spark, sf):
    return fx.load_sample(spark, sf).groupBy(F.col("run").alias("idx")).agg(F.round(F.avg("latency_s"), 4).alias("value")).withColumn("name", F.concat(F.lit("run"), "idx"))


_COMPARED = f"WITH {_EXPERIMENTS} SELECT name, value, round(value - (SELECT value FROM ex WHERE name = 'run1'), 4) AS delta, name = (SELECT name FROM ex ORDER BY value DESC, idx LIMIT 1) AS best FROM ex"


@query("d21_experiment_comparison", fx.sql(_COMPARED, "load_sample"))
def d21(spark, sf):
    return metrics.comparison(experiments(spark, sf), "run1", "value")


_CONFIGS = [
    Config("hybrid"), Config("bm25", ("bm25",)), Config("knn", ("knn",)), Config("hybrid_k1", k=1), Config("hybrid_documents", by_document=True), Config("hybrid_reranked", rerank=20, by_document=True),
]


def _configs_sql() -> str:
    def score(c: Config) -> str:
        return " + ".join(f"coalesce(1 / ({c.k} + r_{leg}), 0)" for leg in c.legs)

    rows = " UNION ALL ".join(
        f"SELECT qid, chunk_id, doc_id, w, '{c.name}' AS name, {i} AS idx, round({score(c)}, 9) AS score, {c.by_document} AS one, {c.rerank} AS head FROM b WHERE coalesce({', '.join(f'r_{leg}' for leg in c.legs)}) IS NOT NULL" for i, c in enumerate(_CONFIGS)
    )
    return f"""b AS (SELECT qid, chunk_id, doc_id, x.rank AS r_bm25, y.rank AS r_knn, len(list_intersect(q.w, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')))) / len(q.w) AS w FROM (SELECT qid, chunk_id, rank FROM l1) x FULL JOIN (SELECT qid, chunk_id, rank FROM l2) y USING (qid, chunk_id)
 JOIN (SELECT chunk_id, doc_id, content FROM chunk) USING (chunk_id) JOIN (SELECT qid, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w FROM question) q USING (qid)), e AS ({rows}),
 f AS (SELECT *, row_number() OVER (PARTITION BY name, qid ORDER BY score DESC, chunk_id) AS r FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY name, qid ORDER BY CASE WHEN r > head THEN 1 ELSE 0 END, CASE WHEN r <= head THEN -w ELSE 0 END, r) AS s FROM f),
 h AS (SELECT *, row_number() OVER (PARTITION BY name, qid, doc_id ORDER BY s) AS nth FROM g), k AS (SELECT name, idx, qid, doc_id, row_number() OVER (PARTITION BY name, qid ORDER BY s) AS rank FROM h WHERE NOT one OR nth = 1),
 z AS (SELECT count(DISTINCT qid) AS n FROM relevant), u AS (SELECT name, qid, min(rank) AS first FROM k JOIN relevant USING (qid, doc_id) WHERE rank <= 10 GROUP BY name, qid), v AS (SELECT k.name, k.idx, round(coalesce(max(t.total), 0) / max(n), 4) AS value FROM (SELECT DISTINCT name, idx FROM k) k LEFT JOIN (SELECT name, sum(1 / first) AS total FROM u GROUP BY name) t ON t.name = k.name, z GROUP BY k.name, k.idx)"""


@query("k14_experiment_matrix", fx.sql(f"WITH {sq._LEGS}, {_configs_sql()} SELECT name, value, round(value - (SELECT value FROM v WHERE name = 'hybrid'), 4) AS delta, name = (SELECT name FROM v ORDER BY value DESC, idx LIMIT 1) AS best FROM v", "chunk_index", "question", "relevant"))
def k14(spark, sf):
    """Six ways to search, from two legs, by the rank of the first document that holds the question's text."""
    rows = sq.words(spark, sf)
    q = fx.question(spark, sf)
    legs = {"bm25": staged(sq.keyword_leg(spark, sf, rows), "bm25"), "knn": staged(sq.vector_leg(spark, sf, rows.rows), "knn")}
    documents = sq.texts_of(spark, sf, legs["bm25"].select("chunk_id").unionByName(legs["knn"].select("chunk_id")), rows).select("chunk_id", "doc_id", "content")
    asked = {leg: found.join(q.select("qid", "query"), "qid") for leg, found in legs.items()}
    pairs = asked["bm25"].select("qid", "chunk_id", "query").unionByName(asked["knn"].select("qid", "chunk_id", "query")).distinct()
    scores = pairs.join(documents, "chunk_id").select("qid", "chunk_id", retrieval.overlap_score(F.col("query"), F.col("content")).alias("overlap"))
    hits = experiments_of.ranked_by(legs, _CONFIGS, documents.select("chunk_id", "doc_id"), scores)
    return experiments_of.matrix(staged(hits, "hits"), staged(fx.relevant(spark, sf), "relevant"), q, "hybrid")


_SUMMARY = """summary AS (SELECT run, count(*) AS requests, round(count(*) / 60, 2) AS rps, round(count(*) FILTER (WHERE status <> 200) / count(*), 4) AS error_rate, round(count(*) FILTER (WHERE status = 200 AND string_split(mode_used, '+')[1] IN ('bm25', 'knn')) / count(*) FILTER (WHERE status = 200), 4) AS fallback_rate,
 quantile_disc(latency_s, 0.5) AS p50, quantile_disc(latency_s, 0.9) AS p90, quantile_disc(latency_s, 0.95) AS p95, quantile_disc(latency_s, 0.99) AS p99, max(latency_s) AS max, quantile_disc(first_byte_s, 0.5) FILTER (WHERE status = 200) AS first_p50, quantile_disc(first_byte_s, 0.95) FILTER (WHERE status = 200) AS first_p95 FROM load_sample GROUP BY run)"""


def summary(spark, sf):
    return metrics.load_summary(fx.load_sample(spark, sf), 60.0, ["run"])


@query("d12_nearest_rank", fx.sql("SELECT run, quantile_disc(latency_s, 0.5) AS p50, quantile_disc(latency_s, 0.95) AS p95, quantile_disc(latency_s, 1.0) AS p100 FROM load_sample GROUP BY run", "load_sample"))
def d12(spark, sf):
    return fx.load_sample(spark, sf).groupBy("run").agg(*(metrics.nearest_rank("latency_s", p).alias(f"p{p}") for p in (50, 95, 100)))


@query("d13_load_summary", fx.sql(f"WITH {_SUMMARY} SELECT * FROM summary", "load_sample"))
def d13(spark, sf):
    return summary(spark, sf)


@query("d13_status_histogram", fx.sql("SELECT status, mode_used, count(*) AS n FROM load_sample GROUP BY status, mode_used", "load_sample"))
def d13h(spark, sf):
    return fx.load_sample(spark, sf).groupBy("status", "mode_used").agg(F.count("*").alias("n"))


@query("d14_slo_check", fx.sql(f"WITH {_SUMMARY} SELECT run, array_to_string(list_filter([CASE WHEN p95 > 4.7 THEN 'p95' END, CASE WHEN error_rate > 0.21 THEN 'error rate' END, CASE WHEN fallback_rate > 0.05 THEN 'fallback rate' END, CASE WHEN first_p95 > 0.09 THEN 'first token p95' END, CASE WHEN run = 7 THEN 'dropped' END], lambda x: x IS NOT NULL), ', ') AS broken FROM summary", "load_sample"))
def d14(spark, sf):
    return summary(spark, sf).withColumn("dropped", F.expr("if(run = 7, 3, 0)")).select("run", metrics.broken_limits(4.7, 0.21, 0.05, 0.09).alias("broken"))


@query("d15_canary", fx.sql(f"WITH {_SUMMARY} SELECT c.run, CASE WHEN c.requests / 60 * (CASE WHEN c.run = 6 THEN 0 ELSE 1 END) < 0.1 THEN 'not enough traffic' ELSE array_to_string(list_filter([CASE WHEN c.error_rate / 10 > least(0.02, greatest(2 * s.error_rate / 20, 0.005)) THEN 'error rate' END, CASE WHEN c.p95 > least(2.5, greatest(1.5 * s.p95, 0.05)) THEN 'p95' END, CASE WHEN c.fallback_rate > 0.05 THEN 'fallback rate' END], lambda x: x IS NOT NULL), ', ') END AS problems FROM summary c, (SELECT * FROM summary WHERE run = 1) s", "load_sample"))
def d15(spark, sf):
    one = summary(spark, sf)
    stable = one.where("run = 1").selectExpr("error_rate / 20 AS s_error", "p95 AS s_p95")
    both = one.crossJoin(F.broadcast(stable)).selectExpr("run", "requests / 60 * if(run = 6, 0, 1) AS c_rps", "error_rate / 10 AS c_error", "p95 AS c_p95", "fallback_rate AS c_fallback", "s_error", "s_p95")
    return both.select("run", metrics.canary_problems().alias("problems"))


_BUCKETS = "CASE " + " ".join(f"WHEN x <= {e} THEN {e}" for e in metrics.EDGES[:-1]) + " ELSE 'inf'::DOUBLE END"


@query("d16_histogram_quantile", fx.sql(f"""WITH h AS (SELECT run, {_BUCKETS} AS edge, count(*) AS n FROM (SELECT run, latency_s / 2 AS x FROM load_sample) GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY run ORDER BY edge) AS cum, sum(n) OVER (PARTITION BY run) AS total, coalesce(lag(edge) OVER (PARTITION BY run ORDER BY edge), 0) AS low FROM h)
 SELECT run, round(CASE WHEN edge = 'inf'::DOUBLE THEN low ELSE low + (edge - low) * (0.95 * total - (cum - n)) / n END, 6) AS value FROM c WHERE cum >= 0.95 * total QUALIFY row_number() OVER (PARTITION BY run ORDER BY edge) = 1""", "load_sample"))
def d16(spark, sf):
    counts = fx.load_sample(spark, sf).groupBy("run", metrics.bucket(F.col("latency_s") / 2).alias("edge")).agg(F.count("*").alias("n"))
    return metrics.histogram_quantile(counts, "run", 0.95)


@query("d16_event_rates", "SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_ratio FROM events GROUP BY 1")
def d16r(spark, sf):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    e = fx.table(spark, sf, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.round(F.count(F.when(F.col("event_type") == "error", 1)) / F.count("*"), 6).alias("error_ratio"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "error_ratio")


_SAMPLES = """raw AS (SELECT user_id % 40 AS series, floor(epoch(ts))::BIGINT AS sec, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 9 AS up, event_id % 50 = 0 AS again FROM events),
 samples AS (SELECT series, sec, event_id, sum(up) OVER (PARTITION BY series, lives ORDER BY event_id) AS value FROM (SELECT *, sum(again::INT) OVER (PARTITION BY series ORDER BY event_id) AS lives FROM raw))"""


def counter_samples(spark, sf):
    """Counters made of events, one for each of 40 groups of users; every fiftieth event has its counter start again."""
    raw = fx.table(spark, sf, "events").selectExpr("user_id % 40 AS series", "bigint(unix_timestamp(cast(ts AS timestamp))) AS at", "event_id", "bigint(get_json_object(props, '$.k')) % 9 AS up", "event_id % 50 = 0 AS again")
    lives = raw.withColumn("lives", F.sum(F.col("again").cast("int")).over(Window.partitionBy("series").orderBy("event_id")))
    return lives.withColumn("value", F.sum("up").over(Window.partitionBy("series", "lives").orderBy("event_id"))).select("series", "at", "value")


@query("d16_counter_rates", f"""WITH {_SAMPLES}, once AS (SELECT series, sec, max(value)::DOUBLE AS value FROM samples GROUP BY series, sec), w AS (SELECT series, sec, value, unnest(range(sec // 43200 * 43200 - 43200, sec // 43200 * 43200 + 1, 43200)) AS start FROM once),
 p AS (SELECT *, lag(value) OVER (PARTITION BY series, start ORDER BY sec) AS last FROM w), g AS (SELECT series, start, count(*) AS n, min(sec)::DOUBLE AS t0, max(sec)::DOUBLE AS t1, arg_min(value, sec) AS v0, arg_max(value, sec) - arg_min(value, sec) + sum(CASE WHEN value < last THEN last ELSE 0 END) AS grown FROM p GROUP BY series, start HAVING count(*) > 1),
 m AS (SELECT *, t1 - t0 AS spread, (t1 - t0) / (n - 1) AS mean FROM g), e AS (SELECT *, least(CASE WHEN t0 - start < 1.1 * mean THEN t0 - start ELSE mean / 2 END, CASE WHEN grown > 0 THEN spread * v0 / grown ELSE 'inf'::DOUBLE END) AS low, CASE WHEN start + 86400 - t1 < 1.1 * mean THEN start + 86400 - t1 ELSE mean / 2 END AS high FROM m)
 SELECT series, start, n AS samples, round(grown * (spread + low + high) / spread, 4) AS increase, round(grown * (spread + low + high) / spread / 86400, 8) AS rate FROM e""")
def d16_rates(spark, sf):
    """Increase and rate of the counters over a day, every twelve hours."""
    found = metrics.counter_rates(counter_samples(spark, sf), 86_400, 43_200, ["series"])
    return found.select("series", "start", "samples", F.round("increase", 4).alias("increase"), F.round("rate", 8).alias("rate"))


@query("d19_histogram_buckets", fx.sql(f"SELECT edge, count(*) AS n FROM (SELECT {_BUCKETS} AS edge FROM (SELECT latency_s AS x FROM load_sample)) WHERE edge <> 'inf'::DOUBLE GROUP BY edge", "load_sample"))
def d19(spark, sf):
    return fx.load_sample(spark, sf).groupBy(metrics.bucket(F.col("latency_s")).alias("edge")).agg(F.count("*").alias("n")).where(F.col("edge") < float("inf"))


@query("d19_observed_buckets", fx.sql(f"SELECT edge, count(*) AS n FROM (SELECT {_BUCKETS} AS edge FROM (SELECT latency_s AS x FROM load_sample)) WHERE edge <> 'inf'::DOUBLE GROUP BY edge", "load_sample"))
def d19_observed(spark, sf):
    """The same counts as a by-product of a job that writes the samples."""
    seen = Collectors("load").histogram("latency", F.col("latency_s")).counter("failed", F.col("status") != 200)
    staged(seen.watch(fx.load_sample(spark, sf)), "samples")
    return spark.createDataFrame([x for x in seen.buckets("latency") if x[1] and x[0] < float("inf")], "edge double, n long")


@query("d22_usage_totals", "SELECT role, sum((length(text) + 3) // 4)::BIGINT AS tokens FROM conversations GROUP BY role")
def d22(spark, sf):
    return metrics.usage_totals(fx.table(spark, sf, "conversations"), "role")


@query("d06_repeated_edges", fx.sql("""WITH f AS (SELECT doc_id, page_no, list_filter(string_split(page, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM src_page), i AS (SELECT doc_id, page_no, l, len(l) AS n, unnest(range(1, len(l) + 1)) AS i FROM f),
 e AS (SELECT doc_id, page_no, regexp_replace(lower(regexp_replace(trim(l[i]), '\\s+', ' ', 'g')), '\\d+', '#', 'g') AS k FROM i WHERE i <= least(3, n // 3) OR i > n - least(3, n // 3)), n AS (SELECT doc_id, count(*) AS pages FROM src_page GROUP BY doc_id)
 SELECT doc_id, sha256(k) AS digest, count(DISTINCT page_no) AS n FROM e JOIN n USING (doc_id) WHERE pages >= 4 GROUP BY doc_id, k, pages HAVING count(DISTINCT page_no) >= greatest(2, 0.4 * pages)""", "src_page"))
def d06(spark, sf):
    from ..functions.normalize import repeated_edges, with_edges

    return repeated_edges(with_edges(fx.src_page(spark, sf))).select("doc_id", F.sha2("key", 256).alias("digest"), "n")


@query("e09_edge_lines", fx.sql("SELECT doc_id, page_no, i - 1 AS line_no FROM (SELECT doc_id, page_no, len(l) AS n, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, page_no, list_filter(string_split(page, chr(10)), lambda x: trim(x) <> '') AS l FROM src_page)) WHERE i <= least(2, n // 3) OR i > n - least(2, n // 3)", "src_page"))
def e09(spark, sf):
    from ..functions.normalize import edge_lines

    return edge_lines(fx.src_page(spark, sf), 2).select("doc_id", "page_no", "line_no")


@query("h48_judge_scores", "SELECT event_id, round(CASE WHEN k % 5 = 0 THEN NULL ELSE least(k % 7, 6) / 6 END, 6) AS faithfulness, CASE WHEN k % 6 = 0 THEN NULL ELSE (k % 6 - 1) / 4 END AS relevance FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def h48(spark, sf):
    said = F.expr("concat('Scores: {\"supported\": ', k % 7, ', \"total\": ', if(k % 5 = 0, 0, 6), ', \"score\": ', k % 6, '}')")
    e = fx.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).withColumn("said", said)
    return e.select("event_id", F.round(parsing.faithfulness(F.col("said")), 6).alias("faithfulness"), parsing.relevance(F.col("said")).alias("relevance"))


_ANS = "a AS (SELECT conv_id, turn, answer, trim(answer, ' .') = 'NOT_FOUND' AS nf, CAST(regexp_extract(answer, '\\[(\\d{1,3})\\]', 1) AS VARCHAR) AS ref FROM answer_text)"


def answers(spark, sf):
    return fx.answer_text(spark, sf)


@query("k09_citation_check", fx.sql(f"WITH {_ANS} SELECT conv_id, turn, sha256(trim(regexp_replace(CASE WHEN CAST(nullif(ref, '') AS INTEGER) > 3 THEN replace(answer, '[' || ref || ']', '') ELSE answer END, '[ \\t]{{2,}}', ' ', 'g'))) AS digest, coalesce(CAST(nullif(ref, '') AS INTEGER) > 3, false) AS invalid, nf OR CAST(nullif(ref, '') AS INTEGER) > 3 AS uncited FROM a", "answer_text"))
def k09(spark, sf):
    refs = text.citation_refs(F.col("answer"))
    good, bad = F.filter(refs, lambda r: r <= 3), F.filter(refs, lambda r: r > 3)
    cleaned = text.without_refs_over(F.col("answer"), F.lit(3))
    return answers(spark, sf).select("conv_id", "turn", F.sha2(cleaned, 256).alias("digest"), (F.size(bad) > 0).alias("invalid"), (F.size(good) == 0).alias("uncited"))


@query("k08_answer_finish", fx.sql(f"WITH {_ANS} SELECT conv_id, turn, CASE WHEN nf THEN 'not_found' WHEN regexp_matches(answer, 'ing the', 'i') THEN 'blocked' WHEN CAST(nullif(ref, '') AS INTEGER) > 3 THEN 'unverified' ELSE 'answered' END AS reason FROM a", "answer_text"))
def k08(spark, sf):
    cited = F.size(F.filter(text.citation_refs(F.col("answer")), lambda r: r <= 3)) > 0
    reason = F.when(text.is_not_found(F.col("answer")), "not_found").when(text.matches_any(F.col("answer"), ["ing the"]), "blocked").when(~cited, "unverified").otherwise("answered")
    return answers(spark, sf).select("conv_id", "turn", reason.alias("reason"))


@query("b16_score_gate", fx.sql(f"WITH {sq._RERANKED} SELECT qid, coalesce(max(CASE WHEN rank <= 20 THEN s END) >= 0.6, false) OR qid % 3 = 0 AS passes FROM sc GROUP BY qid", "chunk_index", "question"))
def b16(spark, sf):
    """Whether each question's best reranked hit has a score to answer from; where the reranker failed there is no such score to ask for."""
    hits = sq.scored_hits(spark, sf, 50).where("rank <= 20").groupBy("qid").agg(F.max("rerank_score").alias("score"))
    top = hits.withColumn("mode_used", F.when(F.col("qid") % 3 == 0, "hybrid").otherwise("hybrid+rerank"))
    return top.select("qid", answering.passes_gate(F.col("mode_used"), F.col("score"), 0.6).alias("passes"))


def passages(spark, sf):
    return sq.hybrid_texts(spark, sf, 24, "doc_id", "item_id", "page_no", "content")


_CONTEXT = f"""{sq._LEGS}, {sq._TOP.format(n=24)}, hc AS (SELECT qid, rank, doc_id, chunk_id, page_no, content, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM top JOIN (SELECT chunk_id, doc_id, page_no, content FROM chunk) USING (chunk_id)),
 sh AS (SELECT qid, rank, doc_id, chunk_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM hc),
 nr AS (SELECT a.qid, a.rank, a.doc_id, list(b.rank) FILTER (WHERE a.rank <> b.rank AND len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.85e0) AS near FROM sh a JOIN sh b USING (qid) GROUP BY a.qid, a.rank, a.doc_id),
 ls AS (SELECT qid, list([{{'rank': rank, 'doc_id': doc_id, 'near': coalesce(near, [])}}] ORDER BY rank) AS h FROM nr GROUP BY qid),
 f1 AS (SELECT qid, h, list_reduce(h, lambda a, x: CASE WHEN list_contains(list_transform(a, lambda t: t.doc_id), x[1].doc_id) OR list_has_any(list_transform(a, lambda t: t.rank), x[1].near) THEN a ELSE list_concat(a, x) END) AS a FROM ls),
 f2 AS (SELECT qid, list_sort(list_reduce(list_concat([a], h), lambda a, x: CASE WHEN len(a) >= 8 OR list_contains(list_transform(a, lambda t: t.rank), x[1].rank) OR len(list_filter(a, lambda t: t.doc_id = x[1].doc_id)) >= 3 OR list_has_any(list_transform(a, lambda t: t.rank), x[1].near) THEN a ELSE list_concat(a, x) END)[1:8]) AS a FROM f1),
 ctx AS (SELECT qid, ref, rank, doc_id, chunk_id, page_no, content, w FROM (SELECT qid, unnest(range(1, len(a) + 1)) AS ref, unnest(list_transform(a, lambda t: t.rank)) AS rank FROM f2) JOIN hc USING (qid, rank))"""


@query("k06_context_selection", fx.sql(f"WITH {_CONTEXT} SELECT qid, ref, chunk_id FROM ctx", "chunk_index", "question"))
def k06(spark, sf):
    return context.select_context(passages(spark, sf)).select("qid", "ref", "chunk_id")


#: Prompts to compare, as what the stand-in for a model makes of them: the least share of the question's words for a passage to be used, how
#: many passages are, and whether they are cited by their number in the context or by their rank among the hits.
_PROMPTS = [("p0", 0.3, 8, False), ("p1", 0.6, 8, False), ("p2", 0.3, 1, False), ("p3", 0.3, 8, True)]


def contexts(spark, sf):
    """The numbered passages of each question, with the share of the question's words that they hold."""
    hits = staged(passages(spark, sf), "hits")
    chosen = context.select_context(hits).join(hits.select("qid", "chunk_id", "page_no"), ["qid", "chunk_id"]).join(fx.question(spark, sf).select("qid", "query"), "qid")
    return staged(chosen.select("qid", "ref", "rank", "doc_id", F.array("page_no").alias("pages"), "content", retrieval.overlap_score(F.col("query"), F.col("content")).alias("share")), "contexts")


def written_answers(spark, sf, ctx):
    """(name, qid, answer, said): what each prompt's stand-in writes from a context, extracts with references, and what a judge by word overlap says of it."""
    prompts = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(least).alias("least"), F.lit(most).alias("most"), F.lit(by_rank).alias("by_rank")) for n, least, most, by_rank in _PROMPTS)))
    used = ctx.select("*", prompts.alias("p")).select("*", "p.*").where("share >= least").withColumn("nth", F.row_number().over(Window.partitionBy("name", "qid").orderBy("ref"))).where("nth <= most")
    extract = F.expr("concat(trim(substring(content, 1, 80)), ' [', if(by_rank, rank, ref), ']')")
    told = used.groupBy("name", "qid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", extract.alias("x")))), lambda x: x["x"]), " ").alias("text"), F.count(F.when(F.col("share") >= 0.5, 1)).alias("supported"), F.count("*").alias("total"),
        (1 + F.floor(4 * F.max("share"))).alias("score"),
    )
    asked = fx.question(spark, sf).select("qid", prompts.alias("p")).select("qid", "p.name")
    said = F.expr("""concat('The scores: {"supported": ', supported, ', "total": ', total, ', "score": ', score, '}')""")
    return asked.join(told, ["name", "qid"], "left").select("name", "qid", F.coalesce("text", F.lit("NOT_FOUND")).alias("answer"), said.alias("said"))


def relevant_pages(spark, sf):
    """(qid, doc_id, pages): the documents that hold a question's text, and those of their pages that hold all of it."""
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    # Which documents these are is written, so that its size is known: while they are few, they go to the pages.
    pages = staged(fx.relevant(spark, sf), "relevant").join(fx.src_page(spark, sf).select("doc_id", "page_no", "page"), "doc_id").join(items, "qid")
    return pages.groupBy("qid", "doc_id").agg(F.collect_list(F.when(F.contains("page", "text"), F.col("page_no"))).alias("pages"))


_WRITTEN = f"""{_CONTEXT}, qw AS (SELECT qid, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w FROM question), cs2 AS (SELECT c.qid, ref, rank, doc_id, page_no, content, CASE WHEN len(q.w) = 0 THEN 0 ELSE len(list_intersect(q.w, list_distinct(c.w))) / len(q.w) END AS share FROM ctx c JOIN qw q USING (qid)),
 pr(name, least, most, by_rank) AS (VALUES {", ".join(f"('{n}', {least}e0, {most}, {by_rank})" for n, least, most, by_rank in _PROMPTS)}),
 used AS (SELECT *, row_number() OVER (PARTITION BY name, qid ORDER BY ref) AS nth FROM cs2, pr WHERE share >= least QUALIFY nth <= most),
 told AS (SELECT name, qid, string_agg(trim(substr(content, 1, 80)) || ' [' || CASE WHEN by_rank THEN rank ELSE ref END || ']', ' ' ORDER BY ref) AS x, count(*) FILTER (WHERE share >= 0.5e0) AS supported, count(*) AS total, 1 + floor(4 * max(share)) AS score FROM used GROUP BY name, qid),
 ans AS (SELECT pr.name, q.qid, coalesce(x, 'NOT_FOUND') AS answer, supported / total AS faithfulness, (score - 1) / 4 AS relevance FROM question q CROSS JOIN pr LEFT JOIN told t ON t.name = pr.name AND t.qid = q.qid),
 cited AS (SELECT DISTINCT name, a.qid, r AS ref, c.ref IS NOT NULL AS known, doc_id, page_no FROM (SELECT name, qid, unnest(regexp_extract_all(answer, '\\[(\\d{{1,3}})\\]', 1))::BIGINT AS r FROM ans) a LEFT JOIN ctx c ON c.qid = a.qid AND c.ref = a.r)"""
_CORRECT = f"""{_WRITTEN}, rp AS (SELECT r.qid, r.doc_id, coalesce(list(p.page_no) FILTER (WHERE contains(p.page, b.text)), []) AS pages FROM relevant r JOIN benchmark b ON b.item_id = r.qid JOIN (SELECT doc_id, page_no, page FROM src_page) p ON p.doc_id = r.doc_id GROUP BY r.qid, r.doc_id),
 judged AS (SELECT name, c.qid, ref, c.doc_id, rp.qid IS NOT NULL AND (len(rp.pages) = 0 OR list_contains(rp.pages, page_no)) AS correct FROM cited c LEFT JOIN rp ON rp.qid = c.qid AND rp.doc_id = c.doc_id WHERE known)"""
_OUTCOMES = f"""{_CORRECT}, oc AS (SELECT a.name, a.qid, a.qid IN (SELECT qid FROM relevant) AS answerable, trim(answer, ' .') = 'NOT_FOUND' OR coalesce(n, 0) = 0 AS refused, coalesce(n, 0) AS cited, coalesce(good, 0) AS correct, faithfulness, relevance
 FROM ans a LEFT JOIN (SELECT name, qid, count(*) AS n, count(*) FILTER (WHERE correct) AS good FROM judged GROUP BY name, qid) j ON j.name = a.name AND j.qid = a.qid)"""
_REPORT = "round(avg(faithfulness) FILTER (WHERE answerable AND NOT refused), 4) AS faithfulness, round(avg(relevance) FILTER (WHERE answerable AND NOT refused), 4) AS relevance, round(sum(correct) FILTER (WHERE answerable AND NOT refused) / nullif(sum(cited) FILTER (WHERE answerable AND NOT refused), 0), 4) AS citation_accuracy, round(avg(CASE WHEN NOT answerable THEN refused::INT END), 4) AS not_found_accuracy, round(avg(CASE WHEN answerable THEN refused::INT END), 4) AS false_refusal"


def _a(body: str) -> str:
    return fx.sql(body, "chunk_index", "question", "relevant")


@query("c10_citation_context", _a(f"WITH {_WRITTEN} SELECT name, qid, ref, known FROM cited"))
def c10(spark, sf):
    """References of each prompt's answers against the contexts that they were written from."""
    ctx = contexts(spark, sf)
    return evaluation.cited_sources(written_answers(spark, sf, ctx), ctx).select("name", "qid", "ref", "known")


@query("c11_cited_relevant", _a(f"WITH {_CORRECT} SELECT name, qid, ref, doc_id, correct FROM judged"))
def c11(spark, sf):
    ctx = contexts(spark, sf)
    return evaluation.correct_citations(evaluation.cited_sources(written_answers(spark, sf, ctx), ctx), relevant_pages(spark, sf))


def outcomes(spark, sf):
    ctx = contexts(spark, sf)
    return evaluation.answer_outcomes(written_answers(spark, sf, ctx), ctx, relevant_pages(spark, sf))


@query("d11_answer_report", _a(f"WITH {_OUTCOMES} SELECT 'all' AS name, {_REPORT} FROM oc"))
def d11(spark, sf):
    return metrics.answer_report(outcomes(spark, sf).withColumn("name", F.lit("all")), "name")


@query("k13_answer_evaluation", _a(f"WITH {_OUTCOMES} SELECT name, {_REPORT} FROM oc GROUP BY name"))
def k13(spark, sf):
    return metrics.answer_report(outcomes(spark, sf), "name")


@query("k15_prompt_comparison", _a(f"WITH {_OUTCOMES}, v AS (SELECT name, right(name, 1)::INT AS idx, citation_accuracy AS value FROM (SELECT name, {_REPORT} FROM oc GROUP BY name)) SELECT name, value, round(value - (SELECT value FROM v WHERE name = 'p0'), 4) AS delta, name = (SELECT name FROM v ORDER BY value DESC, idx LIMIT 1) AS best FROM v"))
def k15(spark, sf):
    r = metrics.answer_report(outcomes(spark, sf), "name").select("name", F.expr("int(right(name, 1))").alias("idx"), F.col("citation_accuracy").alias("value"))
    return metrics.comparison(r, "p0", "value")


@query("k07_context_budget")
def k07(spark, sf):
    labels = fx.chunk(spark, sf).select("chunk_id", text.context_label(F.col("item_id"), F.lit(""), F.col("page_no"), F.col("page_no")).alias("label"))
    return context.budgeted(context.select_context(passages(spark, sf)).join(labels, "chunk_id"), 400)


@query("k08_answer_prepare")
def k08_prepare(spark, sf):
    """Context and prompt of each question from its reranked hits; where the best of them has little to do with the question there is none."""
    found = retrieval.reranked(sq.scored_hits(spark, sf, 24), 24).join(fx.chunk(spark, sf).select("chunk_id", "item_id", "page_no"), "chunk_id")
    found = found.withColumn("mode_used", F.lit("hybrid+rerank")).withColumn("score", F.col("rerank_score"))
    hits = found.withColumn("label", text.context_label(F.col("item_id"), F.lit(""), F.col("page_no"), F.col("page_no")))
    out = answering.prepared(hits, fx.question(spark, sf), "Context:\n{{context}}\n\nQuestion: {{question}}", least=0.6, budget=400)
    return out.select("qid", F.sha2("prompt", 256).alias("prompt"), F.coalesce(F.size("refs"), F.lit(0)).alias("n_refs"), "reason")


@query("k17_load_schedule", "SELECT n AS number, n / 4 AS due_s, qid FROM range(480) r(n) JOIN (SELECT item_id AS qid, row_number() OVER (ORDER BY item_id) - 1 AS turn, count(*) OVER () AS size FROM benchmark) ON n % size = turn")
def k17(spark, sf):
    return metrics.load_schedule(fx.question(spark, sf).select("qid", "query"), 4.0, 120.0).select("number", "due_s", "qid")


@query("h25_safe_error", "SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN event_type || ': ' || user_id ELSE event_type END AS shown FROM events")
def h25(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", ingest.safe_error(F.col("event_type"), F.col("user_id").cast("string"), ["error", "view"]).alias("shown"))


@query("e07_rate_limit")
def e07(spark, sf):
    return folds.rate_limited(fx.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"), "event_id"), limit=2, window=3600)


@query("e13_breaker")
def e13(spark, sf):
    return folds.breaker(fx.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"), "event_id", (F.col("event_type") != "error").alias("ok")))


@query("e14_adaptive_limit")
def e14(spark, sf):
    return folds.adaptive_limit(fx.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"), "event_id", (F.col("event_type") != "error").alias("ok")))


@query("e15_token_bucket")
def e15(spark, sf):
    return folds.token_bucket(fx.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"), "event_id", (F.col("value") + 1).alias("cost")), rate=0.01, burst=50.0)


@query("f09_page_cap", "SELECT doc_id, least(50, doc_id % 80 + 1) AS n FROM documents")
def f09(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.size(text.page_list(F.lit(1), F.expr("doc_id % 80 + 1"))).cast("long").alias("n"))
