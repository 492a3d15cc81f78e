"""Metrics of retrieval, answers, load and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper edges of the latency histogram.
EDGES = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf")]


def correct_hits(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """Hits (qid, doc_id, pages, rank) with ``correct``: a relevant (qid, doc_id, pages) names the document and, if it has pages, one of the hit's."""
    found = hits.join(relevant.select("qid", "doc_id", F.col("pages").alias("wanted")), ["qid", "doc_id"]).where((F.size("wanted") == 0) | F.arrays_overlap("pages", "wanted"))
    keys = found.select("qid", "doc_id", "rank").distinct().withColumn("correct", F.lit(True))
    return hits.join(keys, ["qid", "doc_id", "rank"], "left").withColumn("correct", F.coalesce("correct", F.lit(False)))


def question_metrics(hits: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per question (qid, n_relevant): first correct rank, reciprocal rank, recall and nDCG at each k.

    ``hits`` has qid, doc_id, rank, correct. A document counts once, at its best rank; the ideal ranking has all relevant documents first.
    """
    best = hits.where("correct").groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    at_k = [F.count(F.when(F.col("rank") <= k, 1)).alias(f"hit_{k}") for k in ks]
    gain = [F.coalesce(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias(f"dcg_{k}") for k in ks]
    per = best.groupBy("qid").agg(F.min("rank").alias("first_rank"), *at_k, *gain)
    j = questions.join(per, "qid", "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = [F.coalesce(F.round(F.when(F.col("n_relevant") > 0, x), 6), F.lit(0.0)).alias(n) for k in ks for n, x in ((f"recall_{k}", F.col(f"hit_{k}") / F.col("n_relevant")), (f"ndcg_{k}", F.col(f"dcg_{k}") / ideal(k)))]
    return j.select("qid", "n_relevant", "first_rank", F.coalesce(F.round(1 / F.col("first_rank"), 6), F.lit(0.0)).alias("rr"), *out)


def retrieval_report(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over the answerable questions, four decimals; 0 without any."""
    names = [c for c in metrics.columns if c.startswith(("recall_", "ndcg_", "rr"))]
    means = [F.coalesce(F.round(F.avg(F.when(F.col("n_relevant") > 0, F.col(c))), 4), F.lit(0.0)).alias(c) for c in names]
    return metrics.groupBy(*(by or [])).agg(F.count("*").alias("questions"), F.count(F.when(F.col("n_relevant") > 0, 1)).alias("answerable"), *means)


def nearest_rank(column: str, percent: float) -> Column:
    """The value at rank ceil(p / 100 * n), at least 1, of the sorted values."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {column})")


def load_summary(samples: DataFrame, duration_s: float, by: list[str]) -> DataFrame:
    """Requests, rates and latency percentiles of each run; failed requests count in latencies."""
    ok = F.col("status").between(200, 299)
    fallback = ok & F.substring_index("mode_used", "+", 1).isin("bm25", "knn")
    n = F.count("*")
    n_ok = F.count(F.when(ok, 1))
    return samples.withColumn("_first", F.when(ok, F.col("first_byte_s"))).groupBy(*by).agg(
        n.alias("requests"), F.round(n / duration_s, 2).alias("rps"), F.round((n - n_ok) / n, 4).alias("error_rate"), F.when(n_ok > 0, F.round(F.count(F.when(fallback, 1)) / n_ok, 4)).otherwise(0.0).alias("fallback_rate"),
        *(nearest_rank("latency_s", p).alias(f"p{p}") for p in (50, 90, 95, 99)), F.max("latency_s").alias("max"), nearest_rank("_first", 50).alias("first_p50"), nearest_rank("_first", 95).alias("first_p95"),
    )


def broken_limits(p95: float, errors: float, fallbacks: float, first_p95: float) -> Column:
    """The limits that a summary breaks, joined."""
    first = F.coalesce(F.col("first_p95") > first_p95, F.lit(True))
    found = F.array(F.when(F.col("p95") > p95, "p95"), F.when(F.col("error_rate") > errors, "error rate"), F.when(F.col("fallback_rate") > fallbacks, "fallback rate"), F.when(first, "first token p95"), F.when(F.coalesce(F.col("dropped") > 0, F.lit(False)), "dropped"))
    return F.array_join(F.filter(found, lambda x: x.isNotNull()), ", ")


def canary_problems() -> Column:
    """Reasons against a canary (c_rps, c_error, c_p95, c_fallback) beside the stable release (s_error, s_p95), joined."""
    error = F.least(F.lit(0.02), F.greatest(2 * F.col("s_error"), F.lit(0.005)))
    slow = F.least(F.lit(2.5), F.greatest(1.5 * F.col("s_p95"), F.lit(0.05)))
    found = F.array(F.when(F.col("c_error") > error, "error rate"), F.when(F.col("c_p95") > slow, "p95"), F.when(F.col("c_fallback") > 0.05, "fallback rate"))
    return F.when(F.coalesce(F.col("c_rps") < 0.1, F.lit(True)), "not enough traffic").otherwise(F.array_join(F.filter(found, lambda x: x.isNotNull()), ", "))


def bucket(value: Column) -> Column:
    """The upper edge of the histogram bucket that a value falls in."""
    out = F.lit(EDGES[-1])
    for edge in reversed(EDGES[:-1]):
        out = F.when(value <= edge, edge).otherwise(out)
    return out


def histogram_quantile(counts: DataFrame, by: str, q: float) -> DataFrame:
    """(by, value): the quantile interpolated inside its bucket, from (by, edge, n) with n not cumulative."""
    w = Window.partitionBy(by).orderBy("edge")
    c = counts.withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(by))).withColumn("low", F.coalesce(F.lag("edge").over(w), F.lit(0.0)))
    at = c.where(F.col("cum") >= q * F.col("total")).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    inside = F.col("low") + (F.col("edge") - F.col("low")) * (q * F.col("total") - (F.col("cum") - F.col("n"))) / F.col("n")
    return at.select(by, F.round(F.when(F.col("edge") == float("inf"), F.col("low")).otherwise(inside), 6).alias("value"))


def comparison(experiments: DataFrame, baseline: str, metric: str) -> DataFrame:
    """Each experiment's metric, its difference from the baseline's, and whether it is the best (ties to the earlier one)."""
    base = experiments.where(F.col("name") == baseline).select(F.col(metric).alias("b"))
    best = experiments.agg(F.max_by("name", F.struct(metric, -F.col("idx"))).alias("best"))
    return experiments.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(best)).select("name", metric, F.round(F.col(metric) - F.col("b"), 4).alias("delta"), (F.col("name") == F.col("best")).alias("best"))


def answer_report(outcomes: DataFrame, by: str) -> DataFrame:
    """Per group: mean faithfulness and relevance, micro citation accuracy, right and false refusals; null where nothing is measured.

    The first three are of answers to answerable questions that weren't refused.
    """
    answered = F.col("answerable") & ~F.col("refused")
    of = lambda c: F.when(answered, F.col(c))
    right = F.avg(F.when(~F.col("answerable"), F.col("refused").cast("int")))
    false = F.avg(F.when(F.col("answerable"), F.col("refused").cast("int")))
    return outcomes.groupBy(by).agg(
        F.round(F.avg(of("faithfulness")), 4).alias("faithfulness"), F.round(F.avg(of("relevance")), 4).alias("relevance"), F.round(F.sum(of("correct")) / F.nullif(F.sum(of("cited")), F.lit(0)), 4).alias("citation_accuracy"),
        F.round(right, 4).alias("not_found_accuracy"), F.round(false, 4).alias("false_refusal"),
    )


def load_schedule(queries: DataFrame, rate: float, seconds: float, order: str = "qid") -> DataFrame:
    """(number, due_s, and the query's columns): an open-loop load of ``rate`` requests a second, whatever the answers take.

    Queries come round in the order of ``order``; the list of them is a stated set, the schedule of any length is made where it
    is used.
    """
    if rate <= 0 or seconds <= 0:
        raise ValueError("rate and duration must be positive")
    from .ingest import numbered

    turns = numbered(queries, order)
    n = turns.count()
    if not n:
        raise ValueError("no questions to send")
    slots = queries.sparkSession.range(int(rate * seconds)).select(F.col("id").alias("number"), (F.col("id") / rate).alias("due_s"), (F.col("id") % n + 1).alias("turn"))
    return slots.join(turns, "turn").drop("turn")


def in_flight(requests: DataFrame, most: int) -> DataFrame:
    """Requests (number, due_s, took_s) with ``waiting``, how many earlier ones still run when one is due, and ``dropped``.

    A request is dropped when ``most`` or more are running; what would have been dropped before is counted as sent, so
    the figure is the load's demand.
    """
    ends = requests.select(F.col("due_s").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("change"), "number").unionByName(requests.select((F.col("due_s") + F.col("took_s")).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("change"), "number"))
    from .ingest import numbered

    # Running totals over ranges: a range begins with the sum of the ranges before it.
    placed = numbered(ends, "at", "kind", "number").withColumn("block", F.floor((F.col("turn") - 1) / 65_536))
    sums = placed.groupBy("block").agg(F.sum("change").alias("s"))
    before = sums.join(sums.select(F.col("block").alias("b"), F.col("s").alias("t")), F.col("b") < F.col("block"), "left").groupBy("block").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("before"))
    running = F.col("before") + F.sum("change").over(Window.partitionBy("block").orderBy("turn"))
    found = placed.join(F.broadcast(before), "block").withColumn("waiting", running - 1).where("kind = 1").select("number", "waiting")
    return requests.join(found, "number").withColumn("dropped", F.col("waiting") >= most)


def counter_rates(samples: DataFrame, over: int, step: int, by: list[str]) -> DataFrame:
    """(by…, start, samples, increase, rate) of counters in windows of ``over`` seconds, one every ``step``.

    ``samples`` has the columns of ``by``, ``at`` in seconds and ``value``. A value below the one before it is a reset: the counter began
    again at 0. What the first and the last sample leave open towards the window's edges is extrapolated by the mean distance of
    samples: all of it where it is less than 1.1 of that distance, half of the distance otherwise, and never further back than where the
    counter would have been 0. Windows with fewer than two samples are left out; of samples at one time the highest counts. A window's
    samples meet in one row: there are as many as ``over`` holds, however long a series is.
    """
    if over < step or over % step:
        raise ValueError("a window is a whole number of steps")
    first = (F.floor(F.col("at") / step) * step).cast("long")
    starts = F.sequence(first - (over - step), first, F.lit(step).cast("long"))
    once = samples.groupBy(*by, "at").agg(F.max("value").cast("double").alias("value"))
    held = once.select(*by, F.explode(starts).alias("start"), F.col("at").cast("double").alias("at"), "value").groupBy(*by, "start").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("s"))
    resets = F.aggregate("s", F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("lost")), lambda a, x: F.struct(x["value"].alias("last"), (a["lost"] + F.when(x["value"] < a["last"], a["last"]).otherwise(0.0)).alias("lost")), lambda a: a["lost"])
    head, tail = F.get("s", F.lit(0)), F.element_at("s", -1)
    raw = held.where(F.size("s") > 1).select(*by, "start", F.size("s").cast("long").alias("samples"), head["at"].alias("t0"), head["value"].alias("v0"), tail["at"].alias("t1"), (tail["value"] - head["value"] + resets).alias("grown"))
    spread = F.col("t1") - F.col("t0")
    mean = spread / (F.col("samples") - 1)
    edge = lambda gap: F.when(gap < 1.1 * mean, gap).otherwise(mean / 2)
    to_zero = F.when(F.col("grown") > 0, spread * F.col("v0") / F.col("grown"))
    before = F.least(edge(F.col("t0") - F.col("start")), F.coalesce(to_zero, F.lit(float("inf"))))
    increase = F.col("grown") * (spread + before + edge(F.col("start") + over - F.col("t1"))) / spread
    return raw.select(*by, "start", "samples", increase.alias("increase"), (increase / over).alias("rate"))


def usage_totals(rows: DataFrame, by: str, content: str = "text") -> DataFrame:
    """(by, tokens): the estimated tokens of all texts, a token for each four characters or what is left of them; null texts have none."""
    return rows.groupBy(by).agg(F.sum(F.ceil(F.coalesce(F.length(content), F.lit(0)) / 4)).alias("tokens"))
