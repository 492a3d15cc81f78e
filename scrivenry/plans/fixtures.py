"""Inputs that the driver's tables lack, as deterministic functions of the tables they have: Spark plans and SQL side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL views by name; a view may use those before it.
VIEWS: dict[str, str] = {
    "src_doc": """SELECT doc_id, 'DOC-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS item_id, text, source AS doc_type, lang AS language,
 [lang, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END] AS tags, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS created_at,
 doc_id % 5 + 1 AS version, ['u' || (doc_id % 50)] AS acl_users, ['g' || (doc_id % 7), 'g' || (doc_id % 3)] AS acl_groups FROM documents""",
    "src_page": """SELECT d.doc_id, d.item_id, p AS page_no, array_to_string(l[(p - 1) * 10 + 1:p * 10], chr(10)) AS page FROM (SELECT *, string_split(text, chr(10)) AS l FROM src_doc) d,
 unnest(range(1, (len(l) - 1) // 10 + 2)) AS t(p)""",
    "sentences": """SELECT doc_id, item_id, page_no, string_split(regexp_replace(page, '([.!?])\\s+(["''(\\[]?[A-Z0-9])', '\\1' || chr(31) || '\\2', 'g'), chr(31)) AS s FROM src_page""",
    "windows": """SELECT doc_id, item_id, page_no, w, array_to_string(s[(w - 1) * 5 + 1:w * 5], ' ') AS content, s[1] AS section_title FROM sentences, unnest(range(1, (len(s) - 1) // 5 + 2)) AS t(w)""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, w) - 1 AS chunk_no, substr(sha256(content), 1, 16) AS content_hash FROM windows""",
    "chunk": """SELECT doc_id, item_id, page_no, chunk_no, content, section_title, content_hash, item_id || ':' || chunk_no || ':' || content_hash AS chunk_id,
 (doc_id * 31 + chunk_no) % (SELECT count(*) FROM embeddings) AS vec_id FROM numbered""",
    "chunk_index": """SELECT c.*, d.doc_type, d.tags, d.created_at, d.acl_users, d.acl_groups FROM chunk c JOIN src_doc d USING (doc_id)""",
    "question": """SELECT item_id AS qid, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS query, item_id % (SELECT count(*) FROM embeddings) AS vec_id,
 'u' || (item_id % 50) AS user_id, ['g' || (item_id % 7), 'g' || ((item_id + 3) % 7)] AS groups FROM benchmark""",
    "relevant": """SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
    "index_event": """SELECT event_id, 'DOC-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS item_id,
 CASE WHEN event_type IN ('purchase', 'signup') THEN 'UPSERT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'ACL_CHANGE' END AS event_type,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_version, ts AS occurred_at,
 CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0 THEN 'backfill' ELSE 'live' END AS priority,
 CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS wave, event_id AS arrival, user_id FROM events""",
    "message": """SELECT *, CASE WHEN priority = 'backfill' THEN 'backfill' ELSE 'live' END AS topic, user_id % 4 AS part,
 row_number() OVER (PARTITION BY CASE WHEN priority = 'backfill' THEN 'backfill' ELSE 'live' END, user_id % 4 ORDER BY event_id) - 1 AS off,
 CASE WHEN event_id % 89 = 0 THEN 'OTHER' ELSE item_id END AS key, event_id % 7 AS retry_count,
 CASE WHEN event_id % 5 = 0 THEN epoch(occurred_at) + 60 ELSE 0 END AS not_before, event_id % 97 = 0 AS corrupt FROM index_event""",
    "meta": """SELECT *, sha256(item_id || chr(31) || doc_type || chr(31) || array_to_string(list_sort(tags), ',') || chr(31) || array_to_string(acl_users, ',') || chr(31) || array_to_string(list_sort(acl_groups), ',')) AS meta_hash, sha256(text) AS text_hash FROM src_doc""",
    "index_state": """SELECT item_id, CASE doc_id % 11 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'DELETED' WHEN 3 THEN 'SKIPPED' ELSE 'INDEXED' END AS status,
 CASE WHEN doc_id % 17 = 0 THEN version - 1 ELSE version END AS doc_version, CASE WHEN doc_id % 19 = 0 THEN 'm@0' ELSE 'm@1' END AS embedding_model, 'v1' AS chunker_version,
 CASE WHEN doc_id % 23 = 0 THEN 'x' ELSE meta_hash END AS state_hash, CASE WHEN doc_id % 31 = 0 THEN 'x' ELSE text_hash END AS content_hash, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE doc_id % 4 END AS wave, doc_id % 3 AS attempts FROM meta WHERE doc_id % 13 <> 0
 UNION ALL SELECT 'GONE-' || i, 'INDEXED', 1, 'm@1', 'v1', 'x', 'x', 0, 0 FROM range(10) t(i)""",
    "load_sample": """SELECT l_orderkey, l_quantity / 10 AS latency_s, CASE WHEN l_tax < 0.01 THEN 503 WHEN l_tax < 0.02 THEN 0 ELSE 200 END AS status,
 CASE l_linenumber % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'hybrid+rerank' WHEN 2 THEN 'bm25' ELSE 'knn' END AS mode_used, l_discount AS first_byte_s, l_linenumber AS run FROM lineitem""",
    "answer_text": """SELECT conv_id, turn, CASE WHEN conv_id % 10 = 0 THEN ' NOT_FOUND. ' ELSE text || ' [' || (turn % 6 + 1) || ']' END AS answer FROM conversations WHERE role = 'assistant'""",
    "ranked": """WITH w AS (SELECT doc_id, chunk_id, 'c' AS f, 1.0 AS boost, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM chunk UNION ALL SELECT doc_id, chunk_id, 't', 2.0, regexp_extract_all(lower(section_title), '[a-z0-9]+') FROM chunk),
 st AS (SELECT f, count(*) AS n, avg(len(w)) AS mean FROM w WHERE len(w) > 0 GROUP BY f), qt AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM question), tf AS (SELECT doc_id, chunk_id, f, boost, length, term, count(*) AS tf FROM (SELECT doc_id, chunk_id, f, boost, len(w) AS length, unnest(w) AS term FROM w)
 WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT f, term, count(*) AS df FROM tf GROUP BY f, term), bf AS (SELECT qid, doc_id, chunk_id, f, boost * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))) AS score
 FROM tf JOIN df USING (f, term) JOIN qt USING (term) JOIN st USING (f) GROUP BY qid, doc_id, chunk_id, f, boost), bm AS (SELECT qid, doc_id, chunk_id, round(max(score), 6) AS score FROM bf GROUP BY ALL)
 SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY max(score) DESC, doc_id) AS rank FROM bm GROUP BY qid, doc_id QUALIFY rank <= 100""",
}
_NEEDS = {
    "src_page": ["src_doc"], "sentences": ["src_page"], "windows": ["sentences"], "numbered": ["windows"], "chunk": ["numbered"], "chunk_index": ["chunk", "src_doc"],
    "message": ["index_event"], "meta": ["src_doc"], "index_state": ["meta"], "ranked": ["chunk", "question"],
}


def sql(body: str, *views: str) -> str:
    """``body`` behind the views that it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    body = body.strip()
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order)
    return f"WITH {head}{',' + body[5:] if body[:5].upper() == 'WITH ' else chr(10) + body}" if order else body


def src_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat('DOC-', lpad(string(doc_id), 8, '0')) AS item_id", "text", "source AS doc_type", "lang AS language", "array(lang, if(n_chars > 2000, 'long', 'short')) AS tags",
        "date_add(date'2024-01-01', int(doc_id % 365)) AS created_at", "doc_id % 5 + 1 AS version", "array(concat('u', doc_id % 50)) AS acl_users", "array(concat('g', doc_id % 7), concat('g', doc_id % 3)) AS acl_groups",
    )


def src_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = src_doc(spark, sf_dir).select("doc_id", "item_id", F.split("text", "\n").alias("l"))
    pages = F.expr("transform(sequence(0, (size(l) - 1) div 10), p -> array_join(slice(l, int(p * 10 + 1), 10), '\n'))")
    return lines.select("doc_id", "item_id", F.posexplode(pages).alias("p", "page")).select("doc_id", "item_id", (F.col("p") + 1).alias("page_no"), "page")


def windows_of(pages: DataFrame, *keep: str) -> DataFrame:
    """Simple chunks of paged documents: five sentences of a page each, numbered from 0, with the page's first sentence as title."""
    from ..functions.text import sentences

    parts = pages.withColumn("s", sentences(F.col("page")))
    windows = F.expr("transform(sequence(0, (size(s) - 1) div 5), w -> struct(page_no, w, array_join(slice(s, int(w * 5 + 1), 5), ' ') AS content, s[0] AS section_title))")
    rows = parts.select(*keep, "item_id", F.explode(windows).alias("x")).groupBy(*keep, "item_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rows = rows.select(*keep, "item_id", F.posexplode("xs").alias("chunk_no", "x"))
    return rows.select(*keep, "item_id", "x.page_no", F.col("chunk_no").cast("long").alias("chunk_no"), "x.content", "x.section_title")


def _windows(spark: SparkSession, sf_dir: str, *keep: str, among: DataFrame | None = None) -> DataFrame:
    """The windows of :func:`windows_of`, made inside of each document's row: texts are shuffled only where the work lies in few tasks. ``among`` are the doc_id of few documents, or all."""
    from ..functions.text import sentences
    from ..sources.staging import spread

    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    page = lambda lines, p: F.array_join(F.slice(lines, (p * 10 + 1).cast("int"), 10), "\n")
    parts = lambda s, p: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 5).cast("int")), lambda w: F.struct((p + 1).alias("page_no"), F.array_join(F.slice(s, (w * 5 + 1).cast("int"), 5), " ").alias("content"), F.get(s, F.lit(0)).alias("section_title")))
    pages = lambda lines: F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 10).cast("int")), lambda p: once(sentences(page(lines, p)), lambda s: parts(s, p)))
    rows = src_doc(spark, sf_dir).select("doc_id", "item_id", "text", *keep)
    rows = spread(rows if among is None else rows.join(F.broadcast(among), "doc_id", "left_semi"), "doc_id")
    rows = rows.select("doc_id", "item_id", *keep, F.posexplode(F.flatten(once(F.split("text", "\n"), pages))).alias("chunk_no", "x"))
    return rows.select("doc_id", "item_id", "x.page_no", F.col("chunk_no").cast("long").alias("chunk_no"), "x.content", "x.section_title", *keep)


def chunk(spark: SparkSession, sf_dir: str, *keep: str, among: DataFrame | None = None) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    out = _windows(spark, sf_dir, *keep, among=among).withColumn("content_hash", F.substring(F.sha2("content", 256), 1, 16))
    out = out.withColumn("chunk_id", F.concat_ws(":", "item_id", "chunk_no", "content_hash")).withColumn("vec_id", (F.col("doc_id") * 31 + F.col("chunk_no")) % n)
    return out.select(*(c for c in out.columns if c not in keep), *keep)


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(spark, sf_dir, "doc_type", "tags", "created_at", "acl_users", "acl_groups").where("doc_id IS NOT NULL")


def question(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.expr("array_join(regexp_extract_all(lower(text), '[a-z0-9]+', 0), ' ')").alias("query"), (F.col("item_id") % n).alias("vec_id"),
        F.expr("concat('u', item_id % 50)").alias("user_id"), F.expr("array(concat('g', item_id % 7), concat('g', (item_id + 3) % 7))").alias("groups"),
    )


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold a question's whole text."""
    from ..operators.context import holding

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("item"))
    return holding(table(spark, sf_dir, "documents").select("doc_id", "text"), items).select("qid", "doc_id")


def index_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "bigint(get_json_object(props, '$.k'))"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('DOC-', lpad(string(user_id), 8, '0')) AS item_id", "CASE WHEN event_type IN ('purchase', 'signup') THEN 'UPSERT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'ACL_CHANGE' END AS event_type",
        f"{k} AS doc_version", "cast(ts AS timestamp) AS occurred_at", f"if({k} % 10 = 0, 'backfill', 'live') AS priority", f"{k} % 4 AS wave", "event_id AS arrival", "user_id",
    )


def message(spark: SparkSession, sf_dir: str, by_ranges: bool = False) -> DataFrame:
    """Events as messages. With ``by_ranges`` offsets are counted by ranges of events, as there are only eight partitions of topics."""
    from ..operators.ingest import numbered

    rows = index_event(spark, sf_dir).selectExpr("*", "priority AS topic", "user_id % 4 AS part")
    if by_ranges:
        rows = numbered(rows, "event_id", within=("topic", "part")).withColumn("off", F.col("turn") - 1).drop("turn")
    else:
        rows = rows.selectExpr("*", "bigint(row_number() OVER (PARTITION BY topic, part ORDER BY event_id) - 1) AS off")
    return rows.selectExpr(
        "*", "if(event_id % 89 = 0, 'OTHER', item_id) AS key", "event_id % 7 AS retry_count", "if(event_id % 5 = 0, unix_micros(occurred_at) / 1e6 + 60, 0) AS not_before", "event_id % 97 = 0 AS corrupt",
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.hashing import metadata_hash

    return src_doc(spark, sf_dir).withColumn("meta_hash", metadata_hash()).withColumn("text_hash", F.sha2("text", 256))


def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = meta(spark, sf_dir).where("doc_id % 13 <> 0").selectExpr(
        "item_id", "CASE doc_id % 11 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'DELETED' WHEN 3 THEN 'SKIPPED' ELSE 'INDEXED' END AS status", "if(doc_id % 17 = 0, version - 1, version) AS doc_version",
        "if(doc_id % 19 = 0, 'm@0', 'm@1') AS embedding_model", "'v1' AS chunker_version", "if(doc_id % 23 = 0, 'x', meta_hash) AS state_hash", "if(doc_id % 31 = 0, 'x', text_hash) AS content_hash",
        "if(doc_id % 29 = 0, NULL, doc_id % 4) AS wave", "doc_id % 3 AS attempts",
    )
    gone = spark.range(10).selectExpr("concat('GONE-', id)", "'INDEXED'", "1L", "'m@1'", "'v1'", "'x'", "'x'", "0L", "0L")
    return own.union(gone)


def load_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_quantity / 10 AS latency_s", "CASE WHEN l_tax < 0.01 THEN 503 WHEN l_tax < 0.02 THEN 0 ELSE 200 END AS status",
        "CASE l_linenumber % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'hybrid+rerank' WHEN 2 THEN 'bm25' ELSE 'knn' END AS mode_used", "l_discount AS first_byte_s", "l_linenumber AS run",
    )


def answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr("conv_id", "turn", "if(conv_id % 10 = 0, ' NOT_FOUND. ', concat(text, ' [', turn % 6 + 1, ']')) AS answer")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, doc_id, rank): the hundred best documents of each question by their best chunk's BM25."""
    from ..operators import retrieval
    from ..sources.staging import staged

    asked = question(spark, sf_dir)
    best = retrieval.best_words(retrieval.words_of(chunk(spark, sf_dir), asked, ["doc_id"]), asked, 100, key="doc_id", everyone=True)
    return staged(best.select("qid", "doc_id", "rank"), "ranked")
