"""Queries over text functions, predicates, digests and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, masking, parsing, text, vectors
from . import fixtures as fx
from .registry import query

LINES = "lines AS (SELECT doc_id, t.i - 1 AS line_no, l[t.i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("b10_has_text", "SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) > 0 AS has_text FROM documents")
def b10(spark, sf):
    return docs(spark, sf).select("doc_id", text.has_text(F.col("text")).alias("has_text"))


@query("b15_denied_patterns", "SELECT doc_id, regexp_matches(text, 'license|pathetic', 'i') OR regexp_matches(text, 'ing [a-z]+ion\\b', 'i') AS denied FROM documents")
def b15(spark, sf):
    return docs(spark, sf).select("doc_id", text.matches_any(F.col("text"), ["license|pathetic", "ing [a-z]+ion\\b"]).alias("denied"))


_SHOUT = "(length(regexp_replace(line, '\\P{L}', '', 'g')) >= 3 AND NOT regexp_matches(regexp_replace(line, '\\P{L}', '', 'g'), '[^\\p{Lu}\\p{Lt}]'))"


@query("b17_title_lines", f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE length(line) <= 80 AND NOT regexp_matches(line, '[.!?,;]$') AND ({_SHOUT} OR regexp_matches(line, '^\\d+(?:\\.\\d+)*\\.?\\s+\\S'))")
def b17(spark, sf):
    return lines(spark, sf).where(text.is_title(F.col("line"))).select("doc_id", "line_no", "line")


@query("b18_table_lines", f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE regexp_matches(line, '\\t|\\S {{2,}}\\S|\\S\\s*\\|\\s*\\S.*\\|')")
def b18(spark, sf):
    return lines(spark, sf).where(text.is_table_line(F.col("line"))).select("doc_id", "line_no")


@query("b19_structure_lines", f"""WITH {LINES} SELECT doc_id, line_no, ({_SHOUT} AND length(line) <= 80) OR suffix(line, ':') AS heading,
 regexp_matches(line, '^\\s*(?:\\(?\\d{{1,3}}[.)]|\\(?[a-zA-Z][.)]|[-\u2022*\u2013])\\s+') AS list_item FROM lines""")
def b19(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", text.is_heading(F.col("line")).alias("heading"), text.is_list_item(F.col("line")).alias("list_item"))


@query("b21_identity_parse", """SELECT item_id, list_distinct(list_filter(list_transform(string_split(raw, ','), lambda g: trim(g)), lambda g: g <> '')).list_sort().array_to_string('|') AS groups,
 regexp_matches('u' || item_id, '^[A-Za-z0-9._:@-]{1,256}$') AS valid FROM (SELECT item_id, ' g' || item_id % 7 || ', g' || item_id % 3 || ',,g' || item_id % 7 AS raw FROM benchmark)""")
def b21(spark, sf):
    raw = fx.table(spark, sf, "benchmark").selectExpr("item_id", "concat(' g', item_id % 7, ', g', item_id % 3, ',,g', item_id % 7) AS raw")
    groups = F.array_distinct(text.string_list(F.split("raw", ",")))
    return raw.select("item_id", F.array_join(F.sort_array(groups), "|").alias("groups"), F.concat(F.lit("u"), "item_id").rlike("^[A-Za-z0-9._:@-]{1,256}$").alias("valid"))


@query("b22_item_id_valid", fx.sql("SELECT doc_id, regexp_matches(item_id, '^[A-Za-z0-9._:-]{1,128}$') AS valid, regexp_matches(doc_type || ' ' || language, '^[A-Za-z0-9._:-]{1,128}$') AS spaced FROM src_doc", "src_doc"))
def b22(spark, sf):
    ok = "^[A-Za-z0-9._:-]{1,128}$"
    return fx.src_doc(spark, sf).select("doc_id", F.col("item_id").rlike(ok).alias("valid"), F.concat_ws(" ", "doc_type", "language").rlike(ok).alias("spaced"))


@query("b23_alnum_chunks", fx.sql("SELECT chunk_id FROM chunk WHERE regexp_matches(content, '[\\p{L}\\p{N}]')", "chunk"))
def b23(spark, sf):
    return fx.chunk(spark, sf).where(text.has_alphanumeric(F.col("content"))).select("chunk_id")


@query("h01_clean_characters", """SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(replace(replace(translate(text, chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279), ''), chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'),
 '\\r\\n|\\r|\\x{2028}', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) AS digest FROM documents""")
def h01(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(text.clean_characters(F.col("text")), 256).alias("digest"))


@query("h02_collapse_spaces", "SELECT doc_id, sha256(regexp_replace(text, '[ \\t\u00a0\u2000-\u200a\u202f\u205f\u3000]+', ' ', 'g')) AS digest FROM documents")
def h02(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(text.collapse_spaces(F.col("text")), 256).alias("digest"))


@query("h04_paragraph_end", f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE ({_SHOUT} AND length(line) <= 80) OR suffix(line, ':') OR (regexp_matches(line, '[.!?]$') AND length(line) < 50)")
def h04(spark, sf):
    return lines(spark, sf).where(text.ends_paragraph(F.col("line"))).select("doc_id", "line_no")


@query("h05_edge_key", f"WITH {LINES} SELECT doc_id, line_no, sha256(regexp_replace(lower(regexp_replace(trim(line), '\\s+', ' ', 'g')), '\\d+', '#', 'g')) AS digest FROM lines")
def h05(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", F.sha2(text.edge_key(F.col("line")), 256).alias("digest"))


@query("h06_sentences", fx.sql("SELECT doc_id, page_no, len(s) AS n, sha256(array_to_string(s, '~')) AS digest FROM sentences", "sentences"))
def h06(spark, sf):
    s = text.sentences(F.col("page"))
    return fx.src_page(spark, sf).select("doc_id", "page_no", F.size(s).alias("n"), F.sha2(F.array_join(s, "~"), 256).alias("digest"))


@query("h07_token_count", "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n_tokens FROM documents")
def h07(spark, sf):
    return docs(spark, sf).select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


TERMS = "list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), lambda w: length(w) >= 3)"


@query("h10_query_terms", fx.sql(f"SELECT qid, array_to_string(list_sort({TERMS}), ' ') AS terms FROM question", "question"))
def h10(spark, sf):
    return fx.question(spark, sf).select("qid", F.array_join(F.sort_array(text.query_terms(F.col("query"))), " ").alias("terms"))


@query("h12_marked_terms", """SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(m, '(?s)<em>(.*?)</em>', 1), lambda x: lower(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))))), '|') AS terms
 FROM (SELECT doc_id, regexp_replace(text, ' (t[a-z]+)', ' <em>\\1&amp;</em>', 'g') AS m FROM documents)""")
def h12(spark, sf):
    marked = docs(spark, sf).select("doc_id", F.regexp_replace("text", " (t[a-z]+)", " <em>$1&amp;</em>").alias("m"))
    return marked.select("doc_id", F.array_join(F.sort_array(text.marked_terms(F.col("m"))), "|").alias("terms"))


@query("h13_citation_snippet", """SELECT doc_id, sha256(CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(substr(t, 1, 240), ' [^ ]*$', '') || '...' END) AS snippet
 FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def h13(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(text.citation_snippet(F.col("text")), 256).alias("snippet"))


@query("h14_citation_refs", fx.sql("SELECT conv_id, turn, array_to_string(regexp_extract_all(answer, '\\[(\\d{1,3})\\]', 1), ',') AS refs FROM answer_text", "answer_text"))
def h14(spark, sf):
    return fx.answer_text(spark, sf).select("conv_id", "turn", F.array_join(text.citation_refs(F.col("answer")), ",").alias("refs"))


@query("h15_not_found", fx.sql("SELECT conv_id, turn, trim(answer, ' .') = 'NOT_FOUND' AS not_found FROM answer_text", "answer_text"))
def h15(spark, sf):
    return fx.answer_text(spark, sf).select("conv_id", "turn", text.is_not_found(F.col("answer")).alias("not_found"))


@query("h16_mask_email", "SELECT doc_id, sha256(regexp_replace(text, '\\b[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+\\b', '[EMAIL]', 'g')) AS digest FROM documents")
def h16(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(masking.mask_label(F.col("text"), "EMAIL"), 256).alias("digest"))


@query("h20_mask_all")
def h20(spark, sf):
    """Labels in their order with validators: look-arounds keep it out of the other engine."""
    return docs(spark, sf).select("doc_id", masking.masked(F.col("text")).alias("m")).select("doc_id", F.sha2("m.text", 256).alias("digest"), F.col("m.n").alias("masked"))


@query("h21_context_label", fx.sql("""SELECT chunk_id, item_id || CASE WHEN page_no % 2 = 0 THEN ', ' || doc_type ELSE '' END ||
 CASE WHEN page_no % 3 = 0 THEN '' WHEN page_no % 3 = 1 THEN ', page ' || page_no ELSE ', pages ' || page_no || '-' || (page_no + 2) END AS label FROM chunk_index""", "chunk_index"))
def h21(spark, sf):
    c = fx.chunk_index(spark, sf)
    first, last = F.expr("if(page_no % 3 = 0, NULL, page_no)"), F.expr("CASE page_no % 3 WHEN 2 THEN page_no + 2 END")
    return c.select("chunk_id", text.context_label(F.col("item_id"), F.expr("if(page_no % 2 = 0, doc_type, '')"), first, last).alias("label"))


@query("h22_prompt_fill", fx.sql("SELECT qid, 'Question: ' || query || ' {{context}}' || chr(10) || 'Asked by ' || user_id || '.' AS prompt FROM question", "question"))
def h22(spark, sf):
    values = {"question": F.concat(F.col("query"), F.lit(" {{context}}")), "user": F.col("user_id")}
    return fx.question(spark, sf).select("qid", text.fill_template("Question: {{question}}\nAsked by {{user}}.", values).alias("prompt"))


@query("h24_model_slug", "SELECT DISTINCT source, 'chunks_v1_' || regexp_replace(lower('BGE-' || source || '/M3_x'), '[^a-z0-9]', '', 'g') AS name FROM documents")
def h24(spark, sf):
    model = F.concat(F.lit("BGE-"), "source", F.lit("/M3_x"))
    return docs(spark, sf).select("source").distinct().select("source", F.concat(F.lit("chunks_v1_"), text.model_slug(model)).alias("name"))


@query("h26_embedding_text", fx.sql("SELECT chunk_id, sha256(CASE WHEN starts_with(content, t) THEN content ELSE t || chr(10) || content END) AS digest FROM (SELECT *, CASE WHEN chunk_no % 2 = 0 THEN substr(content, 1, 5) ELSE item_id END AS t FROM chunk)", "chunk"))
def h26(spark, sf):
    title = F.expr("if(chunk_no % 2 = 0, substring(content, 1, 5), item_id)")
    return fx.chunk(spark, sf).select("chunk_id", F.sha2(text.embedding_text(title, F.col("content")), 256).alias("digest"))


@query("h30_content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def h30(spark, sf):
    return docs(spark, sf).select("doc_id", hashing.short_hash(F.col("text")).alias("content_hash"))


@query("h31_chunk_id", fx.sql("SELECT doc_id, chunk_no, chunk_id FROM chunk", "chunk"))
def h31(spark, sf):
    c = fx.chunk(spark, sf)
    return c.select("doc_id", "chunk_no", hashing.chunk_id(F.col("item_id"), F.col("chunk_no"), hashing.short_hash(F.col("content"))).alias("chunk_id"))


@query("h32_pages_hash", fx.sql("SELECT doc_id, sha256(string_agg(page_no || chr(31) || page || chr(30), '' ORDER BY page_no)) AS digest FROM src_page GROUP BY doc_id", "src_page"))
def h32(spark, sf):
    pages = fx.src_page(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "page"))).alias("pages"))
    return pages.select("doc_id", hashing.pages_hash(F.col("pages")).alias("digest"))


@query("h33_metadata_hash", fx.sql("SELECT doc_id, meta_hash FROM meta", "meta"))
def h33(spark, sf):
    return fx.src_doc(spark, sf).select("doc_id", hashing.metadata_hash().alias("meta_hash"))


@query("h34_scope_key", fx.sql("SELECT qid, substr(sha256(user_id || chr(31) || array_to_string(list_sort(list_distinct(groups)), ',')), 1, 32) AS scope FROM question", "question"))
def h34(spark, sf):
    return fx.question(spark, sf).select("qid", hashing.scope_key(F.col("user_id"), F.col("groups")).alias("scope"))


@query("h35_cache_key", fx.sql("SELECT qid, sha256('m@1' || chr(31) || query) AS key FROM question", "question"))
def h35(spark, sf):
    return fx.question(spark, sf).select("qid", hashing.cache_key(F.lit("m@1"), F.col("query")).alias("key"))


@query("h36_pseudonym", "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS pseudonym FROM customer")
def h36(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", hashing.short_hash(F.col("c_name")).alias("pseudonym"))


@query("h37_hash_vector", """SELECT doc_id, round(v[1] / n, 6) AS v1, round(v[17] / n, 6) AS v17, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total FROM (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM
 (SELECT doc_id, list_transform(range(0, 32), lambda i: CAST(CAST('0x' || substr(sha256(text), CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) AS DOUBLE) - 127.5) AS v FROM documents))""")
def h37(spark, sf):
    v = docs(spark, sf).select("doc_id", hashing.hash_vector(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 6).alias("v1"), F.round(F.col("v")[16], 6).alias("v17"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("h40_normalise", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: 9 * x * x))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings")
def h40(spark, sf):
    v = F.transform(vectors.doubles(F.col("embedding")), lambda x: x * 3)
    return fx.table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(vectors.normalised(v, 1e-3)[0], 6).alias("first"))


@query("h41_vector_problem", """SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'dimensions' WHEN vec_id % 7 = 1 THEN 'zero' WHEN vec_id % 7 = 2 THEN 'not finite' WHEN vec_id % 7 = 3 THEN 'missing' END AS problem FROM embeddings""")
def h41(spark, sf):
    v = F.expr("CASE vec_id % 7 WHEN 0 THEN slice(embedding, 1, 63) WHEN 1 THEN transform(embedding, x -> float(0)) WHEN 2 THEN transform(embedding, (x, i) -> if(i = 5, float('NaN'), x)) WHEN 3 THEN NULL ELSE embedding END")
    return fx.table(spark, sf, "embeddings").select("vec_id", vectors.vector_problem(vectors.doubles(v), 64).alias("problem"))


@query("h42_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def h42(spark, sf):
    """Each vector with the next one."""
    e = fx.table(spark, sf, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("e"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("e").alias("f"))
    return e.join(after, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(vectors.cosine(F.col("e"), F.col("f")), 6).alias("cosine"))


_SH = "list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))"


@query("h43_shingle_jaccard", f"""WITH s AS (SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN [] ELSE {_SH} END AS s FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations))
 SELECT a.conv_id, a.turn AS a, b.turn AS b, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END, 6) AS jaccard FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn""")
def h43(spark, sf):
    s = fx.table(spark, sf, "conversations").select("conv_id", "turn", vectors.shingles(F.col("text")).alias("s"))
    both = s.select("conv_id", F.col("turn").alias("a"), F.col("s").alias("x")).join(s.select("conv_id", F.col("turn").alias("b"), F.col("s").alias("y")), "conv_id").where("a < b")
    return both.select("conv_id", "a", "b", F.round(vectors.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("h44_rank_discounts", fx.sql("SELECT qid, doc_id, round(1 / (60 + rank), 9) AS reciprocal, round(1 / log2(rank + 1), 9) AS discount FROM ranked", "ranked"))
def h44(spark, sf):
    return fx.ranked(spark, sf).select("qid", "doc_id", F.round(1 / (60 + F.col("rank")), 9).alias("reciprocal"), F.round(1 / F.log2(F.col("rank") + 1), 9).alias("discount"))


@query("h49_token_estimate", "SELECT doc_id, (length(text) + 3) // 4 AS tokens FROM documents")
def h49(spark, sf):
    return docs(spark, sf).select("doc_id", F.ceil(F.length("text") / 4).alias("tokens"))


@query("h50_backoff", fx.sql("SELECT event_id, least(60, 0.5 * pow(2, retry_count)) AS delay FROM message", "message"))
def h50(spark, sf):
    return fx.message(spark, sf).select("event_id", parsing.backoff(F.col("retry_count")).alias("delay"))


@query("h60_parse_time", """SELECT o_orderkey, strftime(try_cast(raw AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS raw FROM orders)""")
def h60(spark, sf):
    raw = F.expr("if(o_orderkey % 5 = 0, 'soon', date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\"))")
    return fx.table(spark, sf, "orders").select("o_orderkey", F.date_format(parsing.parsed_time(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("h61_page_list", "SELECT doc_id, array_to_string(range(doc_id % 9 + 1, least(greatest(doc_id % 9 + 1, doc_id % 9 + 1 + doc_id % 70 - 5), doc_id % 9 + 50) + 1), ',') AS pages FROM documents")
def h61(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(text.page_list(F.expr("doc_id % 9 + 1"), F.expr("doc_id % 9 + 1 + doc_id % 70 - 5")), ",").alias("pages"))


@query("h62_string_list", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS parts FROM documents")
def h62(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(text.string_list(F.split("text", "\\.")), "|").alias("parts"))


@query("h63_header_number", "SELECT event_id, coalesce(try_cast(CASE event_id % 3 WHEN 0 THEN 'bad' WHEN 1 THEN CAST(event_id % 7 AS VARCHAR) END AS INTEGER), 0) AS retries FROM events")
def h63(spark, sf):
    headers = F.expr("CASE event_id % 3 WHEN 0 THEN map('x-retry-count', 'bad') WHEN 1 THEN map('x-retry-count', string(event_id % 7)) ELSE map() END")
    return fx.table(spark, sf, "events").select("event_id", parsing.header_number(headers).alias("retries"))


@query("h64_json_in_text", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def h64(spark, sf):
    said = F.concat(F.lit("Score: {not json} then {\"in\": {\"s\": \"}\"}, \"p\": "), "props", F.lit("} {\"k\": 7}"))
    return fx.table(spark, sf, "events").select("event_id", F.get_json_object(parsing.first_json(said), "$.p.k").cast("int").alias("k"))


@query("h65_origin", fx.sql("SELECT event_id, CASE WHEN retry_count > 0 THEN 'kept/' || event_id ELSE topic || '/' || part || '/' || off END AS origin FROM message", "message"))
def h65(spark, sf):
    headers = F.expr("if(retry_count > 0, map('x-origin', concat('kept/', event_id)), map())")
    return fx.message(spark, sf).select("event_id", parsing.origin(headers, F.col("topic"), F.col("part"), F.col("off")).alias("origin"))


@query("h66_age_days", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-06-01') AS age, date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-06-01') < 14 AS young FROM orders")
def h66(spark, sf):
    age = parsing.age_days(F.col("o_orderdate"), F.lit("2024-06-01"))
    return fx.table(spark, sf, "orders").select("o_orderkey", age.alias("age"), (age < 14).alias("young"))


@query("h67_counts_by_wave", fx.sql("SELECT wave, event_type, count(*) AS n FROM index_event GROUP BY wave, event_type", "index_event"))
def h67(spark, sf):
    counted = fx.index_event(spark, sf).groupBy("wave", "event_type").count()
    maps = counted.groupBy("wave").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("by_type"))
    return maps.select("wave", F.explode("by_type").alias("event_type", "n"))
