"""Text, classification, cache and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import classify, masking, text, vectors
from marlstone.plans.common import Catalogue, Tables
from marlstone.sources import cache

CATALOGUE = Catalogue()
add = CATALOGUE.sql


@add(r"""SELECT doc_id, CAST(length(c) AS INTEGER) AS n, length(trim(c)) < 5 AS rejected, (CASE WHEN length(c) < length(d) THEN 1 ELSE 0 END) AS n_warnings, sha256(c) AS sha
FROM (SELECT doc_id, d, regexp_replace(d, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS c FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN chr(7) || text ELSE text END AS d FROM documents))""")
def t_guardrails(t: Tables) -> DataFrame:
    """Control characters go, very short texts are rejected."""
    dirty = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("\x07"), "text")).otherwise(F.col("text"))
    g = t.documents.select("doc_id", text.guarded(dirty).alias("g"))
    return g.select("doc_id", F.length("g.text").alias("n"), F.col("g.rejected").alias("rejected"), F.size("g.warnings").alias("n_warnings"), F.sha2("g.text", 256).alias("sha"))


@add("SELECT doc_id, greatest(1, CAST(ceil(length(text) / CAST(3.5 AS DOUBLE)) AS BIGINT)) AS n_tokens, CASE WHEN lim IS NULL THEN 5000 WHEN lim - n_chars - 200 >= 200 THEN greatest(200, least(5000, lim - n_chars - 200)) END AS granted FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 3000 END AS lim FROM documents)")
def t_token_estimate(t: Tables) -> DataFrame:
    limit = F.when(F.col("doc_id") % 4 != 0, 3000)
    return t.documents.select("doc_id", text.tokens(F.col("text")).alias("n_tokens"), text.clamped_tokens(F.lit(5000), limit, F.col("n_chars")).alias("granted"))


@add("""SELECT doc_id, CASE WHEN p > 0 THEN p - 1 END AS at, CASE WHEN p > 0 THEN CAST(length(left(text, p - 1)) - length(replace(left(text, p - 1), chr(10), '')) + 1 AS INTEGER) END AS line
FROM (SELECT doc_id, text, CAST(instr(text, ' the ') AS INTEGER) AS p FROM documents)""")
def t_line_numbers(t: Tables) -> DataFrame:
    at = text.found_at(F.col("text"), F.lit(" the "))
    return t.documents.select("doc_id", at.alias("at"), text.line_of(F.col("text"), at).alias("line"))


@add(r"""SELECT doc_id, CASE WHEN length(c) > 60 THEN rtrim(left(c, 57)) || '...' ELSE c END AS shown FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS c FROM documents)""")
def t_truncate_ellipsis(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.shortened(F.col("text"), 60).alias("shown"))


@add("SELECT doc_id, 'obj_' || left(sha256(concat_ws('|', CAST(doc_id AS VARCHAR), nullif(nullif(lang, 'en'), ''), source)), 12) AS id FROM documents")
def t_stable_id(t: Tables) -> DataFrame:
    lang = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return t.documents.select("doc_id", text.stable_id("obj", F.col("doc_id"), lang, F.col("source")).alias("id"))


@add("SELECT c_custkey, upper(trim(translate('[' || c_name || '] ', '[]\"`', ''))) AS ident, lower(split_part(c_name, '#', -1)) AS tail FROM customer")
def t_identifiers(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit("["), "c_name", F.lit("] "))
    dotted = F.concat(F.lit("[dbo]."), F.translate("c_name", "#", "."))
    return t.customer.select("c_custkey", text.identifier(quoted).alias("ident"), text.bare_field(dotted).alias("tail"))


@add("SELECT doc_id, list_contains(j, 'the') AS has_the, CAST(len(j) AS INTEGER) AS n FROM (SELECT doc_id, list_filter(['the', 'und', 'que', 'zzz'], lambda x: contains(lower(text), x)) AS j FROM documents)")
def t_jargon(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id", text.jargon(F.col("text"), ["the", "und", "que", "zzz"]).alias("j"))
    return j.select("doc_id", F.array_contains("j", "the").alias("has_the"), F.size("j").alias("n"))


@add("""SELECT c_custkey, c_custkey % 6 IN (0, 3) AS degenerate, c_custkey % 6 IN (2, 4) AS truncated FROM customer""")
def t_degenerate(t: Tables) -> DataFrame:
    """Repeated runs of a quarter of the text, and texts cut short."""
    c = F.col("c_custkey")
    texts = [F.repeat(F.lit("abc "), 30), F.concat(F.lit("A whole sentence, number "), c, F.lit(".")), F.concat(F.lit("cut off after "), c), F.concat(F.repeat(F.lit("=-"), 15), F.lit(" some other words.")), F.lit('an "open quote.'), F.concat(F.repeat(F.lit("ab"), 9), F.lit(" and a text that is long enough to hide the run in it, with an end."))]
    made = F.coalesce(*(F.when(c % 6 == i, x) for i, x in enumerate(texts)))
    return t.customer.select("c_custkey", text.degenerate(made).alias("degenerate"), text.truncated(made).alias("truncated"))


@add("""SELECT c_custkey, 'SELECT ' || repeat(' ', 7) || ' ' || repeat(' ', 17) || ', ' || c_custkey || ' ' || repeat(' ', 7 + length(CAST(c_custkey AS VARCHAR))) || chr(10) || '[x''y] "q--"' AS masked,
'SELECT ''it''''s'' ' || repeat(' ', 17) || ', ' || c_custkey || ' ' || repeat(' ', 7 + length(CAST(c_custkey AS VARCHAR))) || chr(10) || '[x''y] "q--"' AS executable FROM customer""")
def t_mask(t: Tables) -> DataFrame:
    """Comments and literals blanked, nested ones whole, names left."""
    c = F.col("c_custkey")
    code = F.concat(F.lit("SELECT 'it''s' /* a /* b */ c */, "), c, F.lit(" -- end "), c.cast("string"), F.lit("\n[x'y] \"q--\""))
    return t.customer.select("c_custkey", masking.masked(code).alias("masked"), masking.executable(code).alias("executable"))


@add("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'o_totalprice' WHEN 1 THEN 'a.balance' WHEN 2 THEN NULL ELSE 'status' END AS lhs, CASE o_orderkey % 4 WHEN 0 THEN '>=' WHEN 1 THEN '<>' WHEN 2 THEN NULL ELSE '=' END AS op,
CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE '''F''' END AS rhs FROM orders""")
def c_comparisons(t: Tables) -> DataFrame:
    """Simple comparisons to parts; compound ones to nulls."""
    k = F.col("o_orderkey")
    told = F.when(k % 4 == 0, F.concat(F.lit("o_totalprice >= "), k)).when(k % 4 == 1, "(a.balance != 0)").when(k % 4 == 2, "a > 1 AND b < 2").otherwise("status = 'F'")
    c = t.orders.select("o_orderkey", classify.comparison(told).alias("c"))
    return c.select("o_orderkey", F.col("c.left").alias("lhs"), F.col("c.op").alias("op"), F.col("c.right").alias("rhs"))


@add("""SELECT d.doc_id, c.response_text, c.response_text IS NOT NULL AS hit FROM (SELECT doc_id, sha256('{"doc_id":' || (doc_id % 400) || ',"lang":"' || lang || '"}') AS cache_key FROM documents) d
LEFT JOIN (SELECT sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') AS cache_key, text AS response_text FROM documents WHERE source <> 'src0') c USING (cache_key)""")
def k_cache_lookup(t: Tables) -> DataFrame:
    stored = t.documents.filter("source <> 'src0'").select(cache.cache_key(F.col("doc_id"), F.col("lang")).alias("cache_key"), F.col("text").alias("response_text"))
    wanted = t.documents.select(F.col("doc_id").alias("id"), cache.cache_key((F.col("doc_id") % 400).alias("doc_id"), F.col("lang")).alias("cache_key"))
    return cache.look_up(wanted, stored).select(F.col("id").alias("doc_id"), "response_text", "hit")


@add("""SELECT conv_id AS cache_key, turn AS created_at, text AS response_text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r FROM (SELECT conv_id, turn, text FROM conversations WHERE trim(text) <> '' AND role = 'user')) WHERE r = 1""")
def k_latest_wins(t: Tables) -> DataFrame:
    rows = t.conversations.filter("role = 'user'").select(F.col("conv_id").alias("cache_key"), F.col("turn").alias("created_at"), F.col("text").alias("response_text"))
    return cache.store(rows.filter("created_at < 2"), rows.filter("created_at >= 2"))


@add("SELECT doc_id AS cache_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def k_delete(t: Tables) -> DataFrame:
    return cache.delete(t.documents.select(F.col("doc_id").alias("cache_key")), t.labels.filter("toxic = 1").select(F.col("doc_id").alias("cache_key")))


@add("""SELECT query_id, vec_id, likeness, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY likeness DESC, vec_id) AS place FROM
(SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS likeness FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings e)) WHERE place <= 4""")
def v_topk_exact(t: Tables) -> DataFrame:
    """The four nearest vectors of a stated query set, by all vectors."""
    queries = t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.top_k(queries, t.embeddings.select("vec_id", "embedding"), 4)


@add(None)
def v_hash_embed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", vectors.embedded(F.col("text")).alias("embedding"))


_TOKENS = "SELECT DISTINCT {id}, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{{2,}}')) AS token FROM {table}"


@add(f"""WITH s AS ({_TOKENS.format(id='item_id AS source_id', table='benchmark')}), t AS ({_TOKENS.format(id='doc_id AS target_id', table='documents')}),
w AS (SELECT token, ln((SELECT count(DISTINCT source_id) + 1 FROM s) / (count(*) + 1)) + 1 AS idf FROM s GROUP BY token),
tot AS (SELECT source_id, sum(idf) AS total, count(*) AS n_tokens FROM s JOIN w USING (token) GROUP BY source_id),
sh AS (SELECT source_id, target_id, sum(idf) AS shared, count(*) AS k FROM s JOIN w USING (token) JOIN t USING (token) GROUP BY ALL)
SELECT source_id, n_tokens, round(coalesce(best / total, 0), 6) AS ratio FROM tot LEFT JOIN (SELECT source_id, max(shared) AS best FROM sh WHERE k >= 2 GROUP BY 1) USING (source_id)""")
def v_idf_overlap(t: Tables) -> DataFrame:
    """How much of an item's weighted words one document has."""
    exploded = lambda d, key, name: d.select(F.col(key).alias(name), F.explode(text.content_tokens(F.col("text"))).alias("token"))
    source = exploded(t.benchmark, "item_id", "source_id")
    return vectors.weighted_overlap(source, t.documents.select(text.content_tokens(F.col("text")).alias("tokens")), vectors.idf(source, "source_id", "token"))


@add("""WITH w AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}')) AS words, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
SELECT a.doc_id, round(CAST(len(list_intersect(a.words, b.words)) AS DOUBLE) / nullif(least(len(a.words), len(b.words)), 0), 6) AS overlap FROM w a JOIN w b ON a.source = b.source AND b.r = a.r + 1""")
def v_overlap_coefficient(t: Tables) -> DataFrame:
    """Words shared with the source's next document."""
    ids = t.documents.select("doc_id", "source")
    ahead = ids.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))).filter("next_id is not null").select("doc_id", "next_id")
    words = t.documents.select("doc_id", text.content_tokens(F.col("text")).alias("words"))
    both = ahead.join(words, "doc_id").join(words.toDF("next_id", "next"), "next_id")
    return both.select("doc_id", F.round(text.overlap_coefficient(F.col("words"), F.col("next")).cast("double"), 6).alias("overlap"))
