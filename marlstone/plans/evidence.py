"""Joins, aggregates, metrics, telemetry and windows over evidence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import dedup, measures, relate
from marlstone.plans.common import Catalogue, Tables

CATALOGUE = Catalogue()
add = CATALOGUE.sql

_SPANS = "SELECT user_id, event_id, CAST(epoch(ts) AS BIGINT) % 100000 AS a, CAST(epoch(ts) AS BIGINT) % 100000 + 300 AS b, event_type FROM events"


def spans(t: Tables) -> DataFrame:
    # to the nearest second, halves to the even one, as a cast in DuckDB rounds
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("long") % 100000
    return t.events.select("user_id", "event_id", at.alias("start"), (at + 300).alias("end"), "event_type")


@add(f"SELECT x.user_id, x.event_id, min(y.event_id) AS first_view, count(*) AS n FROM ({_SPANS}) x JOIN ({_SPANS}) y ON x.user_id = y.user_id AND x.a < y.b AND y.a < x.b WHERE x.event_type = 'purchase' AND y.event_type = 'view' GROUP BY x.user_id, x.event_id")
def j_overlap_spans(t: Tables) -> DataFrame:
    """Spans that overlap within a user, by cells of equal width."""
    s = spans(t)
    left = s.filter("event_type = 'purchase'").drop("event_type")
    right = s.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = relate.overlap_join(left, right, ["user_id"], 600)
    return pairs.groupBy("user_id", "event_id").agg(F.min("view_id").alias("first_view"), F.count("*").alias("n"))


@add("""WITH e AS (SELECT o_orderkey AS id, 1 AS tier, l_linenumber AS hit FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45
UNION ALL SELECT o_orderkey, 2, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_quantity > 30
UNION ALL SELECT o_orderkey, 3, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT id, tier, count(*) AS n, min(hit) AS first_hit FROM e WHERE tier = (SELECT min(tier) FROM e i WHERE i.id = e.id) GROUP BY id, tier""")
def j_tiered_fallback(t: Tables) -> DataFrame:
    """Pairs of the first kind of match that an order has."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("hit"), "l_returnflag", "l_linestatus", "l_quantity")
    pairs = t.orders.select(F.col("o_orderkey").alias("id")).join(lines, "id")
    found = relate.tiered(pairs, ["id"], [F.expr("l_returnflag = 'R' and l_quantity > 45"), F.expr("l_linestatus = 'O' and l_quantity > 30"), F.lit(True)])
    return found.groupBy("id", "tier").agg(F.count("*").alias("n"), F.min("hit").alias("first_hit"))


_OPS = """SELECT user_id AS object_id, event_id AS statement_id, event_id AS ord, 't' || (event_id % 4) AS table_name, CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'UPDATE' WHEN 'purchase' THEN 'INSERT' WHEN 'signup' THEN 'MERGE' ELSE 'DELETE' END AS operation,
['c' || (event_id % 3), 'c' || (event_id % 5)] AS fields, event_id % 2 = 0 AS conditional FROM events"""


def operations(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    operation = F.when(kind == "view", "READ").when(kind == "click", "UPDATE").when(kind == "purchase", "INSERT").when(kind == "signup", "MERGE").otherwise("DELETE")
    k = F.col("event_id")
    named = lambda n: F.concat(F.lit("c"), k % n)
    return t.events.select(F.col("user_id").alias("object_id"), k.alias("statement_id"), k.alias("ord"), F.concat(F.lit("t"), k % 4).alias("table_name"), operation.alias("operation"), F.array(named(3), named(5)).alias("fields"), (k % 2 == 0).alias("conditional"))


@add(f"""WITH o AS ({_OPS}) SELECT object_id, producer, consumer, table_name, kind FROM (SELECT a.object_id, a.statement_id AS producer, b.statement_id AS consumer, upper(a.table_name) AS table_name,
CASE WHEN a.operation = 'UPDATE' AND b.operation = 'UPDATE' THEN CASE WHEN NOT list_has_any(a.fields, b.fields) THEN NULL WHEN NOT a.conditional AND NOT b.conditional THEN 'OVERRIDES' ELSE 'UNRESOLVED' END
WHEN b.operation = 'READ' THEN 'FEEDS' WHEN b.operation IN ('INSERT', 'UPDATE', 'MERGE') THEN 'REWRITES' ELSE 'CLEARS' END AS kind
FROM o a JOIN o b ON a.object_id = b.object_id AND a.table_name = b.table_name AND a.ord < b.ord WHERE a.operation IN ('INSERT', 'UPDATE', 'MERGE')) WHERE kind IS NOT NULL""")
def j_dependencies(t: Tables) -> DataFrame:
    return relate.dependencies(operations(t))


@add(f"SELECT object_id, upper('#' || table_name) AS t FROM ({_OPS}) GROUP BY ALL HAVING count(*) FILTER (WHERE operation = 'READ') = 0 AND count(*) > 0")
def j_write_only(t: Tables) -> DataFrame:
    return relate.write_only(operations(t).withColumn("table_name", F.concat(F.lit("#"), "table_name")))


_OBJECTS = "SELECT c_custkey AS object_id, CASE WHEN c_custkey % 2 = 0 THEN 'dbo' ELSE 'pro' END AS schema, 'proc_' || (c_custkey % 900) AS name FROM customer"
_CALLS = "SELECT o_custkey AS caller, CASE WHEN o_orderkey % 2 = 0 THEN 'dbo.proc_' ELSE 'PROC_' END || (o_orderkey % 1000) AS target FROM orders"


def objects(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k.alias("object_id"), F.when(k % 2 == 0, "dbo").otherwise("pro").alias("schema"), F.concat(F.lit("proc_"), k % 900).alias("name"))


def edges(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    calls = t.orders.select(F.col("o_custkey").alias("caller"), F.concat(F.when(k % 2 == 0, "dbo.proc_").otherwise("PROC_"), k % 1000).alias("target"))
    return relate.call_graph(calls, objects(t))


_EDGES = f"""SELECT caller, target, CASE WHEN callee <> caller THEN callee END AS callee FROM (SELECT caller, target, coalesce(f.id, b.id) AS callee FROM ({_CALLS}) c
LEFT JOIN (SELECT lower(schema || '.' || name) AS k, min(object_id) AS id FROM ({_OBJECTS}) GROUP BY 1) f ON lower(c.target) = f.k
LEFT JOIN (SELECT lower(name) AS k, min(object_id) AS id FROM ({_OBJECTS}) GROUP BY 1 HAVING count(*) = 1) b ON split_part(lower(c.target), '.', -1) = b.k)"""


@add(_EDGES)
def j_callgraph(t: Tables) -> DataFrame:
    return edges(t)


@add(f"SELECT object_id, schema, name FROM ({_OBJECTS}) WHERE object_id NOT IN (SELECT callee FROM ({_EDGES}) WHERE callee IS NOT NULL)")
def j_roots(t: Tables) -> DataFrame:
    return relate.roots(objects(t), edges(t))


_RULES = "SELECT o_custkey AS object_id, o_orderkey AS rule_id, o_orderkey AS pos, CASE o_orderkey % 2 WHEN 0 THEN 'x' ELSE 'y' END AS field, o_orderkey % 100 AS v, o_orderkey % 3 AS k, o_orderpriority AS outcome FROM orders"


@add(f"""WITH r AS ({_RULES}) SELECT a.object_id, a.field, a.rule_id AS a, b.rule_id AS b, a.outcome AS oa, b.outcome AS ob FROM r a JOIN r b ON a.object_id = b.object_id AND a.field = b.field AND a.pos < b.pos AND a.outcome <> b.outcome
WHERE CASE WHEN a.k = 0 AND b.k = 0 THEN a.v = b.v WHEN a.k = 0 AND b.k = 1 THEN a.v > b.v WHEN a.k = 0 AND b.k = 2 THEN a.v <= b.v WHEN a.k = 1 AND b.k = 0 THEN b.v > a.v WHEN a.k = 2 AND b.k = 0 THEN b.v <= a.v ELSE a.k = b.k END""")
def j_rule_pairs(t: Tables) -> DataFrame:
    """Rules that overlap and disagree; facing half-open ranges don't overlap."""
    k, v = F.col("o_orderkey") % 3, F.col("o_orderkey") % 100
    condition = F.concat(F.lit("amount "), F.when(k == 0, "= ").when(k == 1, "> ").otherwise("<= "), v)
    rules = t.orders.select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("rule_id"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("y").alias("field"), condition.alias("condition"), F.col("o_orderpriority").alias("outcome"))
    return relate.rule_pairs(rules)


@add("""WITH RECURSIVE p AS (SELECT c_custkey AS name, c_custkey + 1 AS target FROM customer WHERE c_custkey % 40 <> 0 UNION SELECT c_custkey, c_custkey - 39 FROM customer WHERE c_custkey % 80 = 0),
c(name, target) AS (SELECT name, target FROM p UNION SELECT c.name, p.target FROM c JOIN p ON c.target = p.name WHERE c.name <> p.target) SELECT name, target FROM c""")
def j_alias_closure(t: Tables) -> DataFrame:
    """Chains of forty names, every second one closed to a ring."""
    c = F.col("c_custkey")
    ahead = t.customer.filter(c % 40 != 0).select(c.alias("name"), (c + 1).alias("target"))
    return relate.alias_closure(ahead.unionByName(t.customer.filter(c % 80 == 0).select(c.alias("name"), (c - 39).alias("target"))))


@add("""SELECT upper(event_type) AS kind, user_id % 20 AS grp, arg_min(event_type, event_id) AS spelling, CAST(list(p ORDER BY first)[1:8] AS VARCHAR[]) AS first_props, sum(c) AS n, min(first) AS first_at
FROM (SELECT event_type, user_id, 'p' || (event_id % 37) AS p, event_id, min(event_id) OVER (PARTITION BY event_type, user_id % 20, event_id % 37) AS first, 1 AS c FROM events) WHERE FALSE GROUP BY ALL
UNION ALL SELECT kind, grp, spelling, (SELECT list(p ORDER BY f)[1:8] FROM (SELECT 'p' || (event_id % 37) AS p, min(event_id) AS f FROM events e WHERE upper(e.event_type) = g.kind AND e.user_id % 20 = g.grp GROUP BY 1)), n, first_at
FROM (SELECT upper(event_type) AS kind, user_id % 20 AS grp, arg_min(event_type, event_id) AS spelling, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY 1, 2) g""")
def a_ordered_distinct_capped(t: Tables) -> DataFrame:
    """First spelling, first eight distinct values in order, count."""
    rows = t.events.withColumn("p", F.concat(F.lit("p"), F.col("event_id") % 37))
    return dedup.grouped_first_seen(rows, {"kind": F.upper("event_type"), "grp": F.col("user_id") % 20}, "event_id", {"spelling": F.col("event_type")}, {"first_props": (F.col("p"), 8)})


@add("""SELECT k, v, priority FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, v) AS r FROM (SELECT o_custkey AS k, o_totalprice AS v, 0 AS priority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_totalprice, 1 FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT c_custkey, c_acctbal, 2 FROM customer)) WHERE r = 1""")
def a_priority_union(t: Tables) -> DataFrame:
    part = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    return dedup.priority_union([part("F"), part("P"), t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))], ["k"], [F.col("v")])


@add("""WITH r AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS k, o_orderpriority AS field, o_totalprice < 1000 AS incomplete FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY incomplete, pos) AS n FROM r WHERE k IS NOT NULL)
SELECT pos, k, field, incomplete, (SELECT coalesce(list(f ORDER BY p), []) FROM (SELECT field AS f, min(pos) AS p FROM r WHERE r.k = b.k AND r.field <> b.field GROUP BY 1)) AS other_fields FROM b WHERE n = 1
UNION ALL SELECT pos, k, field, incomplete, [] FROM r WHERE k IS NULL""")
def a_keep_best(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderpriority").alias("field"), (F.col("o_totalprice") < 1000).alias("incomplete"))
    return dedup.merge_rules(rows, "k", [F.col("incomplete")], "pos", "field")


@add("SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS n_statements FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) = 1")
def a_single_write_fields(t: Tables) -> DataFrame:
    return dedup.single_write_fields(t.lineitem, ["l_suppkey", "l_partkey"], "l_orderkey")


@add("""SELECT p_partkey, CASE WHEN c = 1 THEN p_name ELSE p_name || coalesce(' (' || f || ')', '') END || CASE WHEN c > 1 AND c2 > 1 THEN ' #' || r ELSE '' END AS shown FROM
(SELECT *, count(*) OVER (PARTITION BY lower(p_name)) AS c, count(*) OVER (PARTITION BY lower(p_name), coalesce(lower(f), '')) AS c2, row_number() OVER (PARTITION BY lower(p_name), coalesce(lower(f), '') ORDER BY p_partkey) AS r FROM (SELECT *, nullif(p_brand, 'Brand#1') AS f FROM part))""")
def a_disambiguate(t: Tables) -> DataFrame:
    rows = t.part.withColumn("f", F.nullif(F.col("p_brand"), F.lit("Brand#1")))
    return dedup.disambiguated(rows, "p_name", "f", [F.col("p_partkey")]).select("p_partkey", "shown")


@add("SELECT event_id, CASE WHEN r = 1 THEN g ELSE g || '__' || r END AS unique_id FROM (SELECT event_id, g, row_number() OVER (PARTITION BY g ORDER BY event_id) AS r FROM (SELECT event_id, event_type || '_' || (user_id % 50) AS g FROM events))")
def a_unique_ids(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.concat("event_type", F.lit("_"), F.col("user_id") % 50).alias("g"))
    return dedup.unique_ids(rows, "g", [F.col("event_id")]).select("event_id", "unique_id")


@add("SELECT event_type, user_id, count(*) AS n, count(DISTINCT value) AS n_fields FROM events GROUP BY 1, 2 HAVING count(*) = count(DISTINCT value)")
def a_decision_groups(t: Tables) -> DataFrame:
    return dedup.decision_groups(t.events, ["event_type", "user_id"], "value")


@add("SELECT source AS chain, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_covered, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 1)::DOUBLE AS pct, CASE WHEN count(*) FILTER (WHERE quality = 1) = count(*) THEN 'full' WHEN count(*) FILTER (WHERE quality = 1) > 0 THEN 'partial' ELSE 'none' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a_coverage_pct(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select(F.col("source").alias("chain"), (F.col("quality") == 1).alias("covered"))
    return measures.coverage(rows, "chain", "covered")


@add("""WITH e AS (SELECT DISTINCT source, lang, doc_id % 9 AS item FROM documents WHERE n_chars >= 300), a AS (SELECT DISTINCT source, lang, doc_id % 9 AS item FROM documents WHERE n_chars < 3000 AND source <> 'src3'),
c AS (SELECT coalesce(e.source, a.source) AS source, count(*) FILTER (WHERE e.item IS NOT NULL AND a.item IS NOT NULL) AS m, count(*) FILTER (WHERE a.item IS NULL) AS miss, count(*) FILTER (WHERE e.item IS NULL) AS un FROM e FULL JOIN a ON e.source = a.source AND e.lang = a.lang AND e.item = a.item GROUP BY 1)
SELECT source, m AS n_match, miss AS n_missing, un AS n_unexpected, round(m::DOUBLE / nullif(m + un, 0), 6) AS precision, round(m::DOUBLE / nullif(m + miss, 0), 6) AS recall,
CASE WHEN m + un = 0 OR m + miss = 0 THEN NULL WHEN m = 0 THEN 0 ELSE round(2.0 * m / (2 * m + un + miss), 6) END::DOUBLE AS f1 FROM c""")
def m_precision_recall_f1(t: Tables) -> DataFrame:
    d = t.documents.withColumn("item", F.col("doc_id") % 9)
    return measures.compare_sets(d.filter("n_chars >= 300"), d.filter("n_chars < 3000 and source <> 'src3'"), ["lang", "item"], "source")


@add("SELECT lang, CASE WHEN bool_or(s = 'FAIL') THEN 'FAIL' WHEN bool_or(s = 'CHANGED') THEN 'CHANGED' ELSE 'PASS' END AS status, count(*) FILTER (WHERE s = 'FAIL') AS n_fail FROM (SELECT lang, CASE WHEN toxic = 1 AND lang = 'en' THEN 'FAIL' WHEN quality = 0 THEN 'CHANGED' ELSE 'PASS' END AS s FROM documents JOIN labels USING (doc_id)) GROUP BY lang")
def m_summary_status(t: Tables) -> DataFrame:
    s = F.when((F.col("toxic") == 1) & (F.col("lang") == "en"), "FAIL").when(F.col("quality") == 0, "CHANGED").otherwise("PASS")
    return t.documents.join(t.labels, "doc_id").withColumn("s", s).groupBy("lang").agg(measures.worst_status(F.col("s")).alias("status"), F.count_if(F.col("s") == "FAIL").alias("n_fail"))


@add("SELECT coalesce(nullif(trim(s), ''), 'unknown') AS stage, count(*) AS calls, count(*) FILTER (WHERE event_type <> 'error') AS successes, count(*) FILTER (WHERE event_type = 'error') AS failures, round(sum(value), 4) AS latency FROM (SELECT *, CASE WHEN user_id % 7 = 0 THEN '  ' WHEN user_id % 11 = 0 THEN NULL ELSE ' ' || event_type END AS s FROM events) GROUP BY 1")
def tel_stage_summary(t: Tables) -> DataFrame:
    s = F.when(F.col("user_id") % 7 == 0, "  ").when(F.col("user_id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "event_type"))
    failed = F.col("event_type") == "error"
    return t.events.groupBy(measures.stage_of(s).alias("stage")).agg(F.count("*").alias("calls"), F.count_if(~failed).alias("successes"), F.count_if(failed).alias("failures"), F.round(F.sum("value"), 4).alias("latency"))


@add("SELECT user_id, CAST(sum(x) AS BIGINT) AS total, CASE WHEN count(x) = 0 THEN 'unavailable' WHEN count(x) = count(*) THEN 'available' ELSE 'partial' END AS status FROM (SELECT user_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_id % 100 END AS x FROM events) GROUP BY user_id")
def tel_availability(t: Tables) -> DataFrame:
    x = F.when(F.col("event_type") != "view", F.col("event_id") % 100)
    return t.events.withColumn("x", x).groupBy("user_id").agg(measures.sum_if_known(F.col("x")).alias("total"), measures.availability(F.col("x")).alias("status"))


@add("SELECT user_id, round(h::DOUBLE / nullif(h + m, 0), 6) AS rate FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS h, count(*) FILTER (WHERE event_type = 'error') AS m FROM events GROUP BY 1)")
def tel_hit_rate(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("h"), F.count_if(F.col("event_type") == "error").alias("m"))
    return per.select("user_id", measures.hit_rate(F.col("h"), F.col("m")).alias("rate"))


@add("SELECT user_id, round((b - a) * 100.0 / nullif(a, 0), 4)::DOUBLE AS change FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS a, count(*) FILTER (WHERE event_type = 'click') AS b FROM events GROUP BY 1)")
def tel_pct_change(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    return per.select("user_id", measures.percentage_change(F.col("a"), F.col("b")).cast("double").alias("change"))


@add("SELECT user_id, event_id, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= 40 THEN 0 ELSE 1 END AS brk FROM events)")
def w_islands_gap2(t: Tables) -> DataFrame:
    """Runs whose neighbours are near by number."""
    return relate.islands(t.events.select("user_id", "event_id"), ["user_id"], "event_id", 40)


@add("SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations WHERE role = 'user') GROUP BY conv_id, run")
def w_adjacent_runs(t: Tables) -> DataFrame:
    rows = relate.islands(t.conversations.filter("role = 'user'").select("conv_id", "turn"), ["conv_id"], "turn", 1)
    return rows.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n")).drop("island")


@add("SELECT conv_id, turn, 'dependency_' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS VARCHAR), 4, '0') AS id FROM conversations")
def w_sequence_ids(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("dependency_"), F.lpad(n.cast("string"), 4, "0")).alias("id"))


@add("SELECT p_brand, p_partkey, CAST(ceil(r / 40.0) AS BIGINT) AS page FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)")
def w_pages(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t.part.select("p_brand", "p_partkey", F.ceil(n / 40).cast("long").alias("page"))


@add("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def x_window_tumbling(t: Tables) -> DataFrame:
    """An extension: tumbling windows of ten minutes."""
    w = F.window("ts", "10 minutes")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
