"""Evidence bookkeeping: order, destinations, versions, comparisons, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import relate, report
from marlstone.plans.common import Catalogue, Tables

CATALOGUE = Catalogue()
add = CATALOGUE.sql


@add("""SELECT o_custkey AS object_id, o_orderkey AS rule_id, row_number() OVER (PARTITION BY o_custkey ORDER BY first_line NULLS LAST, o_orderkey) AS place FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS first_line FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_orderkey = o_orderkey""")
def j_execution_order(t: Tables) -> DataFrame:
    """Rules by the first line of their evidence, unknown ones last."""
    rules = t.orders.select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("rule_id"), F.col("o_orderkey").alias("pos"))
    lines = t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("rule_id"), F.col("l_linenumber").alias("line"))
    return report.in_execution_order(rules, lines).select("object_id", "rule_id", "place")


@add("""SELECT c_custkey AS id, coalesce(dest, (SELECT string_agg(d, ', ' ORDER BY d) FROM (SELECT DISTINCT o_orderpriority AS d FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'))) AS destination FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'known' END AS dest FROM customer)""")
def j_calculation_destinations(t: Tables) -> DataFrame:
    """Where a calculation goes, taken from equal expressions if unknown."""
    calculations = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_custkey").alias("expression"), F.when(F.col("c_custkey") % 3 == 0, "known").alias("destination"))
    assigned = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("expression"), F.col("o_orderpriority").alias("destination"))
    return report.with_destinations(calculations, assigned).select("id", "destination")


@add("""WITH h AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 190000) SELECT o_orderkey, o_totalprice > 190000 AS direct FROM orders WHERE o_custkey IN (SELECT o_custkey FROM h)""")
def j_chain_siblings(t: Tables) -> DataFrame:
    """All branches of the chains that a rule touches."""
    branches = t.orders.select("o_custkey", "o_orderkey", (F.col("o_totalprice") > 190000).alias("direct"))
    return relate.siblings(branches, branches.filter("direct"), ["o_custkey"]).select("o_orderkey", "direct")


@add(f"""SELECT source, sha256(CAST(count(*) AS VARCHAR) || {' || '.join(f"'|' || CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(4))}) AS version, count(*) AS n FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source""")
def a_versions(t: Tables) -> DataFrame:
    """A version of a set of files, whatever their order."""
    return t.documents.groupBy("source").agg(report.version(F.col("text")).alias("version"), F.count("*").alias("n"))


@add("""WITH s AS (SELECT event_type, user_id % 2 AS side, count(*) AS n, round(sum(value), 2) AS v, list_sort(list(DISTINCT user_id % 7)) AS u FROM events GROUP BY 1, 2)
SELECT a.event_type, round((b.n - a.n) * 100.0 / nullif(a.n, 0), 4)::DOUBLE AS n_change, round((b.v - a.v) * 100.0 / nullif(a.v, 0), 4)::DOUBLE AS v_change, list_filter(['n', 'v', 'u'], lambda k: CASE k WHEN 'n' THEN a.n IS DISTINCT FROM b.n WHEN 'v' THEN a.v IS DISTINCT FROM b.v ELSE a.u IS DISTINCT FROM b.u END) AS differs
FROM s a JOIN s b ON a.event_type = b.event_type AND a.side = 0 AND b.side = 1""")
def tel_compare_runs(t: Tables) -> DataFrame:
    """Two runs: changes in per cent, and the names of what differs."""
    snapshot = t.events.groupBy("event_type", (F.col("user_id") % 2).alias("side")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"), F.array_sort(F.collect_set(F.col("user_id") % 7)).alias("u"))
    base, now = snapshot.filter("side = 0"), snapshot.filter("side = 1")
    return report.compare_runs(base, now, ["event_type"], ["n", "v"], ["n", "v", "u"]).select("event_type", F.col("n_change").cast("double").alias("n_change"), F.col("v_change").cast("double").alias("v_change"), "differs")


@add("""SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM events) WHERE event_type = 'click' GROUP BY user_id, event_type, run HAVING count(*) >= 2""")
def w_update_runs(t: Tables) -> DataFrame:
    """Runs of two or more neighbouring statements of one kind."""
    runs = report.same_kind_runs(t.events, ["user_id"], ["event_type"], "event_id").filter("event_type = 'click'")
    return runs.groupBy("user_id", "event_type", "run").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).filter("n >= 2").select("user_id", "first_event", "n")


@add("""SELECT class, count(*) AS n, count(DISTINCT o_custkey) AS n_objects, min(o_orderkey) AS first_item FROM (SELECT *, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 150000 THEN 'HIGH' WHEN o_orderstatus = 'P' THEN 'MEDIUM' ELSE 'LOW' END AS class FROM orders) GROUP BY class""")
def a_classification_summary(t: Tables) -> DataFrame:
    c = F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 150000), "HIGH").when(F.col("o_orderstatus") == "P", "MEDIUM").otherwise("LOW")
    return t.orders.groupBy(c.alias("class")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_objects"), F.min("o_orderkey").alias("first_item"))


@add("""SELECT e.event_id, e.user_id FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events h WHERE h.event_type = 'error' AND h.user_id = e.user_id AND h.event_id BETWEEN e.event_id - 20 AND e.event_id + 20)""")
def j_outside_handlers(t: Tables) -> DataFrame:
    """Rows in no span of a handler, a range anti-join in equal cells."""
    points = t.events.filter("event_type <> 'error'").select("event_id", "user_id", F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"))
    handlers = t.events.filter("event_type = 'error'").select("user_id", (F.col("event_id") - 20).alias("r_start"), (F.col("event_id") + 21).alias("r_end"))
    inside = relate.overlap_join(points, handlers, ["user_id"], 64).select("event_id")
    return points.join(inside, "event_id", "left_anti").select("event_id", "user_id")


@add("""SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)""")
def j_deterministic_only(t: Tables) -> DataFrame:
    """Writes that no rule names, by chunk or by statement."""
    chunk = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    statement = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(chunk, "o_orderkey", "left_anti").join(statement, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@add("""SELECT event_id, user_id, value FROM events e WHERE NOT (event_type = 'view' AND EXISTS (SELECT 1 FROM events u WHERE u.user_id = e.user_id AND u.event_type IN ('click', 'signup') AND u.event_id // 50 = e.event_id // 50))""")
def a_reportable_operations(t: Tables) -> DataFrame:
    """Reads go where the same statement updates the same table."""
    ops = t.events.withColumn("statement", F.floor(F.col("event_id") / 50))
    changed = ops.filter("event_type in ('click', 'signup')").select("user_id", "statement")
    reads = ops.filter("event_type = 'view'").join(changed, ["user_id", "statement"], "left_anti")
    return ops.filter("event_type <> 'view'").unionByName(reads).select("event_id", "user_id", "value")


@add("""SELECT k, field, (SELECT max(n) FROM (SELECT count(*) AS n FROM orders WHERE o_custkey = k AND 'f' || (o_orderkey % 3) = field)) AS n FROM (SELECT DISTINCT o_custkey AS k, 'f' || (o_orderkey % 3) AS field FROM orders) WHERE (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_custkey = k AND 'f' || (o_orderkey % 3) = field) >= 2""")
def a_qualified_ladders(t: Tables) -> DataFrame:
    """A ladder is a decision if a field is assigned in two branches."""
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.concat(F.lit("f"), F.col("o_orderkey") % 3).alias("field"), F.col("o_orderstatus").alias("branch"))
    return rows.groupBy("k", "field").agg(F.count("*").alias("n"), F.count_distinct("branch").alias("b")).filter("b >= 2").drop("b")


@add("SELECT event_type, section, count(*) AS n FROM (SELECT event_type, unnest(['all', CASE WHEN value > 50 THEN 'large' END]) AS section FROM events) WHERE section IS NOT NULL GROUP BY 1, 2")
def a_evidence_sections(t: Tables) -> DataFrame:
    """Union of evidence sections, each row with its section."""
    whole = t.events.withColumn("section", F.lit("all"))
    return whole.unionByName(t.events.filter("value > 50").withColumn("section", F.lit("large"))).groupBy("event_type", "section").agg(F.count("*").alias("n"))
