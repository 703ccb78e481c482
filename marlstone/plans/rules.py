"""Queries over rules, claims and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import dedup, rules
from marlstone.plans.common import Catalogue, Tables

CATALOGUE = Catalogue()
add = CATALOGUE.sql

_CHAINS = "SELECT o_orderkey // 30 AS object_id, o_orderkey // 3 AS chain_id, 'f' || (o_orderkey // 3 % 5) AS field, CAST(o_orderkey % 3 AS INTEGER) AS branch, 'amount > ' || o_orderkey AS condition, o_orderpriority AS outcome FROM orders"


def chains(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    chain = F.floor(k / 3)
    # all branches of a chain stand in one object
    return t.orders.select(F.floor(k / 30).alias("object_id"), chain.alias("chain_id"), F.concat(F.lit("f"), chain % 5).alias("field"), (k % 3).cast("int").alias("branch"), F.concat(F.lit("amount > "), k).alias("condition"), F.col("o_orderpriority").alias("outcome"))


def claims(t: Tables) -> DataFrame:
    """Chains told as rules: those of most fields, with gaps and changes."""
    told = chains(t).filter("field <> 'f1'")
    outcome = F.when(F.col("chain_id") % 5 == 0, "").when(F.col("chain_id") % 7 == 0, "OTHER").otherwise(F.col("outcome"))
    return told.select("object_id", F.concat(F.lit("r"), "chain_id").alias("rule_id"), F.col("chain_id").cast("int").alias("pos"), F.concat(F.lit("Rule on "), "field").alias("title"), F.concat(F.lit("A."), F.upper("field")).alias("field"), F.col("branch").alias("row"), F.concat(F.lit(" ("), F.upper("condition"), F.lit(") ")).alias("condition"), outcome.alias("outcome"))


@add(f"SELECT object_id, 'floor_' || chain_id AS rule_id, field, branch AS \"row\", condition, outcome FROM ({_CHAINS}) WHERE field = 'f1'")
def r_chain_floor(t: Tables) -> DataFrame:
    """Rules for the chains that no rule represents."""
    return rules.chain_floor(claims(t), chains(t)).select("object_id", "rule_id", "field", "row", "condition", "outcome")


@add(f"SELECT 'r' || chain_id AS rule_id, branch AS \"row\", CASE WHEN chain_id % 5 = 0 THEN outcome WHEN chain_id % 7 = 0 THEN 'OTHER' ELSE outcome END AS outcome FROM ({_CHAINS}) WHERE field <> 'f1'")
def r_backfilled(t: Tables) -> DataFrame:
    """Blank outcomes filled by field and condition."""
    own = chains(t).withColumn("field", F.col("field"))
    return rules.backfilled(claims(t), own).select("rule_id", "row", "outcome")


@add("SELECT 'write_' || o_orderkey || '_c' || (o_orderkey % 4) AS rule_id, 'c' || (o_orderkey % 4) AS field, 'status = ' || o_orderstatus AS condition FROM orders WHERE o_orderkey % 4 <> 1 AND o_orderstatus <> 'P' AND o_orderkey % 9 <> 0 AND o_orderkey % 11 <> 0")
def r_statement_floor(t: Tables) -> DataFrame:
    """One-row rules for gated writes that no rule covers."""
    k = F.col("o_orderkey")
    writes = t.orders.select(
        F.lit(1).alias("object_id"), k.alias("statement_id"), F.lit("t").alias("table_name"), F.concat(F.lit("c"), k % 4).alias("field"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("status = "), "o_orderstatus")).otherwise("").alias("predicate"),
        F.when(k % 9 == 0, "CASE WHEN 1=1 THEN 2 END").otherwise("1").alias("expression"), (k % 11 == 0).alias("in_ladder"),
    )
    told = t.spark.createDataFrame([(1, "x", 0, "t", "A.C1", 0, "a = 1", "1"), (1, "y", 0, "t", "C2", 0, " ", "1")], "object_id int, rule_id string, pos int, title string, field string, row int, condition string, outcome string")
    return rules.statement_floor(told, writes).select("rule_id", "field", "condition")


@add(f"SELECT 'r' || chain_id AS rule_id, CASE WHEN chain_id % 5 = 0 OR chain_id % 7 = 0 THEN 'CONFLICT' ELSE 'MATCHED' END AS status FROM ({_CHAINS}) WHERE field <> 'f1' GROUP BY ALL")
def r_grounded(t: Tables) -> DataFrame:
    """Rules that say what their chain says match, changed ones conflict."""
    return rules.grounded(claims(t), chains(t)).select("rule_id", "status")


@add("""SELECT doc_id, gap_review FROM (SELECT doc_id, n_chars < 500 AS gap_review FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, FALSE FROM documents WHERE n_chars >= 500 AND lang <> 'en')""")
def r_revised(t: Tables) -> DataFrame:
    before, returned = t.documents.filter("n_chars >= 500"), t.documents.filter("lang = 'en'")
    return rules.revised(before.select("doc_id"), returned.select("doc_id"), ["doc_id"])


@add("SELECT p_partkey, p_size > 25 AS grounded FROM part WHERE p_size IS NOT NULL")
def r_names_in_source(t: Tables) -> DataFrame:
    """Whole identifiers only; the name isn't a pattern."""
    source = F.when(F.col("p_size") > 25, "select A.Due.Date from x").otherwise("select A.Due.DateTime, DueXDate from x")
    claim = t.part.select("p_partkey", F.lit("due.date").alias("name"), source.alias("source"))
    return rules.names_in_source(claim, "name", "source").select("p_partkey", "grounded")


#: title, fields, condition, rows, evidence, eligible, and whether a filter takes it ("state": in objects with such a table)
_CASES = [
    ("Amount rule", ["Amount"], "", [("Amount is not null", "Update Amount")], "", False, True), ("Fields", ["b"], "", [("a, A.b are not null", "[B]")], "", False, True), ("Grade", ["g"], "", [("x is not null", "'A'")], "", False, False), ("Ladder", ["g"], "", [("x is null", "g"), ("ELSE", "h")], "", False, False),
    ("Update process status", ["Completed"], "", [("x = 1", "'Y'")], "", False, "state"), ("Customer completion bonus", ["Bonus"], "", [("x = 1", "'Y'")], "", False, False), ("Create #Staging table", [], "", [], "", False, True), ("Drop temporary table", [], "", [("x", "1"), ("y", "2")], "", False, False),
    ("Read balances", ["b"], "x = 1", [("x = 1", "1")], "", False, True), ("Update balance", ["b"], "", [], "UPDATE t", False, True), ("Update balance", ["b"], "", [], "UPDATE t", True, False), ("Balance look up", ["b"], "", [], "SELECT x FROM y", False, True),
]


@add(f"""SELECT o_orderkey AS rule_id FROM orders WHERE o_orderkey % {len(_CASES)} IN ({', '.join(str(i) for i, x in enumerate(_CASES) if x[-1] is False)}) OR (o_orderkey % {len(_CASES)} = 4 AND o_custkey % 2 = 1)""")
def r_filters(t: Tables) -> DataFrame:
    """The chain of filters: tautologies, bookkeeping, cleanup, bare operations."""
    case = F.col("o_orderkey") % len(_CASES)
    texts = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    pairs = lambda xs: F.array(*(F.struct(F.lit(c).alias("condition"), F.lit(o).alias("outcome")) for c, o in xs)) if xs else F.array().cast("array<struct<condition:string,outcome:string>>")
    of = lambda i, make: F.coalesce(*(F.when(case == n, make(x[i])) for n, x in enumerate(_CASES)))
    told = t.orders.select(
        F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("rule_id"), of(0, F.lit).alias("title"), F.lit("").alias("action"), F.lit(None).cast("string").alias("meaning"), of(1, texts).alias("fields"), of(2, F.lit).alias("condition"), of(3, pairs).alias("rows"), of(4, F.lit).alias("evidence"), of(5, F.lit).alias("eligible"),
    )
    c = F.col("c_custkey")
    tables = t.customer.select(c.alias("object_id"), F.when(c % 2 == 0, "PRO.RunningProcessStatus").otherwise("PRO.Accounts").alias("table_name"), F.lit("UPDATE").alias("operation"))
    kept = rules.without_cleanup(rules.without_bookkeeping(rules.without_tautologies(told), tables), tables)
    return rules.without_operations_only(kept).select("rule_id")


@add("""WITH RECURSIVE s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{2,3}')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f(conv_id, r, kept, words) AS (SELECT conv_id, 1, [turn], [w] FROM s WHERE r = 1 UNION ALL SELECT s.conv_id, s.r, CASE WHEN near THEN kept ELSE list_append(kept, s.turn) END, CASE WHEN near THEN words ELSE list_append(words, s.w) END FROM
(SELECT f.*, len(list_filter(f.words, lambda k: len(k) >= 4 AND len(n.w) >= 4 AND len(list_intersect(k, n.w)) >= 0.8 * least(len(k), len(n.w)))) > 0 AS near FROM f JOIN s n ON n.conv_id = f.conv_id AND n.r = f.r + 1) f JOIN s ON s.conv_id = f.conv_id AND s.r = f.r + 1)
SELECT conv_id, kept FROM f WHERE r = (SELECT max(r) FROM s WHERE s.conv_id = f.conv_id)""")
def a_drop_near_steps(t: Tables) -> DataFrame:
    """Steps near an earlier kept one are dropped, in order."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,3}"), F.lit(0)))
    return dedup.drop_near_steps(t.conversations.select("conv_id", "turn", words.alias("w")), "conv_id", "turn", "w")
