"""UPDATE, INSERT, DELETE, MERGE, histories, and procedures as sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import dml
from marlstone.plans.common import DAY, Catalogue, Tables
from marlstone.plans.select import _AGE, _PRIORITY, age, priority

CATALOGUE = Catalogue()
add = CATALOGUE.sql
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, nullif(o_orderpriority, '4-NOT SPECIFIED') AS class FROM orders"


def orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", priority().alias("class"))


@add(f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN class < '3' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, CASE WHEN class < '3' THEN 'RAISED' ELSE class END AS class FROM ({_ORDERS})")
def d_update_where(t: Tables) -> DataFrame:
    """A null predicate changes nothing; assignments read old values."""
    return dml.update(orders(t), {"o_totalprice": F.col("o_totalprice") + 100, "class": F.lit("RAISED")}, F.col("class") < "3")


_BEST_LINE = "SELECT * FROM (SELECT l_orderkey, l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1"


@add(f"SELECT o_orderkey, o_custkey, CASE WHEN l_returnflag = 'R' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN l_returnflag = 'R' THEN o_totalprice - l_quantity ELSE o_totalprice END AS o_totalprice, class FROM ({_ORDERS}) LEFT JOIN ({_BEST_LINE}) ON o_orderkey = l_orderkey")
def d_update_from_join(t: Tables) -> DataFrame:
    """The dearest line of an order decides, as several match."""
    lines = dml.one_row_per_key(t.lineitem, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity")
    return dml.update_from(orders(t), lines, ["o_orderkey"], {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") - F.col("s_l_quantity")}, F.col("s_l_returnflag") == "R")


@add(f"SELECT o_orderkey, o_custkey, coalesce(class, 'N') AS o_orderstatus, o_totalprice, o_orderstatus AS class FROM ({_ORDERS})")
def d_update_multi_old_values(t: Tables) -> DataFrame:
    """A swap: both sides read the row as it was."""
    return dml.update(orders(t), {"o_orderstatus": F.coalesce("class", F.lit("N")), "class": F.col("o_orderstatus")})


@add(f"""WITH a AS (SELECT * REPLACE (CASE WHEN o_totalprice > 150000 THEN 'A' ELSE class END AS class) FROM ({_ORDERS})),
b AS (SELECT * REPLACE (CASE WHEN class = 'A' AND o_orderstatus = 'O' THEN 'B' ELSE class END AS class) FROM a)
SELECT * REPLACE (CASE WHEN class = 'B' AND o_totalprice > 180000 THEN 'C' WHEN class = 'A' AND o_totalprice > 180000 THEN 'D' ELSE class END AS class) FROM b""")
def d_update_sequential(t: Tables) -> DataFrame:
    """Later updates read and override what earlier ones wrote."""
    c, price = F.col("class"), F.col("o_totalprice")
    last = {"class": F.when(c == "B", "C").otherwise("D")}
    return dml.update_sequence(orders(t), [({"class": F.lit("A")}, price > 150000), ({"class": F.lit("B")}, (c == "A") & (F.col("o_orderstatus") == "O")), (last, c.isin("A", "B") & (price > 180000))])


@add(f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN class IS NOT NULL THEN class WHEN o_orderstatus = 'F' THEN 'FINAL' WHEN o_totalprice > 100000 THEN 'LARGE' ELSE NULL END AS class FROM ({_ORDERS})""")
def d_update_fill_null(t: Tables) -> DataFrame:
    """Fill if null, in order: the first match wins."""
    empty = F.col("class").isNull()
    return dml.update_sequence(orders(t), [({"class": F.lit("FINAL")}, empty & (F.col("o_orderstatus") == "F")), ({"class": F.lit("LARGE")}, empty & (F.col("o_totalprice") > 100000))])


@add(f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, class FROM ({_ORDERS}) WHERE o_orderstatus <> 'F' UNION ALL
SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 100000 THEN 'L' ELSE 'S' END, o_totalprice, NULL FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT -1, 0, 'N', 0, 'FIXED'""")
def d_insert_select(t: Tables) -> DataFrame:
    """INSERT .. SELECT with a CASE column, and INSERT .. VALUES."""
    table = orders(t).filter("o_orderstatus <> 'F'")
    rows = orders(t).filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") > 100000, "L").otherwise("S").alias("o_orderstatus"), "o_totalprice")
    fixed = t.spark.createDataFrame([(-1, 0, "N", 0.0, "FIXED")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, class string")
    return dml.insert(dml.insert(table, rows), fixed)


@add(f"SELECT * FROM ({_ORDERS}) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND NOT coalesce(class = '1-URGENT', FALSE)")
def d_delete_subquery(t: Tables) -> DataFrame:
    bad = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return dml.delete(dml.delete_in(orders(t), bad, ["o_custkey"]), F.col("class") == "1-URGENT")


@add(f"SELECT * FROM ({_ORDERS}) WHERE o_orderstatus = 'P'")
def d_truncate_reload(t: Tables) -> DataFrame:
    """Empty the table, then load the new snapshot."""
    return dml.insert(dml.truncate(orders(t)), orders(t).filter("o_orderstatus = 'P'"))


_TARGET = "SELECT o_orderkey AS k, o_totalprice AS balance, 1 AS hits FROM orders WHERE o_orderstatus <> 'P'"
_SOURCE = "SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS amount, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey"


def target(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("balance"), F.lit(1).alias("hits"))


def source(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.count("*").alias("n"))


@add(f"SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NULL OR s.k IS NOT NULL THEN amount ELSE balance END AS balance, CAST(CASE WHEN t.k IS NULL THEN 0 ELSE hits END AS INTEGER) AS hits FROM ({_TARGET}) t FULL JOIN ({_SOURCE}) s ON t.k = s.k")
def d_merge_upsert(t: Tables) -> DataFrame:
    return dml.merge(target(t), source(t), ["k"], matched={"balance": F.col("s_amount")}, insert_values={"k": F.col("s_k"), "balance": F.col("s_amount"), "hits": F.lit(0)})


@add(f"SELECT coalesce(t.k, s.k) AS k, round(coalesce(balance, 0) + coalesce(amount, 0), 2) AS balance, CAST(coalesce(hits, 0) + coalesce(n, 0) AS INTEGER) AS hits FROM ({_TARGET}) t FULL JOIN ({_SOURCE}) s ON t.k = s.k")
def d_merge_accumulate(t: Tables) -> DataFrame:
    """Matched rows add up; the source is aggregated to one row a key."""
    both = {"balance": F.round(F.col("balance") + F.col("s_amount"), 2), "hits": F.col("hits") + F.col("s_n")}
    merged = dml.merge(target(t), source(t), ["k"], matched=both, insert_values={"k": F.col("s_k"), "balance": F.col("s_amount"), "hits": F.col("s_n")})
    return merged.withColumn("balance", F.round("balance", 2))


@add(f"SELECT t.k, CASE WHEN amount > 50000 THEN amount ELSE balance END AS balance, hits FROM ({_TARGET}) t LEFT JOIN ({_SOURCE}) s ON t.k = s.k")
def d_merge_matched_only(t: Tables) -> DataFrame:
    return dml.merge(target(t), source(t), ["k"], matched={"balance": F.col("s_amount")}, matched_if=F.col("s_amount") > 50000)


@add(f"SELECT coalesce(t.k, s.k) AS k, CASE WHEN s.k IS NULL THEN 0 ELSE amount END AS balance, CASE WHEN t.k IS NULL THEN 7 ELSE hits END AS hits FROM ({_TARGET}) t FULL JOIN ({_SOURCE}) s ON t.k = s.k WHERE t.k IS NOT NULL OR n > 1")
def d_merge_by_source(t: Tables) -> DataFrame:
    """Branch conditions, and rows that the source lacks."""
    return dml.merge(
        target(t), source(t), ["k"], matched={"balance": F.col("s_amount")}, insert_values={"k": F.col("s_k"), "balance": F.col("s_amount"), "hits": F.lit(7)}, insert_if=F.col("s_n") > 1, by_source={"balance": F.lit(0.0)}
    )


_HISTORY = "SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nation, 100 AS valid_from, 49999 AS valid_to FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 'OLD', c_nationkey, 50, 99 FROM customer WHERE c_acctbal > 5000"
_INCOMING = "SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_nationkey AS nation FROM customer WHERE c_nationkey <> 6"


@add(f"""WITH h AS ({_HISTORY}), i AS ({_INCOMING})
SELECT h.k, h.seg, h.nation, h.valid_from, CAST(CASE WHEN h.valid_to = 49999 AND NOT EXISTS (SELECT 1 FROM i WHERE i.k = h.k AND i.seg IS NOT DISTINCT FROM h.seg AND i.nation IS NOT DISTINCT FROM h.nation) THEN 199 ELSE h.valid_to END AS INTEGER) AS valid_to FROM h
UNION ALL SELECT i.k, i.seg, i.nation, 200, 49999 FROM i WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.k = i.k AND h.valid_to = 49999 AND h.seg IS NOT DISTINCT FROM i.seg AND h.nation IS NOT DISTINCT FROM i.nation)""")
def d_scd2(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    base = t.customer
    first = base.filter("c_acctbal >= 0").select(k.alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"), F.lit(100).alias("valid_from"), F.lit(49999).alias("valid_to"))
    past = base.filter("c_acctbal > 5000").select(k.alias("k"), F.lit("OLD").alias("seg"), F.col("c_nationkey").alias("nation"), F.lit(50).alias("valid_from"), F.lit(99).alias("valid_to"))
    seg = F.when(k % 7 == 0, "NEW").when(k % 11 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    incoming = base.filter("c_nationkey <> 6").select(k.alias("k"), seg.alias("seg"), F.col("c_nationkey").alias("nation"))
    return dml.scd2(first.unionByName(past), incoming, "k", ["seg", "nation"], 200)


@add(f"""WITH flag AS (SELECT EXISTS (SELECT 1 FROM orders WHERE {_AGE} > 3000) AS a, EXISTS (SELECT 1 FROM orders WHERE {_AGE} > 900) AS b)
SELECT o_orderkey, CASE WHEN a THEN CASE WHEN {_AGE} > 3000 THEN 'LOSS' ELSE o_orderstatus END WHEN b THEN CASE WHEN {_AGE} > 900 THEN 'DOUBT' ELSE o_orderstatus END ELSE 'NONE' END AS state FROM orders, flag""")
def p_if_exists_global(t: Tables) -> DataFrame:
    """Which UPDATE runs is decided once; which rows it takes, by row."""
    flag = t.orders.agg(F.coalesce(F.bool_or(age() > 3000), F.lit(False)).alias("a"), F.coalesce(F.bool_or(age() > 900), F.lit(False)).alias("b"))
    first, second = F.when(age() > 3000, "LOSS").otherwise(F.col("o_orderstatus")), F.when(age() > 900, "DOUBT").otherwise(F.col("o_orderstatus"))
    return t.orders.join(F.broadcast(flag)).select("o_orderkey", F.when(F.col("a"), first).when(F.col("b"), second).otherwise("NONE").alias("state"))


@add(f"""SELECT o_custkey, max(CASE WHEN {_AGE} > 90 THEN 3 WHEN {_AGE} > 30 THEN 2 ELSE 1 END) AS worst, round(sum(CASE WHEN {_AGE} > 90 THEN o_totalprice * 2 WHEN {_AGE} > 30 THEN o_totalprice ELSE 0 END), 2) AS fee_points, count(*) AS n
FROM orders WHERE o_orderstatus <> 'F' AND {_AGE} > 0 GROUP BY o_custkey""")
def p_cursor_setwise(t: Tables) -> DataFrame:
    """A cursor's ladder, update and upsert as one grouped CASE."""
    fee = F.when(age() > 90, F.col("o_totalprice") * 2).when(age() > 30, F.col("o_totalprice")).otherwise(0.0)
    worst = F.when(age() > 90, 3).when(age() > 30, 2).otherwise(1)
    return t.orders.filter((F.col("o_orderstatus") != "F") & (age() > 0)).groupBy("o_custkey").agg(F.max(worst).alias("worst"), F.round(F.sum(fee), 2).alias("fee_points"), F.count("*").alias("n"))


@add(f"""SELECT o_orderkey, CASE WHEN n IS NULL THEN 'NO DATA' WHEN {_AGE} > 90 THEN CASE WHEN n > 4 THEN 'NPA-MANY' ELSE 'NPA' END WHEN {_PRIORITY} IS NULL THEN 'UNRATED' ELSE 'STANDARD' END AS state
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def p_nested_ladder(t: Tables) -> DataFrame:
    """SELECT INTO that may find nothing, then a nested ladder."""
    lines = t.lineitem.filter("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    npa = F.when(F.col("n") > 4, "NPA-MANY").otherwise("NPA")
    state = F.when(F.col("n").isNull(), "NO DATA").when(age() > 90, npa).when(priority().isNull(), "UNRATED").otherwise("STANDARD")
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", state.alias("state"))


@add(f"SELECT step, coalesce(max(runs), 0) + 1 AS runs FROM (SELECT event_type AS step, count(*) AS runs FROM events GROUP BY 1 UNION ALL SELECT 'batch {DAY}', NULL) GROUP BY step")
def p_run_status(t: Tables) -> DataFrame:
    """Run counters: one more than before, one for the first run."""
    done = t.events.groupBy(F.col("event_type").alias("step")).agg(F.count("*").alias("runs"))
    fresh = t.spark.createDataFrame([(f"batch {DAY}", None)], "step string, runs long")
    return done.unionByName(fresh).groupBy("step").agg((F.coalesce(F.max("runs"), F.lit(0)) + 1).alias("runs"))


@add("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT * FROM (VALUES (-1, 7, 'N', CAST(1.5 AS DOUBLE)), (-2, NULL, NULL, NULL)) v")
def d_insert_values(t: Tables) -> DataFrame:
    """INSERT .. VALUES; a column that a row lacks is null."""
    table = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    one = t.spark.createDataFrame([(-1, 7, "N", 1.5)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    return dml.insert(dml.insert(table, one), t.spark.createDataFrame([(-2,)], "o_orderkey long"))


@add("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'LARGE' WHEN o_totalprice > 50000 THEN 'MEDIUM' ELSE 'SMALL' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
def d_insert_case(t: Tables) -> DataFrame:
    """INSERT with CASE columns; a simple CASE without ELSE gives null."""
    empty = t.spark.createDataFrame([], "o_orderkey long, size string, code int")
    size = F.when(F.col("o_totalprice") > 150000, "LARGE").when(F.col("o_totalprice") > 50000, "MEDIUM").otherwise("SMALL")
    code = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
    return dml.insert(empty, t.orders.select("o_orderkey", size.alias("size"), code.alias("code")))


@add("WITH late AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P') SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM late GROUP BY o_custkey")
def d_select_into(t: Tables) -> DataFrame:
    """SELECT .. INTO a working table that the next statement reads."""
    t.orders.filter("o_orderstatus = 'P'").select("o_custkey", "o_totalprice").createOrReplaceTempView("late_orders")
    return t.spark.sql("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM late_orders GROUP BY o_custkey")


@add("SELECT o_orderkey, CASE WHEN (SELECT max(o_totalprice) FROM orders) > 100000 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders")
def p_scalar_if(t: Tables) -> DataFrame:
    """A variable, set once, decides which assignment all rows get."""
    most = t.orders.agg(F.max("o_totalprice").alias("most"))
    return t.orders.join(F.broadcast(most)).select("o_orderkey", F.when(F.col("most") > 100000, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")).alias("price"))


@add("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS price, CASE WHEN o_custkey % 2 = 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey % 2 = 0) THEN 'FAILED' ELSE 'DONE' END AS state FROM orders""")
def p_try_catch(t: Tables) -> DataFrame:
    """A statement that fails for any row is undone whole; its handler runs."""
    def attempt(rows: DataFrame, fails: Column) -> DataFrame:
        after = dml.update(rows, {"price": F.col("price") + 1}).withColumn("state", F.lit("DONE"))
        return dml.attempted(after, rows.withColumn("state", F.lit("FAILED")), rows.select(fails.alias("fails")))

    base = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    even, odd = base.filter("o_custkey % 2 = 0"), base.filter("o_custkey % 2 = 1")
    both = attempt(even, F.col("o_orderkey") % 5 == 0).unionByName(attempt(odd, F.col("o_orderkey") < 0))
    return both.select("o_orderkey", "price", "state")


@add("""SELECT o_custkey, o_orderkey, CASE WHEN before THEN CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'RUN' END ELSE 'BLOCKED' END AS state FROM (SELECT *, coalesce(bool_and(o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS before FROM orders)""")
def p_checkpointed_steps(t: Tables) -> DataFrame:
    """Steps of a run: done ones aren't repeated, later ones wait for all before."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    ready = F.coalesce(F.bool_and(F.col("o_orderstatus") == "F").over(before), F.lit(True))
    state = F.when(~F.col("ready"), "BLOCKED").when(F.col("o_orderstatus") == "F", "DONE").otherwise("RUN")
    return t.orders.withColumn("ready", ready).select("o_custkey", "o_orderkey", state.alias("state"))
