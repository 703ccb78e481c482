"""Selections, cases, joins, subqueries, aggregates and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.common import DAY, Catalogue, Tables

CATALOGUE = Catalogue()
add = CATALOGUE.sql

_AGE = f"date_diff('day', CAST(o_orderdate AS DATE), DATE '{DAY}')"
_LADDER = f"CASE WHEN {_AGE} <= 0 THEN 'NOT DUE' WHEN {_AGE} <= 30 THEN 'SMA-0' WHEN {_AGE} <= 60 THEN 'SMA-1' WHEN {_AGE} <= 90 THEN 'SMA-2' ELSE 'NPA' END"
_PRIORITY = "nullif(o_orderpriority, '4-NOT SPECIFIED')"


def age():
    return F.datediff(F.lit(DAY).cast("date"), F.col("o_orderdate").cast("date"))


def ladder():
    return F.when(age() <= 0, "NOT DUE").when(age() <= 30, "SMA-0").when(age() <= 60, "SMA-1").when(age() <= 90, "SMA-2").otherwise("NPA")


def priority():
    return F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"))


@add(f"SELECT bucket, count(*) AS n_orders, round(sum(o_totalprice), 2) AS balance, count(priority) AS n_rated FROM (SELECT {_LADDER} AS bucket, o_totalprice, {_PRIORITY} AS priority FROM orders) GROUP BY bucket")
def s_dpd_bucket_summary(t: Tables) -> DataFrame:
    """Overdue days to buckets, counted and summed."""
    return t.orders.select(ladder().alias("bucket"), "o_totalprice", priority().alias("priority")).groupBy("bucket").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("balance"), F.count("priority").alias("n_rated"))


@add(f"""SELECT o_orderkey, CASE {_PRIORITY} WHEN '1-URGENT' THEN 15 WHEN '2-HIGH' THEN 25 WHEN '3-MEDIUM' THEN 40 ELSE 100 END AS pct,
CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 100000 THEN 'FULL LARGE' ELSE 'FULL SMALL' END
     WHEN o_orderstatus = 'P' THEN CASE WHEN {_PRIORITY} IS NULL THEN 'PART UNRATED' ELSE 'PART' END ELSE 'OPEN' END AS cover FROM orders""")
def s_case_simple_nested(t: Tables) -> DataFrame:
    p = priority()
    pct = F.when(p == "1-URGENT", 15).when(p == "2-HIGH", 25).when(p == "3-MEDIUM", 40).otherwise(100)
    full = F.when(F.col("o_totalprice") > 100000, "FULL LARGE").otherwise("FULL SMALL")
    part = F.when(p.isNull(), "PART UNRATED").otherwise("PART")
    cover = F.when(F.col("o_orderstatus") == "F", full).when(F.col("o_orderstatus") == "P", part).otherwise("OPEN")
    return t.orders.select("o_orderkey", pct.alias("pct"), cover.alias("cover"))


@add(f"SELECT o_orderkey, CASE WHEN {_AGE} > 90 THEN 'SUB' WHEN {_AGE} > 60 THEN 'WATCH' END AS class FROM orders WHERE CASE WHEN {_PRIORITY} IS NULL THEN 1 WHEN {_AGE} > 30 THEN 1 ELSE 0 END = 1")
def s_case_no_else(t: Tables) -> DataFrame:
    """A CASE without ELSE gives null; a CASE stands in the filter."""
    wanted = F.when(priority().isNull(), 1).when(age() > 30, 1).otherwise(0) == 1
    return t.orders.filter(wanted).select("o_orderkey", F.when(age() > 90, "SUB").when(age() > 60, "WATCH").alias("class"))


@add("""SELECT o_orderkey, CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 1 THEN 'STD' WHEN 2 THEN 'SUB' WHEN 3 THEN 'DBT' END AS chosen,
coalesce(nullif(o_orderstatus, 'P'), nullif(o_orderpriority, '5-LOW'), 'NONE') AS first_known FROM orders""")
def s_choose_coalesce(t: Tables) -> DataFrame:
    """CHOOSE out of range is null."""
    at = (F.col("o_orderkey") % 5).cast("int")
    chosen = F.get(F.array(F.lit("STD"), F.lit("SUB"), F.lit("DBT")), at - 1)
    known = F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("NONE"))
    return t.orders.select("o_orderkey", chosen.alias("chosen"), known.alias("first_known"))


@add(f"""SELECT o_orderkey FROM orders WHERE {_PRIORITY} <> '1-URGENT' AND o_totalprice BETWEEN 50000 AND 150000
AND o_orderstatus IN ('O', 'P') AND {_PRIORITY} NOT IN ('5-LOW') AND NOT (o_orderstatus = 'P' AND o_totalprice > 120000)""")
def s_filter_threeval(t: Tables) -> DataFrame:
    """Conjunctions over a column with nulls."""
    p = priority()
    late = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 120000)
    return t.orders.filter((p != "1-URGENT") & F.col("o_totalprice").between(50000, 150000) & F.col("o_orderstatus").isin("O", "P") & ~p.isin("5-LOW") & ~late).select("o_orderkey")


@add(f"SELECT coalesce({_PRIORITY}, 'NONE') AS class, count(*) AS n FROM orders WHERE coalesce({_PRIORITY}, '0') < '3' OR o_totalprice IS NULL GROUP BY 1")
def s_null_default(t: Tables) -> DataFrame:
    return t.orders.filter((F.coalesce(priority(), F.lit("0")) < "3") | F.col("o_totalprice").isNull()).groupBy(F.coalesce(priority(), F.lit("NONE")).alias("class")).agg(F.count("*").alias("n"))


_BEFORE = "SELECT o_orderkey AS k, nullif(o_orderpriority, '4-NOT SPECIFIED') AS was FROM orders WHERE o_orderstatus <> 'P'"
_AFTER = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN '1-URGENT' WHEN o_orderkey % 11 = 0 THEN '' ELSE nullif(o_orderpriority, '4-NOT SPECIFIED') END AS is_now FROM orders"


@add(f"SELECT a.k, was, is_now FROM ({_BEFORE}) b RIGHT JOIN ({_AFTER}) a ON a.k = b.k WHERE coalesce(was, '') <> coalesce(is_now, '')")
def s_change_detect_right(t: Tables) -> DataFrame:
    """Changed or new rows; null and '' count as the same."""
    k = F.col("o_orderkey")
    before = t.orders.filter("o_orderstatus <> 'P'").select(k.alias("kb"), priority().alias("was"))
    after = t.orders.select(k.alias("k"), F.when(k % 7 == 0, "1-URGENT").when(k % 11 == 0, "").otherwise(priority()).alias("is_now"))
    return before.join(after, F.col("k") == F.col("kb"), "right").filter(F.coalesce("was", F.lit("")) != F.coalesce("is_now", F.lit(""))).select("k", "was", "is_now")


@add("""SELECT n_name, p_brand, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(12, 2)))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
WHERE o_orderstatus = 'F' AND p_size > 10 AND l_quantity <= 40 GROUP BY n_name, p_brand""")
def s_join_chain(t: Tables) -> DataFrame:
    lines = t.lineitem.filter("l_quantity <= 40").join(t.orders.filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = lines.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = named.join(t.part.filter("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"))
    return parts.groupBy("n_name", "p_brand").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(12,2)"))).cast("double").alias("revenue"))


_RATES = "SELECT * FROM (VALUES ('F', DATE '1990-01-01', DATE '1996-12-31', 5), ('F', DATE '1997-01-01', DATE '2099-12-31', 7), ('O', DATE '1990-01-01', DATE '1998-06-30', 3), ('O', DATE '1998-07-01', DATE '2099-12-31', 4)) r(status, valid_from, valid_to, rate)"


@add(f"SELECT status, rate, count(*) AS n, round(sum(o_totalprice * rate / 100), 2) AS charge FROM orders JOIN ({_RATES}) r ON o_orderstatus = status AND CAST(o_orderdate AS DATE) >= valid_from AND CAST(o_orderdate AS DATE) <= valid_to GROUP BY status, rate")
def s_temporal_validity(t: Tables) -> DataFrame:
    """The version of a dimension that was valid on the row's day."""
    rows = [("F", "1990-01-01", "1996-12-31", 5), ("F", "1997-01-01", "2099-12-31", 7), ("O", "1990-01-01", "1998-06-30", 3), ("O", "1998-07-01", "2099-12-31", 4)]
    rates = t.spark.createDataFrame(rows, "status string, valid_from string, valid_to string, rate int").withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")})
    day = F.col("o_orderdate").cast("date")
    # four literal rows
    valid = t.orders.join(F.broadcast(rates), (F.col("o_orderstatus") == F.col("status")) & (day >= F.col("valid_from")) & (day <= F.col("valid_to")))
    return valid.groupBy("status", "rate").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice") * F.col("rate") / 100), 2).alias("charge"))


@add("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 180000)")
def s_semi_exists(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 180000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@add("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def s_anti_not_exists(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@add("SELECT o_orderkey FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') r ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
def s_anti_left_null(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey HAVING count(*) > 2)")
def s_in_subquery(t: Tables) -> DataFrame:
    often = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").count().filter("count > 2")
    return t.orders.join(often, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@add("SELECT a.c_custkey, b.c_custkey AS peer FROM (SELECT c_custkey, c_nationkey, nullif(c_mktsegment, 'FURNITURE') AS seg FROM customer WHERE c_acctbal > 9500) a JOIN (SELECT c_custkey, c_nationkey, nullif(c_mktsegment, 'FURNITURE') AS seg FROM customer WHERE c_acctbal < -900) b ON a.c_nationkey = b.c_nationkey AND a.seg = b.seg")
def s_join_two_keys_null(t: Tables) -> DataFrame:
    """Null keys never match."""
    seg = F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("seg")
    rich = t.customer.filter("c_acctbal > 9500").select("c_custkey", "c_nationkey", seg)
    poor = t.customer.filter("c_acctbal < -900").select(F.col("c_custkey").alias("peer"), "c_nationkey", seg)
    return rich.join(poor, ["c_nationkey", "seg"]).select("c_custkey", "peer")


@add("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS last_day FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def s_latest_per_key_ties(t: Tables) -> DataFrame:
    """All rows of the latest day of each key; ties stay."""
    last = F.max("o_orderdate").over(Window.partitionBy("o_custkey"))
    return t.orders.withColumn("last", last).filter("o_orderdate = last").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("last_day"))


@add(f"SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND CAST(o_orderdate AS DATE) >= DATE '{DAY}' - INTERVAL 365 DAY AND CAST(o_orderdate AS DATE) < DATE '{DAY}') AS n_year FROM customer")
def s_lookback_count(t: Tables) -> DataFrame:
    day, end = F.col("o_orderdate").cast("date"), F.lit(DAY).cast("date")
    year = t.orders.filter((day >= F.date_sub(end, 365)) & (day < end)).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(year, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_year"))


@add("SELECT o_orderkey, round(o_totalprice - coalesce((SELECT sum(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'), 0), 2) AS remaining, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 6) AS share FROM orders")
def s_scalar_sum_remaining(t: Tables) -> DataFrame:
    """A correlated sum and an uncorrelated scalar."""
    back = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("back"))
    most = t.orders.agg(F.max("o_totalprice").alias("most"))
    return t.orders.join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(F.broadcast(most)).select("o_orderkey", F.round(F.col("o_totalprice") - F.coalesce("back", F.lit(0.0)), 2).alias("remaining"), F.round(F.col("o_totalprice") / F.col("most"), 6).alias("share"))


@add("SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def s_group_having(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")).filter("n > 1")


@add("""SELECT o_custkey, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END) AS worst_rank, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS most_final,
min(o_orderpriority) AS first_class, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY o_custkey""")
def s_max_case_rollup(t: Tables) -> DataFrame:
    """Conditional maxima; the least class is the first by alphabet."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    return t.orders.groupBy("o_custkey").agg(F.max(rank).alias("worst_rank"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("most_final"), F.min("o_orderpriority").alias("first_class"), F.min(F.col("o_orderdate").cast("date")).alias("first_day"))


@add("SELECT l_orderkey, max(amount) AS largest FROM (SELECT l_orderkey, l_quantity AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_discount * 100 FROM lineitem UNION ALL SELECT l_orderkey, l_tax * 1000 FROM lineitem) GROUP BY l_orderkey")
def s_union_unpivot_max(t: Tables) -> DataFrame:
    """The union of columns is read once, as a stack."""
    stacked = t.lineitem.select("l_orderkey", F.expr("stack(3, l_quantity, l_discount * 100, l_tax * 1000) as amount"))
    return stacked.groupBy("l_orderkey").agg(F.max("amount").alias("largest"))


@add("SELECT l_orderkey, l_linenumber, l_partkey, greatest(coalesce(nullif(l_discount, 0) * 100, 0), coalesce(l_tax * 100, 0), coalesce(l_quantity, 0)) AS most FROM lineitem")
def s_greatest_cols(t: Tables) -> DataFrame:
    d = F.coalesce(F.nullif(F.col("l_discount"), F.lit(0.0)) * 100, F.lit(0.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.greatest(d, F.coalesce(F.col("l_tax") * 100, F.lit(0.0)), F.coalesce("l_quantity", F.lit(0.0))).alias("most"))


@add(f"SELECT o_orderkey, round(least(o_totalprice, o_totalprice * CASE WHEN {_AGE} > 90 THEN 0.4 WHEN {_AGE} > 0 THEN 0.15 ELSE 0.01 END + 500), 6) AS provision FROM orders")
def s_provision_formula(t: Tables) -> DataFrame:
    pct = F.when(age() > 90, 0.4).when(age() > 0, 0.15).otherwise(0.01)
    return t.orders.select("o_orderkey", F.round(F.least(F.col("o_totalprice"), F.col("o_totalprice") * pct + 500), 6).alias("provision"))


@add("""SELECT c_custkey, round(0.5 * coalesce(n, 0) + 0.3 * coalesce(urgent, 0) - c_acctbal / 10000, 6) AS score FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def s_weighted_score(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    score = 0.5 * F.coalesce("n", F.lit(0)) + 0.3 * F.coalesce("urgent", F.lit(0)) - F.col("c_acctbal") / 10000
    return t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.round(score, 6).alias("score"))


@add("SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') = 0 THEN NULL ELSE round(count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*) FILTER (WHERE o_orderstatus = 'O'), 6) END AS ratio FROM orders GROUP BY o_custkey")
def s_ratio_guard(t: Tables) -> DataFrame:
    final, opened = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")
    return t.orders.groupBy("o_custkey").agg(F.round(F.try_divide(final, opened), 6).alias("ratio"))


@add(f"""SELECT o_orderkey, {_AGE} AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS grace, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month,
CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS year_ago, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, o_orderstatus || '/' || {_PRIORITY} AS label FROM orders""")
def s_date_math(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", age().cast("long").alias("days"), F.date_add(day, 10).alias("grace"), F.add_months(day, 1).alias("next_month"), F.add_months(day, -12).alias("year_ago"),
        F.last_day(day).alias("month_end"), F.trunc(day, "MM").alias("month_start"), F.concat("o_orderstatus", F.lit("/"), priority()).alias("label"),
    )


@add("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT n_name, count(*) AS n_customers, round(sum(total), 2) AS total FROM big JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE total > 500000 GROUP BY n_name")
def s_view_over_cte(t: Tables) -> DataFrame:
    """A view over a common table expression, in SQL."""
    for name in ("orders", "customer", "nation"):
        getattr(t, name).createOrReplaceTempView(f"marlstone_{name}")
    return t.spark.sql("""
        WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM marlstone_orders GROUP BY o_custkey)
        SELECT n_name, count(*) AS n_customers, round(sum(total), 2) AS total
        FROM big JOIN marlstone_customer ON c_custkey = o_custkey JOIN marlstone_nation ON n_nationkey = c_nationkey
        WHERE total > 500000 GROUP BY n_name""")
