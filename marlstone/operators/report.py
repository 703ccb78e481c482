"""What reports need: order, destinations, versions, runs compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import fragment
from marlstone.operators.measures import percentage_change


def in_execution_order(rules: DataFrame, lines: DataFrame) -> DataFrame:
    """``rules`` (object_id, rule_id, pos) with their place in their object."""
    first = lines.groupBy("rule_id").agg(F.min("line").alias("first_line"))
    place = F.row_number().over(Window.partitionBy("object_id").orderBy(F.asc_nulls_last("first_line"), "pos"))
    return rules.join(first, "rule_id", "left").withColumn("place", place)


def with_destinations(calculations: DataFrame, assigned: DataFrame) -> DataFrame:
    """Unknown destinations from assignments of equal expressions."""
    known = assigned.groupBy(fragment(F.col("expression")).alias("__k")).agg(F.array_join(F.array_sort(F.collect_set("destination")), ", ").alias("__d"))
    joined = calculations.withColumn("__k", fragment(F.col("expression"))).join(known, "__k", "left")
    return joined.withColumn("destination", F.coalesce("destination", F.nullif(F.col("__d"), F.lit("")))).drop("__k", "__d")


def version(text: Column) -> Column:
    """Aggregate: a digest of a set of texts, whatever their order.

    Sums of four parts of each text's hash, and the count, stand for the set,
    so that nothing is collected.
    """
    part = lambda i: F.sum(F.conv(F.substring(F.sha2(text, 256), 8 * i + 1, 8), 16, 10).cast("long")).cast("string")
    return F.sha2(F.concat_ws("|", F.count(text).cast("string"), *(part(i) for i in range(4))), 256)


def compare_runs(base: DataFrame, now: DataFrame, key: Sequence[str], measured: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Changes in per cent, and which of ``compared`` differ."""
    a = base.select(*key, *(F.col(c).alias(f"a_{c}") for c in base.columns if c not in key))
    b = now.select(*key, *(F.col(c).alias(f"b_{c}") for c in now.columns if c not in key))
    differs = F.array_compact(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in compared)))
    return a.join(b, list(key)).select(*key, *(percentage_change(F.col(f"a_{c}"), F.col(f"b_{c}")).alias(f"{c}_change") for c in measured), differs.alias("differs"))


def same_kind_runs(rows: DataFrame, key: Sequence[str], kind: Sequence[str], order: str) -> DataFrame:
    """Numbers runs of neighbours that agree in ``kind``."""
    window = Window.partitionBy(*key).orderBy(order)
    same = F.lit(True)
    for c in kind:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(window))
    first = F.lag(order).over(window).isNull()
    return rows.withColumn("__new", (first | ~same).cast("int")).withColumn("run", F.sum("__new").over(window)).drop("__new")


def contained_calculations(calculations: DataFrame) -> DataFrame:
    """Once per (expression, field, table); a blank table is any table.

    The match isn't transitive, so what is kept depends on what was kept: a
    row with a blank table goes if its expression and field came before, one
    with a table if that table or a blank one did.
    """
    key = ["object_id", "expression", "field"]
    before = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    table = F.nullif(F.trim("table_name"), F.lit(""))
    seen = F.count("*").over(before)
    # rows after a kept blank one always go; a blank one is kept only if first
    first = F.first(F.coalesce(table, F.lit("")), ignorenulls=False).over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.row_number().over(Window.partitionBy(*key, table).orderBy("pos"))
    kept = (seen == 0) | ((first != "") & table.isNotNull() & (place == 1))
    return calculations.withColumn("__kept", kept).filter("__kept").drop("__kept")
