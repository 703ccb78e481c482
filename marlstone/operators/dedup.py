"""Order-keeping distinct, capped groups, priority unions, best of a group.

Order is a column, never the place of a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_values(rows: DataFrame, keys: Sequence[str], value: str, order: str, most: int | None, out: str) -> DataFrame:
    """Per key the distinct non-null values by first occurrence, at most ``most``.

    Values are made distinct and ranked before any list is made, so that a list
    has no more than ``most`` values (all distinct ones if None).
    """
    once = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__at"))
    if most is not None:
        once = once.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__at", value))).filter(F.col("__r") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__at", F.col(value).alias("v")))), lambda x: x["v"])
    return once.groupBy(*keys).agg(listed.alias(out))


def grouped_first_seen(rows: DataFrame, keys: dict[str, Column], order: str, shown: dict[str, Column], lists: dict[str, tuple[Column, int | None]]) -> DataFrame:
    """One row a key: first spelling, capped distinct lists, count, first place."""
    own = rows.select(*(c.alias(k) for k, c in keys.items()), F.col(order).alias("__order"), *(c.alias(f"__s_{name}") for name, c in shown.items()), *(c.alias(f"__v_{name}") for name, (c, _) in lists.items()))
    firsts = [F.min_by(f"__s_{name}", "__order").alias(name) for name in shown]
    out = own.groupBy(*keys).agg(*firsts, F.count("*").alias("n"), F.min("__order").alias("first_at"))
    for name, (_, most) in lists.items():
        listed = first_values(own, list(keys), f"__v_{name}", "__order", most, name)
        same = [out[k].eqNullSafe(listed[k]) for k in keys]
        empty = F.array().cast(listed.schema[name].dataType)
        kept = [out[c] for c in out.columns]
        out = out.join(listed, same, "left").select(*kept, F.coalesce(listed[name], empty).alias(name))
    return out.select(*keys, *shown, *lists, "n", "first_at")


def keep_first(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; keys that are null are a key as well."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def priority_union(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Union in which an earlier frame's row of a key wins."""
    ranked = [f.withColumn("priority", F.lit(i)) for i, f in enumerate(frames)]
    union = ranked[0]
    for more in ranked[1:]:
        union = union.unionByName(more)
    return keep_first(union, keys, [F.col("priority"), *order])


def chains_without_repeats(chains: DataFrame, signature: str = "signature", start: str = "start", order: str = "pos") -> DataFrame:
    """Equal signatures are one chain unless both have known, other starts."""
    known = chains.filter(F.col(start).isNotNull())
    firsts = keep_first(known, [signature, start], [F.col(order)])
    earliest = known.groupBy(signature).agg(F.min(order).alias("__first"))
    unknown = keep_first(chains.filter(F.col(start).isNull()), [signature], [F.col(order)]).join(earliest, signature, "left")
    # an unknown start joins any earlier chain; a later known one joins it
    absorbed = unknown.filter(F.col("__first").isNull() | (F.col(order) < F.col("__first"))).drop("__first")
    lead = absorbed.select(signature, F.col(order).alias("__lead"))
    rest = firsts.join(lead, signature, "left").withColumn("__rank", F.row_number().over(Window.partitionBy(signature).orderBy(order)))
    return rest.filter(F.col("__lead").isNull() | (F.col("__rank") > 1)).drop("__lead", "__rank").unionByName(absorbed)


def merge_rules(rules: DataFrame, key: str, rank: Sequence[Column], order: str, field: str) -> DataFrame:
    """The best row of each key, with the other rows' fields; no key, no merge."""
    keyed = rules.filter(F.col(key).isNotNull())
    best = keep_first(keyed, [key], [*rank, F.col(order)])
    fields = first_values(keyed, [key], field, order, None, "__all")
    merged = best.join(fields, key, "left").withColumn("other_fields", F.array_except(F.coalesce("__all", F.array().cast("array<string>")), F.array(field))).drop("__all")
    lone = rules.filter(F.col(key).isNull()).withColumn("other_fields", F.array().cast("array<string>"))
    return merged.unionByName(lone)


def drop_near_steps(rows: DataFrame, group: str, order: str, words: str, least: float = 0.8, fewest: int = 4) -> DataFrame:
    """Steps that overlap an earlier kept step are dropped.

    What is kept depends on what was kept, so each group is a fold over its
    rows: an ``aggregate`` on the ordered list of its steps.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.array_distinct(F.col(words)).alias("w"))))
    near = lambda kept, step: F.exists(kept, lambda k: (F.size(step["w"]) >= fewest) & (F.size(k["w"]) >= fewest) & (F.size(F.array_intersect(k["w"], step["w"])) >= least * F.least(F.size(k["w"]), F.size(step["w"]))))
    kind = f"array<struct<o:{dict(rows.dtypes)[order]},w:{dict(rows.dtypes)[words]}>>"
    folded = F.aggregate(steps, F.array().cast(kind), lambda kept, step: F.when(near(kept, step), kept).otherwise(F.concat(kept, F.array(step))))
    return rows.groupBy(group).agg(F.transform(folded, lambda s: s["o"]).alias("kept"))


def single_write_fields(writes: DataFrame, keys: Sequence[str], statement: str) -> DataFrame:
    return writes.groupBy(*keys).agg(F.count_distinct(statement).alias("n_statements")).filter("n_statements = 1")


def disambiguated(rows: DataFrame, name: str, field: str, order: Sequence[Column], out: str = "shown") -> DataFrame:
    """Repeated names get their field, and an ordinal if that repeats too."""
    same, both = Window.partitionBy(F.lower(name)), Window.partitionBy(F.lower(name), F.coalesce(F.lower(field), F.lit("")))
    named = F.when(F.count("*").over(same) == 1, F.col(name)).otherwise(F.concat(F.col(name), F.coalesce(F.concat(F.lit(" ("), F.col(field), F.lit(")")), F.lit(""))))
    place = F.row_number().over(both.orderBy(*order))
    return rows.withColumn(out, F.when((F.count("*").over(same) > 1) & (F.count("*").over(both) > 1), F.concat(named, F.lit(" #"), place)).otherwise(named))


def unique_ids(rows: DataFrame, given: str, order: Sequence[Column], out: str = "unique_id") -> DataFrame:
    """Repeats get __2, __3 ..; a suffix that is a given id itself is passed over.

    An id's suffix numbers that are taken are the given ids of that form; the
    k-th repeat takes the k-th free number.
    """
    taken = rows.select(F.regexp_extract(given, r"^(.*)__(\d{1,9})$", 1).alias("base"), F.regexp_extract(given, r"^(.*)__(\d{1,9})$", 2).alias("n")).filter("n <> ''")
    taken = taken.filter(~F.col("n").startswith("0")).groupBy("base").agg(F.sort_array(F.collect_set(F.col("n").cast("int"))).alias("taken"))
    placed = rows.withColumn("__k", F.row_number().over(Window.partitionBy(given).orderBy(*order))).join(taken, F.col(given) == F.col("base"), "left")
    # walking up the taken numbers, each at or below the candidate moves it on
    number = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("__k"), lambda n, x: F.when((x >= 2) & (x <= n), n + 1).otherwise(n))
    return placed.withColumn(out, F.when(F.col("__k") == 1, F.col(given)).otherwise(F.concat(F.col(given), F.lit("__"), number))).drop("__k", "base", "taken")


def decision_groups(rows: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """Groups whose fields are all different."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(field).alias("n_fields")).filter("n = n_fields")
