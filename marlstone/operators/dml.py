"""DML as transitions from one immutable snapshot to the next.

Nothing changes in place: each function returns the table after the statement.
A predicate that is null touches no row, as in SQL, and all assignments of a
statement read the values from before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Assignments = dict[str, Column]


def true(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def update(table: DataFrame, assignments: Assignments, where: Column | None = None) -> DataFrame:
    """UPDATE .. SET .. WHERE."""
    hit = F.lit(True) if where is None else true(where)
    kinds = {f.name: f.dataType for f in table.schema}
    return table.withColumns({c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in assignments.items()})


def update_sequence(table: DataFrame, steps: Sequence[tuple[Assignments, Column]]) -> DataFrame:
    """A run of UPDATEs; each reads what the ones before it wrote."""
    for assignments, where in steps:
        table = update(table, assignments, where)
    return table


def one_row_per_key(source: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a stated order.

    SQL leaves open which of several matching rows an UPDATE takes; here the
    caller's order decides.
    """
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    return source.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def update_from(table: DataFrame, source: DataFrame, on: Sequence[str], assignments: Assignments, where: Column | None = None) -> DataFrame:
    """UPDATE .. FROM .. JOIN; ``source`` has one row a key.

    Assignments and ``where`` name source columns by the prefix ``s_``.
    """
    renamed = source.select(*(F.col(c).alias(f"s_{c}") for c in source.columns), F.lit(True).alias("__hit"))
    joined = table.join(renamed, [F.col(c) == F.col(f"s_{c}") for c in on], "left")
    hit = true(F.col("__hit")) & (F.lit(True) if where is None else true(where))
    kinds = {f.name: f.dataType for f in table.schema}
    return joined.withColumns({c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in assignments.items()}).select(*table.columns)


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT .. SELECT; columns that ``rows`` lacks are null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.filter(~true(where))


def delete_in(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """DELETE .. WHERE (on) IN (subquery)."""
    return table.join(keys.select(*on), list(on), "left_anti").select(*table.columns)


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def merge(
    table: DataFrame,
    source: DataFrame,
    on: Sequence[str],
    matched: Assignments | None = None,
    matched_if: Column | None = None,
    insert_values: Assignments | None = None,
    insert_if: Column | None = None,
    by_source: Assignments | None = None,
    by_source_if: Column | None = None,
    delete_by_source: bool = False,
) -> DataFrame:
    """MERGE as one outer join.

    ``source`` has one row a key and its columns carry the prefix ``s_`` in
    all expressions.  Without ``insert_values`` the join is a left join, as no
    source row can add a row.
    """
    left = table.withColumn("__t", F.lit(True))
    right = source.select(*(F.col(c).alias(f"s_{c}") for c in source.columns), F.lit(True).alias("__s"))
    joined = left.join(right, [F.col(c) == F.col(f"s_{c}") for c in on], "full" if insert_values else "left")
    in_table, in_source = F.col("__t").isNotNull(), F.col("__s").isNotNull()
    both = in_table & in_source & (F.lit(True) if matched_if is None else true(matched_if))
    new = ~in_table & (F.lit(True) if insert_if is None else true(insert_if))
    gone = in_table & ~in_source & (F.lit(True) if by_source_if is None else true(by_source_if))
    out = []
    for f in table.schema:
        value = F.when(both, (matched or {}).get(f.name, F.col(f.name)).cast(f.dataType))
        if insert_values:
            value = value.when(new, insert_values.get(f.name, F.lit(None)).cast(f.dataType))
        if by_source:
            value = value.when(gone, by_source.get(f.name, F.col(f.name)).cast(f.dataType))
        out.append(value.otherwise(F.col(f.name)).alias(f.name))
    kept = in_table | new
    return joined.filter(kept & ~gone if delete_by_source else kept).select(*out)


def attempted(after: DataFrame, handled: DataFrame, failures: DataFrame) -> DataFrame:
    """``after`` if no row of ``failures`` (a boolean column fails) is true,
    else ``handled``, the snapshot that the handler leaves; one for all rows."""
    failed = failures.agg(F.coalesce(F.bool_or("fails"), F.lit(False)).alias("__failed"))
    kept = lambda d, want: d.join(F.broadcast(failed)).filter(F.col("__failed") == want).drop("__failed")
    return kept(after, False).unionByName(kept(handled, True))


def scd2(history: DataFrame, incoming: DataFrame, key: str, tracked: Sequence[str], at: int, last: int = 49999) -> DataFrame:
    """Slowly changing dimension, type 2.

    ``history`` has key, tracked columns, valid_from and valid_to, the open
    version having ``last`` as its end.  Changed and new keys get a version
    from ``at``; versions that changed or whose key is gone end before it.
    """
    now = incoming.select(F.col(key).alias("__k"), *(F.col(c).alias(f"n_{c}") for c in tracked), F.lit(True).alias("__n"))
    open_ = F.col("valid_to") == last
    joined = history.join(now, F.col(key) == F.col("__k"), "left")
    same = F.lit(True)
    for c in tracked:
        same = same & F.col(c).eqNullSafe(F.col(f"n_{c}"))
    closed = joined.withColumn("valid_to", F.when(open_ & ~(F.col("__n").isNotNull() & same), at - 1).otherwise(F.col("valid_to")).cast(history.schema["valid_to"].dataType)).select(*history.columns)
    current = history.filter(open_).select(key, *tracked)
    unchanged = [F.col(f"i.{key}") == F.col(f"c.{key}"), *(F.col(f"i.{c}").eqNullSafe(F.col(f"c.{c}")) for c in tracked)]
    fresh = incoming.alias("i").join(current.alias("c"), unchanged, "left_anti").select(key, *tracked, F.lit(at).alias("valid_from"), F.lit(last).alias("valid_to"))
    return closed.unionByName(fresh)
