"""What a report leaves out: rules that say again what another one says.

``rules``: object_id, rule_id, pos, fields (array of names), rows (array of
condition and outcome, in order), eligibility and text (texts), table_name,
canonical (boolean: made of a decision chain).  ``writes``: object_id, field,
table_name, statement_id, one for each assignment.  Each function drops rules
and changes none; a canonical rule is never dropped.  What is compared is within
an object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.classify import merge_branch
from marlstone.functions.text import bare_field, fragment


def names(fields: Column) -> Column:
    """Distinct bare names, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(fields, F.array().cast("array<string>")), bare_field)))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _once(writes: DataFrame, *by: str) -> DataFrame:
    """Fields (and tables) that one statement of the object writes."""
    table = F.upper(F.trim(F.coalesce("table_name", F.lit("")))).alias("__table")
    keyed = writes.select("object_id", bare_field(F.col("field")).alias("__field"), table, "statement_id")
    return keyed.groupBy("object_id", *by).agg(F.count_distinct("statement_id").alias("__n")).filter("__n = 1").drop("__n")


def without_single_write_duplicates(rules: DataFrame, writes: DataFrame) -> DataFrame:
    """Not other rules on a field that one statement writes and a canonical
    rule has: there is one fact that both can tell of."""
    one = F.when(F.size(names(F.col("fields"))) == 1, F.get(names(F.col("fields")), F.lit(0)))
    named = rules.withColumn("__field", one)
    known = named.filter("canonical and __field is not null").select("object_id", "__field").distinct()
    settled = _once(writes, "__field").join(known, ["object_id", "__field"], "left_semi").withColumn("__settled", F.lit(True))
    return named.join(settled, ["object_id", "__field"], "left").filter(F.col("canonical") | F.col("__settled").isNull()).select(*rules.columns)


def without_contentless(rules: DataFrame, writes: DataFrame) -> DataFrame:
    """Not rules without rows and eligibility, if another one tells of the same
    field and table, written once; of several such the first stays."""
    one = F.when(F.size(names(F.col("fields"))) == 1, F.get(names(F.col("fields")), F.lit(0)))
    keyed = rules.select("*", one.alias("__field"), F.upper(F.trim(F.coalesce("table_name", F.lit("")))).alias("__table"), ((F.coalesce(F.size("rows"), F.lit(0)) == 0) & _blank("eligibility") & ~F.col("canonical")).alias("__empty"))
    marked = keyed.join(_once(writes, "__field", "__table").withColumn("__single", F.lit(True)), ["object_id", "__field", "__table"], "left")
    group = Window.partitionBy("object_id", "__field", "__table")
    full = F.max((~F.col("__empty")).cast("int")).over(group) == 1
    first = F.row_number().over(Window.partitionBy("object_id", "__field", "__table", "__empty").orderBy("pos")) == 1
    gone = F.col("__single").isNotNull() & F.col("__empty") & (full | ~first)
    return marked.withColumn("__gone", F.coalesce(gone, F.lit(False))).filter("not __gone").select(*rules.columns)


def without_equal_tables(rules: DataFrame) -> DataFrame:
    """Not rules whose fields and ordered conditions another rule has; the
    canonical one stays, else the first."""
    signature = F.array_join(F.transform("rows", lambda r: fragment(r["condition"])), " | ")
    keyed = rules.select("*", F.array_join(names(F.col("fields")), ",").alias("__fields"), F.when(F.coalesce(F.size("rows"), F.lit(0)) > 0, signature).alias("__signature"))
    place = F.row_number().over(Window.partitionBy("object_id", "__fields", "__signature").orderBy(F.desc("canonical"), "pos"))
    return keyed.withColumn("__place", place).filter(F.col("__signature").isNull() | F.col("canonical") | (F.col("__place") == 1)).select(*rules.columns)


def without_ladder_fragments(rules: DataFrame) -> DataFrame:
    """Not rules of a single row that a longer table of the same field has."""
    pair = lambda r: F.concat_ws(" -> ", fragment(r["condition"]), F.translate(fragment(r["outcome"]), "'", ""))
    long = rules.filter(F.size("rows") > 1).select("object_id", F.explode(names(F.col("fields"))).alias("__field"), F.explode("rows").alias("__r")).select("object_id", "__field", pair(F.col("__r")).alias("__pair")).distinct()
    one = F.when((F.size("rows") == 1) & ~F.col("canonical") & (F.size(names(F.col("fields"))) == 1), F.get(names(F.col("fields")), F.lit(0)))
    keyed = rules.select("*", one.alias("__field"), pair(F.get("rows", F.lit(0))).alias("__pair"))
    return keyed.join(long.withColumn("__part", F.lit(True)), ["object_id", "__field", "__pair"], "left").filter("__part is null").select(*rules.columns)


def without_covered_tables(rules: DataFrame) -> DataFrame:
    """Not tables of several fields, all of which have canonical rules of their own."""
    single = rules.filter(F.col("canonical") & (F.size(names(F.col("fields"))) == 1)).select("object_id", F.get(names(F.col("fields")), F.lit(0)).alias("__field")).distinct().withColumn("__own", F.lit(1))
    several = rules.filter(~F.col("canonical") & (F.size(names(F.col("fields"))) > 1)).select("object_id", "rule_id", F.explode(names(F.col("fields"))).alias("__field"))
    covered = several.join(single, ["object_id", "__field"], "left").groupBy("object_id", "rule_id").agg((F.count("*") == F.count("__own")).alias("__all")).filter("__all").select("object_id", "rule_id")
    return rules.join(covered, ["object_id", "rule_id"], "left_anti").select(*rules.columns)


def merged_halves(rules: DataFrame) -> DataFrame:
    """The two halves of an upsert, of one table and set of fields, as one rule.

    The rule of the matched branch takes the rows of the other's after its own;
    what doesn't pair off stays as it is.
    """
    told = F.lower(F.concat_ws(" ", "text", "eligibility", F.to_json("rows")))
    side = F.when(merge_branch(told)["matched"] & ~merge_branch(told)["unmatched"], "m").when(merge_branch(told)["unmatched"] & ~merge_branch(told)["matched"], "u")
    keyed = rules.select("*", F.array_join(names(F.col("fields")), ",").alias("__fields"), F.upper(F.trim(F.coalesce("table_name", F.lit("")))).alias("__table"), side.alias("__side"))
    place = F.row_number().over(Window.partitionBy("object_id", "__fields", "__table", "__side").orderBy("pos"))
    keyed = keyed.withColumn("__place", F.when(F.col("__side").isNotNull(), place))
    key = ["object_id", "__fields", "__table", "__place"]
    new = keyed.filter("__side = 'u'").select(*key, F.col("rows").alias("__rows"), F.lit("m").alias("__side"), F.col("rule_id").alias("__with"))
    both = keyed.join(new, [*key, "__side"], "left")
    taken = both.filter("__with is not null").select("object_id", F.col("__with").alias("rule_id"))
    joined = both.withColumn("rows", F.when(F.col("__with").isNotNull(), F.concat("rows", "__rows")).otherwise(F.col("rows")))
    return joined.join(taken, ["object_id", "rule_id"], "left_anti").select(*rules.columns)
