"""Business rules against evidence: floors, backfill, filters, grounding.

``chains``: object_id, chain_id, field, branch, condition, outcome.
``rules``: object_id, rule_id, pos, title, field, row, condition, outcome, one
row a rule row.  Keys of conditions are normal texts, in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import bare_field, fragment, normal


def condition_key(conditions: Column) -> Column:
    return F.array_join(F.transform(conditions, fragment), " | ")


def _keyed(rows: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("condition").alias("c")))), lambda x: x["c"])
    return rows.groupBy(*group, bare_field(F.col("field")).alias("field_key")).agg(condition_key(ordered).alias("conditions"), F.count("*").alias("n"))


def chain_floor(rules: DataFrame, chains: DataFrame) -> DataFrame:
    """Rules for the chains, of two branches or more, that no rule represents."""
    have = _keyed(rules, ["object_id", "rule_id"], "row")
    need = _keyed(chains, ["object_id", "chain_id"], "branch").filter("n >= 2")
    missing = need.join(have, ["object_id", "field_key", "conditions"], "left_anti").select("object_id", "chain_id")
    return chains.join(missing, ["object_id", "chain_id"], "left_semi").select(
        "object_id", F.concat(F.lit("floor_"), "chain_id").alias("rule_id"), F.lit(None).cast("int").alias("pos"), F.concat(F.lit("Decision on "), "field").alias("title"), "field", F.col("branch").alias("row"), "condition", "outcome"
    )


def statement_floor(rules: DataFrame, writes: DataFrame) -> DataFrame:
    """One-row rules for gated writes of fields that no rule covers.

    ``writes``: object_id, statement_id, table_name, field, predicate,
    expression, in_ladder.  CASE values and ladders have rules of their own.
    """
    gated = writes.filter((F.trim("predicate") != "") & ~F.col("in_ladder") & ~F.col("expression").rlike(r"(?i)\bCASE\b"))
    covered = rules.filter(F.trim(F.coalesce("condition", F.lit(""))) != "").select("object_id", bare_field(F.col("field")).alias("key")).distinct()
    left = gated.withColumn("key", bare_field(F.col("field"))).join(covered, ["object_id", "key"], "left_anti")
    return left.select("object_id", F.concat_ws("_", F.lit("write"), "statement_id", "key").alias("rule_id"), F.lit(None).cast("int").alias("pos"), F.concat(F.lit("Update of "), "table_name").alias("title"), "field", F.lit(0).alias("row"), F.col("predicate").alias("condition"), F.col("expression").alias("outcome"))


def backfilled(rules: DataFrame, chains: DataFrame) -> DataFrame:
    """Blank outcomes taken from the chain with that field and condition."""
    known = chains.filter(F.trim(F.coalesce("outcome", F.lit(""))) != "").groupBy("object_id", bare_field(F.col("field")).alias("k"), fragment(F.col("condition")).alias("c")).agg(F.min_by("outcome", "branch").alias("known"))
    joined = rules.withColumn("k", bare_field(F.col("field"))).withColumn("c", fragment(F.col("condition"))).join(known, ["object_id", "k", "c"], "left")
    return joined.withColumn("outcome", F.coalesce(F.nullif(F.trim("outcome"), F.lit("")), "known")).select(*rules.columns)


def _said(*names: str) -> Column:
    return F.concat_ws(" ", *(F.coalesce(F.col(n), F.lit("")) for n in names))


def without_tautologies(rules: DataFrame) -> DataFrame:
    """Not the rules whose one row tests a field for null and then writes it.

    All filters read object_id, rule_id, title, action, meaning, condition,
    evidence (texts), fields (array), rows (array of condition and outcome) and
    eligible (boolean).
    """
    only = F.get("rows", F.lit(0))
    condition, outcome = F.trim(F.coalesce(only["condition"], F.lit(""))), F.trim(F.coalesce(only["outcome"], F.lit("")))
    test = condition.rlike(r"(?i)^(?:not\s+)?[\w #@\[\]$.,]+?\s+(?:is|are)(?:\s+not)?\s+null$")
    content = outcome.rlike(r"(?i)['\"]|\bcase\b|\bwhen\b|[+\-*/]")
    tested = F.transform(F.filter(F.split(condition, r"[,\s]+"), lambda x: ~F.upper(x).isin("IS", "ARE", "NOT", "NULL", "")), bare_field)
    writes = outcome.rlike(r"(?i)^(?:update|insert|merge)\b") | F.array_contains(tested, bare_field(outcome))
    gone = (F.size("rows") == 1) & (condition != "") & (outcome != "") & test & ~content & writes
    return rules.filter(~F.coalesce(gone, F.lit(False)))


#: Columns of process states and what tells of them.
STATE_FIELDS = ("COMPLETED", "ERRORDATE", "ERRORDESCRIPTION", "COUNT", "RUNNINGPROCESSNAME")
STATE_WORDS = r"PROCESS STATUS|RUNNING PROCESS|ERROR DESCRIPTION|COMPLETION|COMPLETED"


def without_bookkeeping(rules: DataFrame, tables: DataFrame) -> DataFrame:
    """Not the rules about process states, in objects that write such tables.

    ``tables``: object_id, table_name of all operations.
    """
    states = tables.filter(F.lower("table_name").contains("runningprocessstatus"))
    bare = F.upper(F.replace(F.element_at(F.split(F.trim("table_name"), r"\."), -1), F.lit("#"), F.lit("")))
    names = states.groupBy("object_id").agg(F.collect_set(bare).alias("__names"))
    text = F.upper(F.concat_ws(" ", _said("title", "action", "meaning", "condition", "evidence"), F.array_join("fields", " "), F.to_json("rows")))
    own = F.transform(F.coalesce("fields", F.array().cast("array<string>")), lambda f: F.upper(F.element_at(F.split(F.trim(f), r"\."), -1)))
    about = F.exists("__names", lambda n: F.contains(text, n)) | text.contains("RUNNINGPROCESSNAME")
    marked = text.rlike(STATE_WORDS) & ((F.size(own) == 0) | F.arrays_overlap(own, F.array(*map(F.lit, STATE_FIELDS))))
    return rules.join(names, "object_id", "left").filter(F.col("__names").isNull() | ~(about | marked)).select(*rules.columns)


def without_cleanup(rules: DataFrame, operations: DataFrame) -> DataFrame:
    """Not the rules that make or drop a working table and decide nothing.

    ``operations``: object_id, table_name, operation.
    """
    made = operations.filter(F.upper("operation").isin("DROP", "CREATE") & F.col("table_name").rlike("(?i)^#|TEMP|TMP")).select("object_id").distinct().withColumn("__working", F.lit(True))
    ddl = r"(?is)\b(?:DROP|CREATE)\s+TABLE\b.*(?:#|TEMP|TMP)"
    condition = F.trim(F.coalesce("condition", F.lit("")))
    guard = condition.rlike(r"(?i)\b(?:if\s+)?(?:object_id\s*\([^)]*\)|table\s+\S+|\S+\s+exists)(?:\s+is\s+not\s+null|\s+exists)?\b")
    decides = (F.size(F.array_distinct("rows")) >= 2) | ((condition != "") & ~guard & ~condition.rlike(r"(?i)\b(?:DROP|CREATE)\s+TABLE\b"))
    proof = F.coalesce("__working", F.lit(False)) | F.coalesce(F.col("evidence").rlike(ddl), F.lit(False)) | _said("condition", "action", "title").rlike(ddl) | guard
    told = F.lower(F.concat_ws(" ", _said("title", "action", "meaning", "condition", "evidence"), F.to_json("rows"))).rlike(r"drop|create|temporary|temp table|cleanup")
    fields = F.exists(F.coalesce("fields", F.array().cast("array<string>")), lambda f: F.trim(f) != "")
    plain = _said("title", "action").rlike(r"(?i)\b(?:create|drop)\b.*(?:#\w+|temp(?:orary)?\s+table)") & ~decides
    return rules.join(made, "object_id", "left").filter(~((proof & told & ~fields & ~decides) | plain)).select(*rules.columns)


def without_operations_only(rules: DataFrame) -> DataFrame:
    """Not rules that only read, or that only say that something is written."""
    title, action = F.lower(F.trim(F.coalesce("title", F.lit("")))), F.lower(F.coalesce("action", F.lit("")))
    n = F.coalesce(F.size("rows"), F.lit(0))
    cited = F.upper(_said("evidence", "condition"))
    mechanical = action.contains("source-defined value") | title.contains("source-defined value") | (title.rlike("^(?:update|insert|write) ") & ~F.coalesce("eligible", F.lit(False)))
    writes = cited.rlike(r"\b(?:UPDATE|INSERT|DELETE|MERGE)\b")
    reads = cited.rlike(r"\bSELECT\b")
    told = F.lower(_said("title", "action", "meaning")).rlike(r"\b(?:read|retrieve|select|fetch|look\s*up|return)\b")
    by_title = title.rlike(r"^(?:read|retrieve|fetch|look\s*up|select)\b") & (n <= 1)
    return rules.filter(~(by_title | ((n == 0) & (((writes | reads) & mechanical) | (reads & ~writes & told)))))


def grounded(rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """Status and confidence of each rule by the evidence that names its field.

    ``evidence``: object_id, field, condition, outcome.  CONFLICT before
    MATCHED before UNRESOLVED; without any candidate, LLM_ONLY.
    """
    e = evidence.select("object_id", bare_field(F.col("field")).alias("k"), fragment(F.col("condition")).alias("c"), fragment(F.col("outcome")).alias("eo"))
    told = rules.select("object_id", "rule_id", "row", bare_field(F.col("field")).alias("k"), fragment(F.col("condition")).alias("c"), fragment(F.col("outcome")).alias("o"))
    # candidates of a field are only counted; rows meet where conditions agree
    candidates = e.groupBy("object_id", "k").agg(F.count("c").alias("candidates"))
    joined = told.join(e.distinct(), ["object_id", "k", "c"], "left").join(candidates, ["object_id", "k"], "left")
    rows = joined.groupBy("object_id", "rule_id", "row").agg(F.coalesce(F.max("candidates"), F.lit(0)).alias("n"), F.coalesce(F.bool_or(F.col("o") == F.col("eo")), F.lit(False)).alias("match"), F.coalesce(F.bool_or(F.col("o") != F.col("eo")), F.lit(False)).alias("other"))
    status = F.when(F.bool_or(F.col("other") & ~F.col("match")), "CONFLICT").when(F.bool_and("match"), "MATCHED").when(F.sum("n") == 0, "LLM_ONLY").otherwise("UNRESOLVED")
    found = rows.groupBy("object_id", "rule_id").agg(status.alias("status"), F.count_if("match").alias("n_matched"), F.count("*").alias("n_rows"))
    return found.withColumn("confidence", F.when(F.col("status") == "MATCHED", "high").when(F.col("status") == "UNRESOLVED", "medium").otherwise("low"))


def names_in_source(claims: DataFrame, name: str, source: str) -> DataFrame:
    """Whether the source has the name as a whole identifier."""
    quoted = F.concat(F.lit(r"(?i)(?<![\w])\Q"), F.col(name), F.lit(r"\E(?![\w])"))
    return claims.withColumn("grounded", F.rlike(F.col(source), quoted))


def revised(before: DataFrame, returned: DataFrame, key: Sequence[str]) -> DataFrame:
    """Returned rules, marked if new, and the earlier ones they left out."""
    fresh = returned.join(before.select(*key).distinct().withColumn("__old", F.lit(1)), list(key), "left").withColumn("gap_review", F.col("__old").isNull()).drop("__old")
    dropped = before.join(returned, list(key), "left_anti").withColumn("gap_review", F.lit(False))
    return fresh.unionByName(dropped)


def rule_shape(rows: Column) -> Column:
    """Rule rows from JSON of a model: PERMISSIVE, bad values to nulls."""
    return F.from_json(rows, "rule_name string, field string, rows array<struct<condition:string,outcome:string>>, confidence string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
