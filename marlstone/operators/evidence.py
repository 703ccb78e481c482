"""Rules against chains, statements and sections: links, policies, findings.

Joins are within an object (``object_id``), on equal keys or, where text has to
contain text or lines have to meet, on the object and that test; an object has
tens of rules, not a corpus' worth.  Names of columns are given where they are
read; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.classify import space, spaces_overlap
from marlstone.functions.text import column_reference, fragment, normal


def compact(text: Column) -> Column:
    """Letters, digits and underscores in lower case; for containment."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]", "")


def lines_meet(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed ranges that share a line; unknown ones (null or below 0) don't."""
    known = (a_start >= 0) & (b_start >= 0)
    return F.coalesce(known & (a_start <= b_end) & (b_start <= a_end), F.lit(False))


def scoped(evidence: DataFrame, sections: DataFrame, on: list[str]) -> DataFrame:
    """Evidence of the chunks or statements that a section has."""
    return evidence.join(sections.select(*on).distinct(), on, "left_semi")


def evidence_records(evidence: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (evidence_id, record_id) whose normal texts contain each other.

    ``evidence``: object_id, evidence_id, text; ``records``: object_id,
    record_id, text.  Empty texts match nothing.
    """
    e = evidence.select("object_id", "evidence_id", normal(F.col("text")).alias("said")).filter("said <> ''")
    r = records.select("object_id", "record_id", normal(F.col("text")).alias("known")).filter("known <> ''")
    return e.join(r, "object_id").filter(F.contains("known", "said") | F.contains("said", "known")).select("object_id", "evidence_id", "record_id")


#: What may stand before a parenthesis and is no function.
NO_FUNCTIONS = ("IN", "CASE", "WHEN", "AND", "OR", "NOT", "IF", "ELSE", "EXISTS")


def invented_functions(expression: Column, source: Column) -> Column:
    """Names of functions that an expression calls and its source hasn't."""
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))))
    there = lambda name: F.rlike(F.coalesce(source, F.lit("")), F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_])")))
    return F.filter(names, lambda name: ~F.upper(name).isin(*NO_FUNCTIONS) & ~there(name))


def grounded_calculations(calculations: DataFrame, sources: DataFrame, on: list[str]) -> DataFrame:
    """Calculations all of whose functions their source has."""
    return calculations.join(sources.select(*on, "source"), on, "left").filter(F.size(invented_functions(F.col("expression"), F.col("source"))) == 0).drop("source")


def rule_chain_links(rules: DataFrame, branches: DataFrame) -> DataFrame:
    """Pairs (rule_id, chain_id, branch) of rules and branches that belong together.

    ``rules``: object_id, rule_id, fields, conditions, outcomes, evidence
    (arrays), line_start, line_end.  ``branches``: object_id, chain_id, branch,
    field, condition, outcome, catch_all, line_start, line_end.  A branch is
    linked if its lines meet the rule's and one of field, outcome and condition
    agrees, or if the condition agrees and another of them does.  A catch-all
    that only its outcome and field name is linked if all such are of one chain.
    """
    each = lambda c, f: F.transform(F.coalesce(c, F.array().cast("array<string>")), f)
    r = rules.select("object_id", "rule_id", each(F.col("fields"), lambda x: F.lower(column_reference(x))).alias("fields"), each(F.col("conditions"), normal).alias("conditions"), each(F.col("outcomes"), lambda x: F.translate(fragment(x), "'", "")).alias("outcomes"), each(F.col("evidence"), normal).alias("evidence"), F.col("line_start").alias("r_start"), F.col("line_end").alias("r_end"))
    b = branches.select("object_id", "chain_id", "branch", F.lower(column_reference(F.col("field"))).alias("field"), normal(F.col("condition")).alias("condition"), F.translate(fragment(F.col("outcome")), "'", "").alias("outcome"), "catch_all", "line_start", "line_end")
    cited = F.exists("evidence", lambda e: (e != "") & (F.contains(e, F.col("condition")) | F.contains(F.col("condition"), e)))
    same = r.join(b, "object_id").select(
        "object_id", "rule_id", "chain_id", "branch", "catch_all",
        ((F.col("condition") != "") & (F.array_contains("conditions", F.col("condition")) | cited)).alias("by_condition"),
        F.array_contains("fields", F.col("field")).alias("by_field"), F.array_contains("outcomes", F.col("outcome")).alias("by_outcome"),
        lines_meet(F.col("r_start"), F.col("r_end"), F.col("line_start"), F.col("line_end")).alias("by_lines"), (F.size("fields") > 0).alias("has_fields"),
    )
    direct = same.filter("by_lines and (by_field or by_outcome or by_condition) or by_condition and (by_field or by_outcome or catch_all and has_fields)")
    rest = same.join(direct.select("object_id", "rule_id", "chain_id", "branch"), ["object_id", "rule_id", "chain_id", "branch"], "left_anti").filter("catch_all and by_outcome and by_field")
    single = rest.groupBy("object_id", "rule_id").agg(F.count_distinct("chain_id").alias("n")).filter("n = 1").select("object_id", "rule_id")
    names = ["object_id", "rule_id", "chain_id", "branch"]
    return direct.select(*names).unionByName(rest.join(single, ["object_id", "rule_id"], "left_semi").select(*names))


def safe_fallbacks(rules: DataFrame, links: DataFrame, branches: DataFrame) -> DataFrame:
    """Rules whose condition is the complement that a catch-all stands for.

    A rule (object_id, rule_id, condition) is linked to a catch-all branch and
    its condition overlaps none of the other branches of that chain; conditions
    that can't be read as a comparison prove nothing.
    """
    caught = links.join(branches.filter("catch_all").select("object_id", "chain_id", "branch"), ["object_id", "chain_id", "branch"], "left_semi").select("object_id", "rule_id", "chain_id").distinct()
    own = rules.select("object_id", "rule_id", space(F.col("condition")).alias("own")).filter("own.kind not in ('opaque', 'else')")
    other = branches.filter("not catch_all").select("object_id", "chain_id", space(F.col("condition")).alias("other")).filter("other.kind not in ('opaque', 'else')")
    pairs = own.join(caught, ["object_id", "rule_id"]).join(other, ["object_id", "chain_id"])
    return pairs.groupBy("object_id", "rule_id").agg(F.bool_or(spaces_overlap(F.col("own"), F.col("other"))).alias("meets")).filter("not meets").select("object_id", "rule_id")


def decision_blocks(branches: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Branches with the rule rows of their condition and field; a branch that
    no row has stays, with nulls.

    ``rule_rows``: object_id, rule_id, field, condition, outcome.
    """
    keys = [fragment(F.col("condition")).alias("k_condition"), F.lower(column_reference(F.col("field"))).alias("k_field")]
    told = rule_rows.select("object_id", "rule_id", F.col("outcome").alias("told_outcome"), *keys)
    return branches.select("*", *keys).join(told, ["object_id", "k_condition", "k_field"], "left").drop("k_condition", "k_field")


def is_grounded(rule_type: Column, has_rows: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | ((rule_type == "deterministic_decision_table") & has_rows)


def conflicts_settled(rules: DataFrame) -> DataFrame:
    """Rules without the conflicts that nothing grounds; grounded ones match.

    Reads status, rule_type, has_rows, grounded.
    """
    conflict = F.upper(F.trim(F.coalesce("status", F.lit("")))) == "CONFLICT"
    firm = is_grounded(F.col("rule_type"), F.col("has_rows"), F.col("grounded"))
    return rules.filter(~conflict | firm).withColumn("status", F.when(conflict, "MATCHED").otherwise(F.col("status")))


def auxiliary(rules: DataFrame, calculations: DataFrame, failing: DataFrame) -> DataFrame:
    """Rules that only restate a calculation or a failure path.

    A rule with a condition or with decision rows is a decision.  ``rules``:
    object_id, rule_id, field, condition, has_rows, text; ``calculations``:
    object_id, field; ``failing``: objects with exception handling.
    """
    last = lambda c: F.element_at(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\."), -1)
    bare = rules.filter((F.trim(F.coalesce("condition", F.lit(""))) == "") & ~F.col("has_rows")).withColumn("k", last(F.col("field")))
    fields = calculations.select("object_id", last(F.col("field")).alias("k")).filter("k <> ''").distinct().withColumn("calculated", F.lit(True))
    paths = failing.select("object_id").distinct().withColumn("fails", F.lit(True))
    low = F.lower("text")
    by_calculation = F.col("calculated") & low.rlike(r"\bcalculat(?:e|es|ed|ion|ing)\b|\bformula\b|\bexpression\b")
    by_exception = F.col("fails") & low.rlike(r"\bexception\b|\braise\b|\bfailure path\b|\berror handling\b")
    found = bare.join(fields, ["object_id", "k"], "left").join(paths, "object_id", "left")
    return found.filter(F.coalesce(by_calculation, F.lit(False)) | F.coalesce(by_exception, F.lit(False))).select(*rules.columns)


def marked_degraded(rules: DataFrame, calls: DataFrame, on: str) -> DataFrame:
    """``degraded_reason`` of all rules of a call that failed or was cut off."""
    reason = F.when(F.col("failed"), "synthesis_failed").when(F.col("truncated"), "truncated")
    return rules.join(calls.select(on, reason.alias("degraded_reason")), on, "left").withColumn("degraded", F.col("degraded_reason").isNotNull())


def review_findings(records: DataFrame) -> DataFrame:
    """One sentence for each kind and open state of an object."""
    state = F.upper(F.coalesce("status", F.lit("")))
    open_ = records.filter(state.isin("CONFLICT", "UNRESOLVED", "LLM_ONLY", "DETERMINISTIC_ONLY"))
    told = F.concat(F.lit("Reconciliation review required: "), F.coalesce("kind", F.lit("evidence")), F.lit(" evidence is "), F.lower("status"), F.lit(" and must not be treated as a confirmed business rule."))
    return open_.select("object_id", told.alias("finding")).distinct()


def with_row_filter(condition: Column, chain_type: Column, row_filter: Column) -> Column:
    """The filter of a branch's own statement, told apart from its condition."""
    some = F.trim(F.coalesce(row_filter, F.lit("")))
    told = F.when(some != "", F.concat(condition, F.lit(" — row filter: "), some)).otherwise(F.concat(condition, F.lit(" — applies to all rows (no additional filter)")))
    return F.when(chain_type == "TSQL_IF_ELSE", told).otherwise(condition)


def enriched(rules: DataFrame, operations: DataFrame) -> DataFrame:
    """Empty rules filled from the statement they name.

    ``rules``: object_id, rule_id, statement_id, condition, outcome, status;
    ``operations``: object_id, statement_id, predicate, outcome, one a
    statement.  Filled rules are grounded and match.
    """
    known = operations.select("object_id", "statement_id", "predicate", F.col("outcome").alias("known_outcome"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    empty = blank(F.col("condition")) & blank(F.col("outcome")) & F.col("known_outcome").isNotNull()
    open_ = F.upper(F.coalesce("status", F.lit(""))).isin("CONFLICT", "LLM_ONLY", "UNRESOLVED", "")
    return rules.join(known, ["object_id", "statement_id"], "left").select(
        "object_id", "rule_id", "statement_id", F.when(empty, F.col("predicate")).otherwise(F.col("condition")).alias("condition"), F.when(empty, F.col("known_outcome")).otherwise(F.col("outcome")).alias("outcome"),
        F.when(empty & open_, "MATCHED").otherwise(F.col("status")).alias("status"), empty.alias("grounded"),
    )


def validation_summary(rules: DataFrame) -> DataFrame:
    """Rules of an object by type and by status; unknown ones are inferred and unverified."""
    told = lambda name, otherwise: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(otherwise))
    both = F.array(F.struct(F.lit("rule_type").alias("axis"), told("rule_type", "inferred").alias("value")), F.struct(F.lit("validation_status").alias("axis"), told("validation_status", "unverified").alias("value")))
    return rules.select("object_id", F.explode(both).alias("x")).groupBy("object_id", "x.axis", "x.value").agg(F.count("*").alias("n"))


def snapshot(rules: DataFrame, tables: DataFrame) -> DataFrame:
    """What an object's report says, as counts, sorted sets and a signature.

    ``rules``: object_id, rule_id, condition; ``tables``: object_id, section,
    table_name.  Equal reports have equal signatures, whatever their order.
    """
    of_rules = rules.groupBy("object_id").agg(F.count("*").alias("n_rules"), F.array_sort(F.collect_set(normal(F.col("condition")))).alias("conditions"))
    section = lambda name: F.array_sort(F.collect_set(F.when(F.col("section") == name, F.upper("table_name")))).alias(f"tables_{name}")
    of_tables = tables.groupBy("object_id").agg(section("read"), section("written"))
    whole = of_rules.join(of_tables, "object_id", "full").withColumn("n_rules", F.coalesce("n_rules", F.lit(0)))
    return whole.withColumn("signature", F.sha2(F.to_json(F.struct("n_rules", "conditions", "tables_read", "tables_written")), 256))


def region_coverage(anchors: DataFrame, rules: DataFrame, gap: int = 2) -> DataFrame:
    """Regions of lines worth citing that no rule cites.

    ``anchors``: object_id, line; ``rules``: object_id, line_start, line_end.
    Uncovered lines at most ``gap`` apart are one region.  Lines and starts of
    rules are read in one order: a line is covered if a rule that has started
    ends there or later.
    """
    from marlstone.operators.relate import islands

    lines = anchors.select("object_id", F.col("line").cast("long").alias("line"), F.lit(None).cast("long").alias("until"))
    starts = rules.filter("line_start >= 0 and object_id is not null").select("object_id", F.col("line_start").cast("long").alias("line"), F.greatest("line_start", "line_end").cast("long").alias("until"))
    order = Window.partitionBy("object_id").orderBy("line", F.desc_nulls_last("until"))
    seen = lines.unionByName(starts).withColumn("__end", F.max("until").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("until is null")
    # a line is once in its object; equal ones are neighbours
    once = seen.withColumn("__again", F.lag(F.struct("line")).over(Window.partitionBy("object_id").orderBy("line")).eqNullSafe(F.struct("line")))
    left = once.filter(~F.col("__again") & F.coalesce(F.col("__end") < F.col("line"), F.lit(True))).select("object_id", F.col("line").cast(anchors.schema["line"].dataType).alias("line"))
    return islands(left, ["object_id"], "line", gap).groupBy("object_id", "island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n_lines")).drop("island")


def predicate_lines(statements: DataFrame, tokens: Column) -> DataFrame:
    """Each line of a filtered write with its statement and predicate words.

    ``statements``: object_id, statement_id, operation, predicate, line_start,
    line_end; ``tokens`` are of the predicate.
    """
    writes = statements.filter(F.col("operation").isin("UPDATE", "INSERT", "DELETE", "MERGE") & (F.coalesce("predicate", F.lit("")) != ""))
    return writes.select("object_id", "statement_id", tokens.alias("tokens"), F.explode(F.sequence("line_start", "line_end")).alias("line")).filter(F.size("tokens") > 0)


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"^[Nn]?'(.*)'$", "$1")


_SET = r"^\s*([\w.\[\]@#]+)\s*:?=\s*([^=].*?)\s*$"


def reconciled_rules(rules: DataFrame, rows: DataFrame, linked: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Each rule's axes and status against the evidence found for it.

    ``rules``: object_id, rule_id, rule_type, fields, conditions, outcomes
    (arrays).  ``rows``: object_id, rule_id, field, condition, expression, one
    for each assignment that is evidence for the rule.  ``linked`` and
    ``fallbacks`` hold the (object_id, rule_id) of rules that a decision chain
    has, and of those whose condition is the complement of a chain's.

    An axis matches if all that the rule says is known; it conflicts if both
    sides can be compared and differ.  Conditions are compared as comparisons,
    else as texts; outcomes as assignments, as single values, else as texts.  A
    field that only differs is no conflict if a chain has the rule and another
    axis matches: it may be a variable that is written on later.  Any conflict
    makes the rule CONFLICT, else any match MATCHED, else it is UNRESOLVED; with
    no evidence at all it is LLM_ONLY, or MATCHED if it was made of a chain.
    """
    from marlstone.functions.classify import comparison, simple_scalar

    key = ["object_id", "rule_id"]
    text = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    field = lambda x: F.lower(column_reference(F.trim(x)))
    compared = lambda x: F.when(comparison(x).isNotNull(), F.concat_ws(" ", field(comparison(x)["left"]), comparison(x)["op"], fragment(_unquoted(comparison(x)["right"]))))
    assigned = lambda left, right: F.concat(field(left), F.lit(" = "), fragment(_unquoted(right)))
    known = rows.filter(F.coalesce("field", "condition", "expression").isNotNull()).groupBy(*key).agg(
        F.collect_set(field(F.col("field"))).alias("k_fields"), F.collect_set(fragment(F.col("condition"))).alias("k_conditions"), F.collect_set(compared(F.col("condition"))).alias("k_compared"),
        F.collect_set(fragment(_unquoted(F.col("expression")))).alias("k_values"), F.collect_set(assigned(F.col("field"), F.col("expression"))).alias("k_assigned"), F.collect_set(F.when(simple_scalar(F.col("expression")), fragment(_unquoted(F.col("expression"))))).alias("k_scalars"), F.count("*").alias("n_rows"),
    )
    flagged = lambda d, name: d.select(*key).distinct().withColumn(name, F.lit(True))
    is_set = lambda x: x.rlike(_SET)
    some = lambda c: F.filter(text(F.col(c)), lambda x: F.trim(x) != "")
    claimed = rules.select(*key, "rule_type", F.transform(some("fields"), field).alias("c_fields"), some("conditions").alias("c_conditions"), some("outcomes").alias("c_outcomes"))
    claimed = claimed.select(
        *key, "rule_type", "c_fields", F.transform("c_conditions", fragment).alias("c_conditions"), F.array_compact(F.transform("c_conditions", compared)).alias("c_compared"), F.transform("c_outcomes", lambda x: F.when(is_set(x), fragment(_unquoted(F.regexp_extract(x, _SET, 2)))).otherwise(fragment(_unquoted(x)))).alias("c_values"),
        F.transform(F.filter("c_outcomes", is_set), lambda x: assigned(F.regexp_extract(x, _SET, 1), F.regexp_extract(x, _SET, 2))).alias("c_assigned"), F.transform(F.filter("c_outcomes", lambda x: ~is_set(x) & simple_scalar(x)), lambda x: fragment(_unquoted(x))).alias("c_scalars"),
    )
    both = claimed.join(known, key, "left").join(flagged(linked, "linked"), key, "left").join(flagged(fallbacks, "fallback"), key, "left")
    within = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_except(a, b)) == 0)
    two = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    sets = both.select(*key, "rule_type", flag("linked").alias("linked"), flag("fallback").alias("fallback"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), *(text(F.col(f"{s}_{c}")).alias(f"{s}_{c}") for s in "ck" for c in ("fields", "conditions", "compared", "values", "assigned", "scalars")))
    tests = sets.select(
        *key, "rule_type", "linked", "fallback", "n_rows", within("c_fields", "k_fields").alias("field"), two("c_fields", "k_fields").alias("fields_meet"),
        within("c_compared", "k_compared").alias("compared"), two("c_compared", "k_compared").alias("compared_meet"), ((F.size("c_compared") == 0) & within("c_conditions", "k_conditions")).alias("told"),
        within("c_assigned", "k_assigned").alias("assigned"), two("c_assigned", "k_assigned").alias("assigned_meet"), within("c_scalars", "k_scalars").alias("scalar"), two("c_scalars", "k_scalars").alias("scalars_meet"), ((F.size("c_assigned") == 0) & (F.size("c_scalars") == 0) & within("c_values", "k_values")).alias("said"),
    )
    matched = tests.withColumn("condition", F.expr("compared or told or fallback")).withColumn("outcome", F.expr("assigned or scalar or said"))
    against = matched.select(
        *key, "rule_type", "n_rows", "field", "condition", "outcome", F.expr("fields_meet and not field and not (linked and (condition or outcome))").alias("no_field"), F.expr("compared_meet and not compared and not fallback").alias("no_condition"),
        F.expr("assigned_meet and not assigned and not (linked and scalar) or scalars_meet and not scalar").alias("no_outcome"),
    )
    axis = lambda name: F.when(F.col("n_rows") == 0, "UNRESOLVED").when(F.col(name), "MATCHED").when(F.col(f"no_{name}"), "CONFLICT").otherwise("UNRESOLVED").alias(f"{name}_status")
    alone = F.when(F.lower(F.trim(F.coalesce("rule_type", F.lit("")))) == "deterministic_decision_table", "MATCHED").otherwise("LLM_ONLY")
    status = F.when(F.col("n_rows") == 0, alone).when(F.expr("no_field or no_condition or no_outcome"), "CONFLICT").when(F.expr("field or condition or outcome"), "MATCHED").otherwise("UNRESOLVED")
    return against.select(*key, axis("field"), axis("condition"), axis("outcome"), status.alias("status"))


def coverage_gaps(lines: DataFrame, rules: DataFrame, threshold: float = 0.3, gap: int = 2) -> DataFrame:
    """Lines that no rule shows any sign of having read, by regions.

    ``lines``: object_id, line, tokens, predicate (words and numbers of the
    line's own filter, empty for others), literals (numbers of the line that the
    filter has), cited (a rule quotes the line); ``rules``: object_id, rule_id,
    tokens, predicate (words and numbers of its evidence).

    A line's words are weighted by how few rules and regions of the object have
    them.  A line of a filter is covered if a rule has two of the filter's words
    (or its only one) and, if the line has numbers of it, one of them; any other
    line if a rule has ``threshold`` of its weight and two of its words (or its
    only one).  Neighbouring lines up to ``gap`` apart are a region.
    """
    from marlstone.operators.relate import islands

    key = ["object_id", "line"]
    some = lines.filter(F.size("tokens") > 0)
    region = islands(some, ["object_id"], "line", gap)
    groups = region.select("object_id", "island", F.explode("tokens").alias("token")).distinct()
    told = rules.select("object_id", "rule_id", F.explode("tokens").alias("token")).distinct()
    documents = groups.select("object_id", F.concat(F.lit("g"), "island").alias("doc"), "token").unionByName(told.select("object_id", F.concat(F.lit("r"), "rule_id").alias("doc"), "token"))
    often = documents.groupBy("object_id", "token").agg(F.count("*").alias("df"))
    counted = documents.groupBy("object_id").agg(F.count_distinct("doc").alias("n"))
    weight = (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("weight")
    own = some.select(*key, F.explode(F.array_distinct("tokens")).alias("token")).join(often, ["object_id", "token"]).join(counted, "object_id").select(*key, "token", weight)
    total = own.groupBy(*key).agg(F.sum("weight").alias("total"), F.count("*").alias("n_tokens"))
    shared = own.join(told, ["object_id", "token"]).groupBy(*key, "rule_id").agg(F.sum("weight").alias("shared"), F.count("*").alias("overlap"))
    best = shared.groupBy(*key).agg(F.max(F.struct("shared", "overlap")).alias("b")).select(*key, "b.*")
    filters = some.filter(F.size("predicate") > 0).select(*key, "predicate", "literals").join(rules.select("object_id", F.col("tokens").alias("said"), F.col("predicate").alias("known")), "object_id")
    words = F.size(F.array_intersect("said", "predicate"))
    enough = (words > 0) & ((F.size("predicate") < 2) | (words >= 2)) & ((F.size("literals") == 0) | F.arrays_overlap("literals", "known"))
    covered = filters.groupBy(*key).agg(F.bool_or(F.coalesce(enough, F.lit(False))).alias("covered"))
    all_ = some.join(total, key).join(best, key, "left").join(covered, key, "left")
    thin = (F.coalesce(F.col("shared") / F.col("total"), F.lit(0.0)) < threshold) | ((F.col("n_tokens") >= 2) & (F.coalesce("overlap", F.lit(0)) < 2))
    missed = all_.filter(~F.col("cited") & F.when(F.size("predicate") > 0, ~F.coalesce("covered", F.lit(False))).otherwise(thin))
    return islands(missed.select(*key), ["object_id"], "line", gap).groupBy("object_id", "island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n_lines")).drop("island")
