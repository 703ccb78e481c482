"""Coverage, quality, set metrics and telemetry; undefined is null, not 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column) -> Column:
    """100 of nothing; else to one decimal."""
    return F.when(whole == 0, 100.0).otherwise(F.round(F.try_divide(100.0 * part, whole), 1))


def coverage(branches: DataFrame, chain: str, covered: str) -> DataFrame:
    """Per chain: branches, covered ones, percentage and status."""
    counted = branches.groupBy(chain).agg(F.count("*").alias("n"), F.count_if(F.col(covered)).alias("n_covered"))
    status = F.when(F.col("n_covered") == F.col("n"), "full").when(F.col("n_covered") > 0, "partial").otherwise("none")
    return counted.withColumn("pct", percentage(F.col("n_covered"), F.col("n"))).withColumn("status", status)


#: Counts and percentages that ``quality`` reads; null percentages count as absent.
COVERAGE = "total_statements synthesized_rules deterministic_facts high medium low llm_only_rules deterministic_only_facts unresolved chain_count chain_branches chain_pct parse_pct grounding_pct matched".split()


def quality(c: dict[str, Column], unsupported: Column) -> Column:
    """Struct (score, status, review, chain_penalty) of an object's coverage.

    Counts are taken by volume, each penalty up to a cap of its own; absent
    provenance, rules or matches cost a fixed number of points.
    """
    n = {k: F.coalesce(c[k].cast("double"), F.lit(0.0)) for k in COVERAGE if k != "chain_pct"}
    one = F.lit(1.0)
    rules, facts = F.greatest(n["synthesized_rules"], one), F.greatest(n["deterministic_facts"], one)
    volume = F.greatest(n["synthesized_rules"], n["total_statements"], n["deterministic_facts"], one)
    share = lambda count, whole, weight, cap: F.least(F.lit(float(cap)), n[count] / whole * 100 * weight)
    fixed = lambda test, points: F.when(test, float(points)).otherwise(0.0)
    chains = ~unsupported & (n["chain_count"] > 0) & (n["chain_branches"] > 0) & c["chain_pct"].isNotNull()
    gap = F.when(chains, F.greatest(F.lit(0.0), 100.0 - F.greatest(F.lit(0.0), F.least(F.lit(100.0), c["chain_pct"].cast("double"))))).otherwise(0.0)
    chain_penalty = F.least(F.lit(15.0), gap * 0.15)
    low = lambda k: (n[k] > 0) & (n[k] < 75)
    lost = (
        fixed(unsupported, 20) + fixed(n["total_statements"] == 0, 15) + fixed(n["synthesized_rules"] == 0, 15) + share("high", volume, 0.20, 40) + share("medium", volume, 0.08, 20) + share("low", volume, 0.03, 10)
        + share("llm_only_rules", rules, 0.07, 15) + share("deterministic_only_facts", facts, 0.02, 10) + share("unresolved", volume, 0.02, 15) + chain_penalty + fixed(low("parse_pct"), 10) + fixed(low("grounding_pct"), 10) + fixed(n["matched"] == 0, 10)
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - lost))
    review = (n["high"] > 0) | (n["medium"] > 0) | (n["unresolved"] > 0) | (n["llm_only_rules"] > 0) | (gap > 0)
    doubtful = unsupported | (n["parse_pct"] < 50) | (n["grounding_pct"] < 50) | (score < 60) | (n["total_statements"] == 0) | (n["synthesized_rules"] == 0)
    status = F.when(review, "REVIEW_REQUIRED").when(doubtful, "LOW_CONFIDENCE").otherwise("PASS")
    return F.struct(score.alias("score"), status.alias("status"), (review | unsupported).alias("review"), chain_penalty.alias("chain_penalty"))


def ledger_counts(items: DataFrame, by: str) -> DataFrame:
    """Constructs by state: the whole number and that of the four open states."""
    state = lambda name: F.count_if(F.col("status") == name).alias(f"{name}_count")
    return items.groupBy(by).agg(F.count("*").alias("construct_count"), *map(state, ("uncovered", "parser_failed", "dynamic_unresolved", "unsupported")))


def token_usage(usage: Column) -> Column:
    """Struct of the tokens of a provider's JSON answer: prompt, completion,
    total (their sum if it isn't told) and whether all are known."""
    known = lambda k: F.get_json_object(usage, f"$.{k}").try_cast("long")
    prompt, completion = known("prompt_tokens"), known("completion_tokens")
    total = F.coalesce(known("total_tokens"), prompt + completion)
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in (prompt, completion, total)), F.lit(0))
    state = F.when(n == 0, "unavailable").when(n == 3, "available").otherwise("partial")
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), total.alias("total_tokens"), state.alias("availability"))


def usage_summary(calls: DataFrame, by: list[str]) -> DataFrame:
    """Tokens of calls, summed as far as they are known.

    ``calls``: usage, a struct of ``token_usage``.  A total that no call tells
    is the sum of the other two; it is available only if all numbers are.
    """
    tokens = ("prompt_tokens", "completion_tokens", "total_tokens")
    state = lambda c: F.when(F.count(c) == 0, "unavailable").when(F.count(c) == F.count(F.lit(1)), "available").otherwise("partial")
    of = [x for c in tokens for x in (F.sum(f"usage.{c}").alias(c), state(F.col(f"usage.{c}")).alias(f"s_{c}"))]
    s = calls.groupBy(*by).agg(*of, F.count("*").alias("n_calls"))
    derived = F.col("total_tokens").isNull() & F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull()
    both = (F.col("s_prompt_tokens") == "available") & (F.col("s_completion_tokens") == "available")
    s = s.withColumn("s_total_tokens", F.when(derived, F.when(both, "available").otherwise("partial")).otherwise(F.col("s_total_tokens"))).withColumn("total_tokens", F.when(derived, F.col("prompt_tokens") + F.col("completion_tokens")).otherwise(F.col("total_tokens")))
    states = F.array_distinct(F.array(*(f"s_{c}" for c in tokens)))
    whole = F.when(F.size(states) == 1, F.when(F.get(states, F.lit(0)) == "partial", "partial").otherwise(F.get(states, F.lit(0)))).otherwise("partial")
    return s.select(*by, *tokens, whole.alias("availability"), "n_calls")


def coverage_metrics(statements: DataFrame, records: DataFrame, contradictions: DataFrame) -> DataFrame:
    """An object's counts for its quality.

    ``statements``: object_id, parsed; ``records``: object_id, kind, status,
    supported (has deterministic evidence), unsupported (its dialect is);
    ``contradictions``: object_id, review.  What review is for and what a score
    counts differ: a score takes what only a model says, and contradictions, on
    their own.
    """
    is_rule = F.col("kind") == "rule"
    state = lambda name: F.col("status") == name
    shaky = F.col("unsupported") & state("MATCHED")
    parsed = statements.groupBy("object_id").agg(F.count("*").alias("total_statements"), F.count_if("parsed").alias("parsed_statements"))
    counted = records.groupBy("object_id").agg(
        F.count_if(is_rule).alias("synthesized_rules"), F.count_if(is_rule & F.col("supported")).alias("rules_with_deterministic_support"), F.count_if(state("LLM_ONLY")).alias("llm_only_rules"), F.count_if(state("DETERMINISTIC_ONLY")).alias("deterministic_only_facts"),
        F.count_if(state("CONFLICT")).alias("conflicts"), F.count_if(state("CONFLICT") | state("LLM_ONLY") | state("UNRESOLVED") | shaky).alias("__review"), F.count_if(state("CONFLICT") | state("UNRESOLVED") | shaky).alias("unresolved_for_scoring"),
    )
    against = contradictions.groupBy("object_id").agg(F.count("*").alias("contradictions"), F.count_if("review").alias("__more"))
    whole = parsed.join(counted, "object_id", "full").join(against, "object_id", "full")
    whole = whole.na.fill(0, [c for c in whole.columns if c != "object_id"])
    share = lambda part, of: F.when(F.col(of) > 0, F.round(100.0 * F.col(part) / F.col(of), 1))
    return whole.select(
        "object_id", "total_statements", "parsed_statements", (F.col("total_statements") - F.col("parsed_statements")).alias("unparsed_statements"), "synthesized_rules", "rules_with_deterministic_support", "llm_only_rules", "deterministic_only_facts", "conflicts", "contradictions",
        (F.col("__review") + F.col("__more")).alias("review_required_items"), "unresolved_for_scoring", share("parsed_statements", "total_statements").alias("statement_parse_success_pct"), share("rules_with_deterministic_support", "synthesized_rules").alias("rule_grounding_pct"),
    )


def section_ceiling(most: Column, limit: Column, prompt: int = 5200, margin: int = 200, each: int = 256) -> Column:
    """Tokens to plan sections for: what a model can give, within what an
    account's limit per minute leaves beside the prompt."""
    return F.when(limit.isNull(), most).otherwise(F.greatest(F.lit(each), F.least(most, limit - prompt - margin)))


def output_tokens(points: Column, requested: Column, base: int = 16000, each: int = 256) -> Column:
    """Tokens that an answer on so many decision points needs."""
    return F.greatest(F.coalesce(requested, F.lit(0)), F.lit(base)) + points * each


def compare_sets(expected: DataFrame, actual: DataFrame, on: list[str], by: str) -> DataFrame:
    """Per ``by``: matches, missing, unexpected, precision, recall, F1."""
    e = expected.select(by, *on).distinct().withColumn("e", F.lit(1))
    a = actual.select(by, *on).distinct().withColumn("a", F.lit(1))
    both = e.join(a, [by, *on], "full")
    counted = both.groupBy(by).agg(F.count_if(F.expr("e = 1 and a = 1")).alias("n_match"), F.count_if(F.expr("e = 1 and a is null")).alias("n_missing"), F.count_if(F.expr("e is null and a = 1")).alias("n_unexpected"))
    n = F.col("n_match")
    precision, recall = F.try_divide(n, n + F.col("n_unexpected")), F.try_divide(n, n + F.col("n_missing"))
    f1 = F.when(precision.isNull() | recall.isNull(), None).when(precision + recall == 0, 0.0).otherwise(F.try_divide(2 * precision * recall, precision + recall))
    return counted.select(by, "n_match", "n_missing", "n_unexpected", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def same_scalar(a: Column, b: Column) -> Column:
    """Equal after normalising; never equal if empty."""
    norm = lambda x: F.lower(F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"\s+", " ")))
    return (norm(a) != "") & (norm(a) == norm(b))


def sum_if_known(x: Column) -> Column:
    """Aggregate: null if no value is known."""
    return F.sum(x)


def availability(x: Column) -> Column:
    """Aggregate: available, partial or unavailable."""
    return F.when(F.count(x) == 0, "unavailable").when(F.count(x) == F.count(F.lit(1)), "available").otherwise("partial")


def stage_of(stage: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(stage), F.lit("")), F.lit("unknown"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.round(F.try_divide(hits.cast("double"), hits + misses), 6)


def percentage_change(base: Column, now: Column) -> Column:
    return F.round(F.try_divide((now - base) * 100.0, base), 4)


def worst_status(statuses: Column) -> Column:
    """Aggregate: FAIL before CHANGED before PASS."""
    return F.when(F.bool_or(statuses == "FAIL"), "FAIL").when(F.bool_or(statuses == "CHANGED"), "CHANGED").otherwise("PASS")
