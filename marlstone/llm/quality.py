"""Quality by weak supervision: rules vote, their accuracies are estimated.

Each rule reads one ratio of the text and votes good, bad or abstains.
Expectation-maximisation over the counts of vote patterns (at most 3 to the
number of rules, so the counts have a bound whatever the corpus) estimates how
often each rule votes what in good and in bad documents; a document's verdict
is its posterior probability of being good.  All documents count.  Everything
that touches text is DataFrame functions.

Null and empty texts have no words and fail the base test; long texts are
counted whole.  Repeated rows are judged each.  A doc_id may be null.  A
posterior of exactly a half is good.  Other columns of the input, whatever
their names, are ignored by ``judge`` and kept by ``keep_good``; an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.durable import durable

SPACES = " \\t\\n\\x0b\\f\\r"


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(docs: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns and the counts that base test and rules need.

    Counts are of whole texts.  The kept columns travel as one struct, so
    their names may be any.
    """
    text = docs.select(F.struct(*kept).alias("__kept"), F.coalesce("text", F.lit("")).alias("text"))
    words = text.select(
        "__kept",
        F.array_remove(F.split("text", f"[{SPACES}]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{SPACES}]")).alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).alias("n_upper"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).alias("n_bangs"),
        F.length(F.regexp_replace("text", r"[^\p{L}\p{M}\p{N}]+", "")).alias("n_letters"),
        F.regexp_count("text", F.lit(r"[.?!。！？।](?=[\s\p{Pe}\p{Pf}\"']|$)")).alias("n_ends"),
    )
    sized = words.select(
        "__kept", "n_symbols", "n_upper", "n_bangs", "n_letters", "n_ends", "words",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    # windows of three words as (hash, place), sorted: equal windows are neighbours
    windows = sized.withColumn(
        "windows",
        F.sort_array(
            F.transform(
                F.slice("words", 1, F.greatest(F.col("n_words") - 2, F.lit(0))),
                lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")),
            )
        ),
    ).drop("words")
    hash_at = lambda i: F.get("windows", i)["h"]
    again = F.filter("windows", lambda w, i: F.coalesce(hash_at(i - 1) == w["h"], F.lit(False)) | F.coalesce(hash_at(i + 1) == w["h"], F.lit(False)))
    starts = F.sort_array(F.transform(again, lambda w: w["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return windows.select("__kept", *(F.col(c).cast("long").alias(c) for c in COUNTS[:-1]), covered.cast("long").alias(COUNTS[-1]), "n_upper", "n_bangs", "n_lines", "n_letters", "n_ends")


def _vote(good: Column | None, bad: Column) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, each 1 (good), -1 (bad) or 0 (abstains), over ``features``.

    Most know one fault and abstain on its absence, which says little of the
    other faults; a ratio without a denominator is null and abstains.
    """
    word, chars = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("word_chars"), F.lit(0))
    mean, letters, ends = F.col("word_chars") / word, F.col("n_letters") / chars, F.col("n_ends") / word
    return {
        "symbols": _vote(None, F.col("n_symbols") / word > 0.1),
        "bangs": _vote(None, F.col("n_bangs") / word > 0.1),
        "upper": _vote(None, F.col("n_upper") / chars > 0.35),
        "repeats": _vote(None, F.col("n_repeat_words") / word > 0.4),
        "lines": _vote(None, F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)) > 0.4),
        "mean": _vote(None, ~mean.between(2, 14)),
        "letters": _vote(letters > 0.93, letters < 0.87),
        "sentences": _vote(ends.between(0.02, 0.34), (ends < 0.01) | (ends > 0.6)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, float]]]:
    """Log-odds prior and per rule the log-odds of each vote, by EM.

    Starts from 80 % good and rules right four times in five.  Estimates are
    smoothed by one document a vote, and a vote for good never counts against
    it (nor one for bad against bad), so classes can't swap names.
    """
    total, k = sum(n for _, n in patterns), len(patterns[0][0]) if patterns else 0
    prior, weights = math.log(4), [{1: math.log(4), 0: 0.0, -1: -math.log(16)} for _ in range(k)]
    for _ in range(rounds if total else 0):
        good = 0.0
        by_vote = [{v: [1.0, 1.0] for v in (1, 0, -1)} for _ in range(k)]
        for votes_of, n in patterns:
            p = 1 / (1 + math.exp(-max(-50, min(50, prior + sum(w[v] for w, v in zip(weights, votes_of))))))
            good += n * p
            for rule, v in zip(by_vote, votes_of):
                rule[v][0] += n * p
                rule[v][1] += n * (1 - p)
        prior = math.log((good + 1) / (total - good + 1))
        for weight, rule in zip(weights, by_vote):
            all_good, all_bad = (sum(x[c] for x in rule.values()) for c in (0, 1))
            odds = {v: math.log(x[0] / all_good) - math.log(x[1] / all_bad) for v, x in rule.items()}
            # abstaining is no evidence
            weight.update({1: max(odds[1], 0.0), 0: 0.0, -1: min(odds[-1], 0.0)})
    return prior, weights


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _patterns(found: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """Vote patterns of all documents and how many have each."""
    names = [f"vote_{k}" for k in votes()]
    counted = found.groupBy(*names).agg(F.count("*").alias("n")).collect()
    return sorted((tuple(x[c] for c in names), x["n"]) for x in counted)


def _posterior(patterns: list[tuple[tuple[int, ...], int]], rounds: int) -> Column:
    prior, weights = fit(patterns, rounds)
    odds = F.lit(prior)
    for name, weight in zip(votes(), weights):
        vote = F.col(f"vote_{name}")
        odds = odds + F.when(vote > 0, weight[1]).when(vote < 0, weight[-1]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _voted(docs: DataFrame, *kept: str) -> DataFrame:
    return features(docs, *kept).select("*", *(v.alias(f"vote_{k}") for k, v in votes().items()))


def judge(docs: DataFrame, rounds: int = 50) -> DataFrame:
    """doc_id, the counts, base_failed, kept and posterior, per document."""
    found = durable(_voted(docs, "doc_id"))
    judged = found.select("*", F.expr(BASE_FAILED).alias("base_failed"), _posterior(_patterns(found), rounds).alias("posterior"))
    return judged.select("__kept.doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")


def keep_good(docs: DataFrame, rounds: int = 50) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    The counts are taken twice, once for the estimate and once for the
    verdict: that costs less than a join of all texts with their verdicts, and
    rows needn't have an id.
    """
    posterior = _posterior(_patterns(_voted(docs, "text")), rounds)
    # a filter moves below deterministic columns and takes their expressions
    # with it, once for each use; it doesn't move below a row number
    judged = _voted(docs, *docs.columns).withColumn("__row", F.monotonically_increasing_id())
    return judged.filter((F.col("__row") >= 0) & ~F.expr(BASE_FAILED) & (posterior >= 0.5)).select("__kept.*")
