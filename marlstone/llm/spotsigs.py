"""SpotSigs: chains of content words that follow common-word anchors.

A signature is an anchor and the ``chain`` content words after it; a text's
fingerprint is the set of its signatures.  Sets can be alike by ``t`` only if
their sizes differ by a factor of at most 1/t, so sets are partitioned by size
and the comparison stops as soon as t is out of reach.

Anchors are common words of some languages, and words that ``RUN`` content
words follow without one between, as in lists, or in languages without anchors
here.  A text without any chain is spotted at every word, one of under three
words at every character (trigrams), and one shorter still is a single
signature of itself; nothing else depends on the length of a text.  Null texts count as
empty; empty sets don't occur, as the empty text is its own signature.  Long
texts are taken whole.  Equal texts have equal fingerprints.

Documents are in the order of their ids, of any type that can be ordered; null
ids come first, and rows that share an id are in the order of their texts.
Each row has its own result.  Columns other than doc_id and text are ignored,
whatever their names; an empty table gives no rows.  A single document is its
own next one.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.durable import released

_WORD = re.compile(r"\w+")
ANCHORS = frozenset(
    """a an and are as at be been but by for from had has have he her his if in is it its my no not of on or our she so that the their them there they this to was we were what when which who will with would you your
    al como con de del el en es esta este la las le lo los mas más me mi muy no nos o para pero por que qué se si sin sobre su sus también un una uno y ya
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur te un une vous à été
    aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wenn werden wie wir wird zu zum zur über
    che di e gli i il non per più sono
    com da do dos em mais na nas não os uma
    aan dat deze die een het hij ik maar naar niet ook op te van voor wat ze zijn""".split()
)


#: Content words without an anchor that make the word before them one.
RUN = 8
#: Likeness below this counts as none; sizes that differ by more are apart.
LEAST = 0.1
#: Sampled ids by which documents are dealt if their ids aren't numbers.
SAMPLE = 1 << 16


def signatures(text: str, chain: int = 2, anchors: frozenset = ANCHORS) -> set[str]:
    words = _WORD.findall(text.lower())
    found: set[str] = set()
    run = 0
    if chain == 2:
        # the same as below, for the usual length
        one = two = None
        for word in reversed(words):
            if word not in anchors:
                if run >= RUN:
                    found.add(f"{word} {one} {two}")
                run += 1
                two, one = one, word
            else:
                run = 0
                if two is not None:
                    found.add(f"{word} {one} {two}")
    else:
        after: list[str] = []
        for word in reversed(words):
            anchor = word in anchors
            if len(after) == chain and (anchor or run >= RUN):
                found.add(" ".join((word, *after)))
            run = 0 if anchor else run + 1
            if not anchor:
                after = [word, *after[: chain - 1]]
    if not found:
        found = {" ".join(words[i : i + chain + 1]) for i in range(len(words) - chain)}
    if not found:
        found = {text[i : i + 3] for i in range(len(text) - 2)}
    return found or {text}


def digest(found: set[str]) -> str:
    """The set's size and 128 bits of its members, in order."""
    return f"{len(found)}-{xxhash.xxh3_128_hexdigest(chr(10).join(sorted(found)).encode())}"


def partition(size: int, least: float) -> int:
    """Sets whose partitions aren't the same or neighbours can't be alike by
    ``least``: within one, sizes differ by a factor below 1/least."""
    return int(math.log(size) / -math.log(least) + 1e-9) if least < 1 else size


def likeness(a: set[str], b: set[str], least: float = LEAST) -> float:
    """Jaccard; 0 as soon as it can't reach ``least`` (above 0, at most 1)."""
    if len(a) > len(b):
        a, b = b, a
    if partition(len(b), least) - partition(len(a), least) > 1 or len(a) < least * len(b) - 1e-9:
        return 0.0
    common, misses = 0, len(a) - least / (1 + least) * (len(a) + len(b))
    for x in a:
        if x in b:
            common += 1
        else:
            misses -= 1
            if misses < -1e-9:
                return 0.0
    return common / (len(a) + len(b) - common)


def _part(key: Column, bounds: list, kind: str = "bigint") -> Column:
    """How many bounds are at most ``key``, by bisection."""
    if not bounds:
        return F.lit(0)
    # one literal, however many bounds
    table, steps = F.from_json(F.lit(json.dumps([str(b) for b in bounds])), "array<string>").cast(f"array<{kind}>"), len(bounds).bit_length()

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.get(table, middle) <= key)
        return F.struct(F.when(up, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(F.least(s["hi"], middle)).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["lo"])


def _place(docs: DataFrame) -> Column:
    """A number that rises with the id: integers themselves, else how many
    sampled ids are at most the id."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.IntegralType):
        return F.col("doc_id").cast("long")
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    ratio = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (hashed < ratio * (1 << 30))).distinct().orderBy("doc_id")
    return _part(F.col("doc_id"), [r[0] for r in some.collect()], kind.simpleString()).cast("long")


def with_next(docs: DataFrame, part_bytes: int = 1 << 21, most_parts: int = 1 << 16) -> tuple[DataFrame, int]:
    """Rows dealt by ranges of doc_id, each range sorted and followed by the
    next range's first document (``ahead``); the last one by the first of all.

    Only ids go to the driver: one bound a range.  There are ``most_parts`` of
    them at most, of more bytes then; a range is read in order with one
    document held, so its size is no limit.
    """
    low = -(2**63)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(_place(docs), F.lit(low)).alias("at"))
    ids = rows.select("at")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, min(most_parts, size // part_bytes))
    shares = [k / parts for k in range(1, parts)]
    bounds = sorted(set(ids.agg(F.percentile_approx("at", shares, 10 * parts).alias("b")).first()["b"] or [])) if shares else []
    firsts = {x["part"]: x["at"] for x in ids.groupBy(_part(F.col("at"), bounds).alias("part")).agg(F.min("at").alias("at")).collect()}
    order = sorted(firsts)
    before = dict(zip(order, order[-1:] + order[:-1]))
    earlier = F.from_json(F.lit(json.dumps([before.get(k, 0) for k in range(len(bounds) + 1)])), "array<int>")
    place = lambda part, ahead: F.struct(part.alias("part"), F.lit(ahead).alias("ahead"))
    numbered = rows.withColumn("part", _part(F.col("at"), bounds))
    opening = F.from_json(F.lit(json.dumps([firsts.get(k, low) for k in range(len(bounds) + 1)])), "array<bigint>")
    is_first = F.get(opening, F.col("part")) == F.col("at")
    to = F.when(is_first, F.array(place(F.col("part"), False), place(F.get(earlier, F.col("part")), True))).otherwise(F.array(place(F.col("part"), False)))
    dealt = numbered.select("doc_id", "text", "at", F.explode(to).alias("to")).select("doc_id", "text", "at", "to.part", "to.ahead")
    n = max(len(order), 1)
    return dealt.repartition(n, "part").sortWithinPartitions("part", "ahead", "at", "doc_id", "text").select("doc_id", "text", "part", "ahead"), n


def compare_with_next(docs: DataFrame, chain: int = 2, edited: int = 4) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and their likeness.

    The edited text has its last 1/``edited`` of code points replaced by as
    many from the start of the next document by doc_id.
    """
    dealt, _ = with_next(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        key = pa.null()
        for batch in released(batches):
            key, rows = batch.schema.field(0).type, []
            for doc, text, part, ahead in zip(*(c.to_pylist() for c in batch.columns)):
                own = None
                if held is not None and held[0] == part and not (held[4] and ahead):
                    own = signatures(text, chain)
                    _, last, last_text, last_own, _ = held
                    cut = len(last_text) // edited
                    other = last_text[: len(last_text) - cut] + text[:cut]
                    other_own = last_own if other == last_text else signatures(other, chain)
                    rows.append((last, len(last_text), hashlib.sha256(other.encode()).hexdigest(), digest(last_own), digest(other_own), likeness(last_own, other_own), likeness(last_own, own)))
                # of rows that share the next range's first id, the first is next
                if ahead:
                    held = (part, None, None, None, True)
                else:
                    held = (part, doc, text, signatures(text, chain) if own is None else own, False)
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], key), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, chain: int = 2) -> DataFrame:
    """doc_id and the fingerprint itself: its signatures, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(signatures(t or "", chain)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["doc_id", "signatures"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, signatures array<string>")


def near_pairs(docs: DataFrame, least: float = 0.8, chain: int = 2) -> DataFrame:
    """Pairs (a, b, likeness) of classes of equal fingerprints, a < b.

    A class is named by its least doc_id; ``fingerprints`` gives membership.
    Sets that are alike by ``least`` share one of their rarest signatures:
    all but ceil(least * size) of them and one more.  These meet within size
    partitions (steps of a factor 1/least and the one above) and are compared.
    """
    sets = fingerprints(docs, chain).groupBy("signatures").agg(F.min("doc_id").alias("id")).withColumn("size", F.size("signatures"))
    step = F.floor(F.log("size") / -F.log(F.lit(least))).cast("int") if least < 1 else F.col("size")
    flat = sets.select("id", F.explode("signatures").alias("s"))
    often = flat.groupBy("s").agg(F.count("*").alias("n"))
    ranked = flat.join(often, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("rare"))
    rare = ranked.select("id", F.explode(F.expr(f"slice(rare, 1, size(rare) - cast(ceil({least} * size(rare) - 1e-9) as int) + 1)")).alias("r")).select("id", F.col("r.s").alias("s"))
    keyed = rare.join(sets.select("id", "size", step.alias("step")), "id")
    lower = keyed.select(F.col("id").alias("a"), "s", "step", F.col("size").alias("na"))
    upper = keyed.select(F.col("id").alias("b"), "s", F.explode(F.array("step", F.col("step") - 1, F.col("step") + 1)).alias("step"), F.col("size").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)
    pairs = lower.join(upper, ["s", "step"]).filter(fits).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("signatures").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("signatures").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("likeness")).filter(F.col("likeness") >= least - 1e-9)
