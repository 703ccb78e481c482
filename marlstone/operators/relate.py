"""Interval, tiered and ordered joins, call graphs and rule pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.arrow import mapped
from marlstone.functions.classify import space, spaces_overlap
from marlstone.session import checkpointed


def half_open_overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """[a, b) and [c, d); unknown ends never overlap."""
    return F.coalesce((a < d) & (c < b), F.lit(False))


def closed_overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.coalesce((a <= d) & (c <= b), F.lit(False))


def overlap_join(left: DataFrame, right: DataFrame, key: Sequence[str], width: int, how: str = "inner") -> DataFrame:
    """Rows with equal keys and overlapping [start, end) spans.

    Spans are cut at multiples of ``width``; a pair is taken in the first cell
    that both touch, so the join is on equality and no pair comes twice.
    ``left`` has start, end; ``right`` has r_start, r_end.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    a = left.filter("start < end").withColumn("__cell", cells("start", "end"))
    b = right.filter("r_start < r_end").withColumn("__cell", cells("r_start", "r_end"))
    first = F.col("__cell") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("r_start") / width))
    return a.join(b, [*key, "__cell"], how).filter(half_open_overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) & first).drop("__cell")


def tiered(pairs: DataFrame, key: Sequence[str], tiers: Sequence[Column]) -> DataFrame:
    """Each key's pairs of the first tier that any of its pairs is in."""
    first = F.coalesce(*(F.when(test, F.lit(i)) for i, test in enumerate(tiers, 1)))
    ranked = pairs.withColumn("tier", first).filter("tier is not null")
    best = F.min("tier").over(Window.partitionBy(*key))
    return ranked.withColumn("__best", best).filter("tier = __best").drop("__best")


def dependencies(operations: DataFrame) -> DataFrame:
    """Earlier write to later use of one table, in one object.

    ``operations``: object_id, statement_id, ord, table_name, operation,
    fields (array), conditional.  UPDATE after UPDATE needs common fields and
    is unresolved unless both are unconditional.
    """
    table = F.upper(F.trim("table_name")).alias("t")
    base = operations.filter(F.col("ord").isNotNull())
    write = base.filter(F.col("operation").isin("INSERT", "UPDATE", "MERGE")).select("object_id", table, F.col("statement_id").alias("producer"), F.col("ord").alias("po"), F.col("operation").alias("pop"), F.col("fields").alias("pf"), F.col("conditional").alias("pc"))
    use = base.select("object_id", table, F.col("statement_id").alias("consumer"), F.col("ord").alias("co"), F.col("operation").alias("cop"), F.col("fields").alias("cf"), F.col("conditional").alias("cc"))
    # sizes after Python functions and explodes are underestimates, so no broadcast
    pairs = write.hint("merge").join(use, ["object_id", "t"]).filter("po < co and producer <> consumer")
    updates = (F.col("pop") == "UPDATE") & (F.col("cop") == "UPDATE")
    kind = (
        F.when(updates & ~F.arrays_overlap("pf", "cf"), None).when(updates & ~F.col("pc") & ~F.col("cc"), "OVERRIDES").when(updates, "UNRESOLVED")
        .when(F.col("cop") == "READ", "FEEDS").when(F.col("cop").isin("INSERT", "UPDATE", "MERGE"), "REWRITES").when(F.col("cop").isin("DELETE", "TRUNCATE"), "CLEARS")
    )
    return pairs.withColumn("kind", kind).filter("kind is not null").select("object_id", "producer", "consumer", F.col("t").alias("table_name"), "kind")


def write_only(operations: DataFrame) -> DataFrame:
    """Temporary tables that are written and never read."""
    temp = operations.filter(F.col("table_name").startswith("#")).withColumn("t", F.upper("table_name"))
    written = temp.filter("operation <> 'READ'").select("object_id", "t").distinct()
    return written.join(temp.filter("operation = 'READ'"), ["object_id", "t"], "left_anti")


def alias_maps(operations: DataFrame) -> DataFrame:
    """object_id and a map of capital aliases to tables, the first of each."""
    named = operations.filter(F.coalesce("alias", F.lit("")) != "").select("object_id", F.upper("alias").alias("a"), "table_name", F.struct("pos", "op_index").alias("o"))
    first = named.groupBy("object_id", "a").agg(F.min_by("table_name", "o").alias("t"))
    return first.groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "t"))).alias("aliases"))


def call_graph(calls: DataFrame, objects: DataFrame) -> DataFrame:
    """Callees by qualified name; by bare name if one object has it; never self.

    ``calls``: caller, target.  ``objects``: object_id, schema, name.
    """
    full = objects.select(F.col("object_id").alias("by_full"), F.lower(F.concat_ws(".", "schema", "name")).alias("fk"))
    full = full.groupBy("fk").agg(F.min("by_full").alias("by_full"))
    bare = objects.groupBy(F.lower("name").alias("bk")).agg(F.min("object_id").alias("by_bare"), F.count("*").alias("n")).filter("n = 1").drop("n")
    key = F.lower(F.translate("target", '[]"', ""))
    named = calls.withColumn("__full", key).withColumn("__bare", F.element_at(F.split(key, r"\."), -1))
    found = named.join(full, F.col("__full") == F.col("fk"), "left").join(bare, F.col("__bare") == F.col("bk"), "left")
    callee = F.coalesce("by_full", "by_bare")
    return found.select("caller", "target", F.when(callee != F.col("caller"), callee).alias("callee"))


def roots(objects: DataFrame, edges: DataFrame) -> DataFrame:
    called = edges.filter("callee is not null").select(F.col("callee").alias("object_id"))
    return objects.join(called, "object_id", "left_anti")


def rule_pairs(rules: DataFrame) -> DataFrame:
    """Pairs of rows of different rules that disagree: a common field,
    overlapping conditions, different outcomes.

    ``rules``: object_id, rule_id, pos, field, condition, outcome.
    """
    spaced = rules.withColumn("space", space(F.col("condition")))
    a = spaced.select("object_id", "field", F.col("rule_id").alias("a"), F.col("pos").alias("pa"), F.col("space").alias("sa"), F.col("outcome").alias("oa"))
    b = spaced.select("object_id", "field", F.col("rule_id").alias("b"), F.col("pos").alias("pb"), F.col("space").alias("sb"), F.col("outcome").alias("ob"))
    pairs = a.join(b, ["object_id", "field"]).filter("pa < pb and a <> b and lower(trim(oa)) <> lower(trim(ob))")
    return pairs.filter(spaces_overlap(F.col("sa"), F.col("sb"))).select("object_id", "field", "a", "b", "oa", "ob").distinct()


def alias_closure(pairs: DataFrame) -> DataFrame:
    """Transitive (name, target) pairs; a name isn't its own alias by a cycle.

    Each step doubles the distance that is known.  A pair up to twice as far
    apart has a shortest way through a name at just the old distance, so only
    pairs of that distance are joined with what is known, and a pair is found
    about once and not once for every name between.  No pair at the distance
    means none beyond it.  Each step's pairs are kept once, so that they aren't
    computed again for the next one.
    """
    reached = checkpointed(pairs.select("name", "target").distinct().withColumn("far", F.lit(1)))
    far, front = 1, reached
    while not (last := front.filter(F.col("far") == far)).isEmpty():
        known = reached.select(F.col("name").alias("via"), "target", "far")
        ways = last.select("name", F.col("target").alias("via")).join(known, "via").filter("name <> target").select("name", "target", (F.col("far") + far).alias("far"))
        nearest = ways.unionByName(reached).groupBy("name", "target").agg(F.min("far").alias("far"))
        front = checkpointed(nearest.filter(F.col("far") > far))
        reached, far = reached.unionByName(front), 2 * far
    return reached.drop("far")


def islands(rows: DataFrame, key: Sequence[str], at: str, gap: float, order: Sequence[str] = ()) -> DataFrame:
    """Numbers runs in which neighbours are at most ``gap`` apart."""
    window = Window.partitionBy(*key).orderBy(at, *order)
    breaks = F.coalesce((F.col(at) - F.lag(at).over(window) > gap).cast("int"), F.lit(1))
    return rows.withColumn("__break", breaks).withColumn("island", F.sum("__break").over(window)).drop("__break")


def one_to_one(left: DataFrame, right: DataFrame, group: str, tiers: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Greedy one-to-one matching of claims and facts in input order.

    Tiers are (status, columns that must agree); each claim in turn takes the
    first free fact of its first tier that has one.  The result depends on what
    was taken before, so a group is one fold; a group is one object's
    operations.  Facts are taken per section, the column ``section``.  Groups
    are lists of rows, so that a batch of groups goes to Python at once.
    """
    names = sorted({c for _, cols in tiers for c in cols})

    def fold(rows: list[dict]) -> list[dict]:
        rows.sort(key=lambda x: (x["pos"] is None, x["pos"]))
        # by tier and agreed values, the places of facts in order; what is taken is skipped
        facts = [r for r in rows if not r["claims"]]
        known = lambda x, cols: all(x[c] is not None and x[c] == x[c] for c in cols)
        waiting: list[dict[tuple, list[int]]] = [{} for _ in tiers]
        for place in range(len(facts) - 1, -1, -1):
            for (_, cols), places in zip(tiers, waiting):
                if known(facts[place], cols):
                    places.setdefault((facts[place]["section"], *(facts[place][c] for c in cols)), []).append(place)
        taken, out = set(), []
        for claim in (r for r in rows if r["claims"]):
            status, fact = "LLM_ONLY", None
            for (name, cols), places in zip(tiers, waiting):
                own = places.get((claim["section"], *(claim[c] for c in cols)), [])
                while own and own[-1] in taken:
                    own.pop()
                if own:
                    status, fact = name, own.pop()
                    taken.add(fact)
                    break
            out.append({"section": claim["section"], "claim": claim["pos"], "fact": None if fact is None else facts[fact]["pos"], "status": status})
        return out + [{"section": f["section"], "fact": f["pos"], "status": "DETERMINISTIC_ONLY"} for i, f in enumerate(facts) if i not in taken]

    # columns of their own, as both sides may come from one DataFrame
    a, b = (x.select(F.col(group).alias(group), F.struct(F.lit(claims).alias("claims"), *(F.col(c).alias(c) for c in ("section", "pos", *names))).alias("__row")) for x, claims in ((left, True), (right, False)))
    grouped = a.unionByName(b).groupBy(group).agg(F.collect_list("__row").alias("__rows"))
    matched = mapped(fold, "array<struct<section:string,claim:long,fact:long,status:string>>", F.col("__rows"))
    return grouped.select(group, F.explode(matched).alias("__m")).select(group, "__m.*")


def siblings(branches: DataFrame, touched: DataFrame, chain: Sequence[str]) -> DataFrame:
    """All branches of the chains of which one is touched."""
    return branches.join(touched.select(*chain).distinct(), list(chain), "left_semi")
