"""What plans must not do, as tables grow."""

import re

import pyarrow as pa

from marlstone.functions import arrow
from marlstone.operators import evidence, relate
from marlstone.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def run_before_dealing(df):
    """Whether some Python function runs below the exchange that deals objects out."""
    lines = plan(df).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :|+-"))
    for at, line in enumerate(lines):
        for under in lines[at + 1 :] if "REPARTITION_BY_NUM" in line else []:
            # lines of code within the plan's text have no mark
            if under.lstrip(" :|")[:2] in ("+-", ":-") and depth(under) <= depth(line):
                break
            if "EvalPython" in under:
                return True
    return False


def test_rows_of_objects_are_not_broadcast(spark, small):
    for name in ("e_dependencies", "e_rewritten"):
        assert "Broadcast" not in plan(catalogue.queries()[name](spark, small)), name


def test_objects_are_dealt_out_before_they_are_read(spark, small):
    for name in ("t_statement_split", "t_go_batches", "e_table_operations", "e_predicates", "e_assignments", "e_decision_rows", "e_calculations", "t_pack_chunks", "e_gate_summary"):
        assert not run_before_dealing(catalogue.queries()[name](spark, small)), name


def test_spans_start_at_the_nearest_second(spark, tmp_path):
    """Fractions that floored seconds would pair wrongly; halves go to even."""
    import duckdb
    from compare import differences

    seconds = [(1, 10.6, "purchase"), (2, 310.4, "view"), (3, 310.6, "view"), (4, 311.5, "view"), (5, 610.5, "purchase"), (6, 12.5, "view"), (7, 312.0, "purchase")]
    rows = ", ".join(f"({i}, 1, '{kind}', TIMESTAMP '2024-01-01' + to_microseconds({round(s * 1e6)}))" for i, s, kind in seconds)
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, user_id, event_type, ts)) TO '{tmp_path}/events.parquet'")
    assert differences(catalogue.queries()["j_overlap_spans"](spark, str(tmp_path)), catalogue.oracle_sql()["j_overlap_spans"], str(tmp_path)) == ""


def test_groups_are_matched_in_batches(spark):
    """No frame a group; nulls agree on the section only, and each fact is taken once."""
    schema = "o string, section string, pos long, t string, op string"
    claims = spark.createDataFrame([("o", "w", 3, "A", "U"), ("o", None, 1, "A", "U"), ("o", "w", 2, None, "U"), ("p", "w", 1, "A", "U")], schema)
    facts = spark.createDataFrame([("o", "w", 9, "A", "D"), ("o", "w", 8, "A", "U"), ("o", None, 5, "A", "U"), ("o", "w", 7, None, "U")], schema)
    got = relate.one_to_one(claims, facts, "o", [("MATCHED", ["t", "op"]), ("CONFLICT", ["t"])])
    assert "CoGroups" not in plan(got)
    expected = {("o", None, 1, 5, "MATCHED"), ("o", "w", 2, None, "LLM_ONLY"), ("o", "w", 3, 8, "MATCHED"), ("o", "w", None, 7, "DETERMINISTIC_ONLY"), ("o", "w", None, 9, "DETERMINISTIC_ONLY"), ("p", "w", 1, None, "LLM_ONLY")}
    assert {tuple(r) for r in got.collect()} == expected


def test_tokens_of_a_length_need_no_text(spark, small):
    assert "repeat(" not in plan(catalogue.queries()["t_budgets"](spark, small))


def test_closures_find_each_pair_about_once(spark):
    """Rings, chains, forks and loops against brute force; bytes shuffled a pair."""
    edges = [(100 * r + i, 100 * r + (i + 1) % 40) for r in range(50) for i in range(40)]
    edges += [(9000 + i, 9000 + (i * i + 1) % 23) for i in range(23)] + [(9000 + i, 9000 + i // 2) for i in range(23)] + [(9900, 9901), (9901, 9901)]
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    expected = set(edges)
    for a in ahead:
        seen, todo = set(), [a]
        while todo:
            new = ahead.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        expected |= {(a, b) for b in seen if a != b}
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = [tuple(r) for r in relate.alias_closure(spark.createDataFrame(edges, "name int, target int")).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert (written() - before) / len(got) < 100


def test_covered_lines_are_not_listed(spark):
    """A rule of many lines is one row, and all goes through one exchange."""
    anchors = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (1, 30), (1, 33), (1, None), (2, 5), (None, 5)], "object_id int, line int")
    rules = spark.createDataFrame([(1, 1, 10**9), (1, -1, 99), (2, 6, 9), (2, 7, 4), (None, 1, 9)], "object_id int, line_start int, line_end int")
    found = evidence.region_coverage(anchors, rules)
    assert "explode" not in plan(found).lower() and plan(found).count("Exchange") == 1
    assert {tuple(r) for r in found.collect()} == {(1, None, None, 1), (2, 5, 5, 1), (None, 5, 5, 1)}
    found = evidence.region_coverage(anchors, rules.filter("line_end < 10"))
    assert {tuple(r) for r in found.collect()} == {(1, 5, 6, 2), (1, 30, 30, 1), (1, 33, 33, 1), (1, None, None, 1), (2, 5, 5, 1), (None, 5, 5, 1)}


def test_long_results_leave_a_worker_in_parts(spark, small):
    seen = []
    made = arrow.parts(lambda t: seen.append(t) or [t] * 3, pa.list_(pa.string()), (pa.array(["x"] * 1000),), 64)
    assert len(next(made)) == len(seen) == 64 and sum(map(len, made)) == 936
    for name in ("t_overlap_chunks", "v_hash_embed"):
        df = catalogue.queries()[name](spark, small)
        # 200 is the pandas function of a whole batch, 250 the Arrow one
        assert not re.search(r"EvalPython .*, 2[05]0$", plan(df), re.M), name
        assert df.count() > 0
