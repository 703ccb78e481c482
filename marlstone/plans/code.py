"""Queries over the corpus of SQL objects, with rows written by hand as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import classify, masking, procedures, splitting, sqlops, text
from marlstone.operators import dedup, measures, relate, report
from marlstone.plans.common import Catalogue, Tables
from marlstone.plans.fixtures import TEMPLATES, expected, objects
from marlstone.session import checkpointed

CATALOGUE = Catalogue()
add = CATALOGUE.sql


def code(t: Tables) -> DataFrame:
    return objects(t.customer)


def statements(t: Tables) -> DataFrame:
    """Statements of each object, with its dialect."""
    scored = classify.dialects(code(t).withColumn("text", masking.masked(F.col("code"), identifiers=True)))
    return splitting.statements(scored.select("object_id", "code", F.col("detected.dialect").alias("dialect"))).drop("code")


def operations(t: Tables) -> DataFrame:
    spoken = F.when(F.col("dialect") == "ORACLE", "ORACLE").otherwise("TSQL")
    return sqlops.table_operations(statements(t), dialect=spoken).filter("operation is not null")


#: Lines of a statement each, from 1; of the PL/SQL function, parts of lines.
_LINES = {0: [(1, 1), (2, 2), (3, 3), (4, 5), (6, 9), (10, 12), (13, 13), (14, 15), (16, 16), (17, 17)], 1: [(1, 1), (2, 2), (3, 9), *((k, k) for k in range(10, 18))], 3: [(1, 1), (2, 3)], 4: [(1, 2), *((k, k) for k in range(3, 17))]}
_PARTS = [
    "CREATE OR REPLACE FUNCTION r§N.grade§K(p_id IN NUMBER, p_out OUT VARCHAR2) RETURN VARCHAR2 IS\nv_days NUMBER;", "v_grade VARCHAR2(10);", "BEGIN", "SELECT NVL(days_due, 0) INTO v_days FROM r§N.accounts WHERE id = p_id;", "IF v_days > 90 THEN v_grade := 'C';", "ELSIF v_days > 30 THEN",
    "IF p_id = §K THEN v_grade := 'B1';", "ELSE v_grade := 'B2';", "END IF;", "ELSE v_grade := 'A';", "END IF;", "RETURN v_grade;", "EXCEPTION WHEN NO_DATA_FOUND THEN RETURN 'NONE';", "END;",
]


def _split() -> list[tuple]:
    rows = [(2, i, part) for i, part in enumerate(_PARTS)]
    for k, spans in _LINES.items():
        lines = TEMPLATES[k].split("\n")
        rows += [(k, i, "\n".join(lines[a - 1 : b]).strip()) for i, (a, b) in enumerate(spans)]
    return rows


@add(expected("pos statement", _split()))
def t_statement_split(t: Tables) -> DataFrame:
    """Spans that tile each object's code, a statement each."""
    return statements(t).filter(f"object_id % {len(TEMPLATES)} <> 5").select("object_id", "pos", F.regexp_replace("statement", r"^\s+|\s+$", "").alias("statement"))


@add(expected("pos n_batches first_word", [(0, 0, 1, "CREATE"), (1, 0, 2, "CREATE"), (1, 1, 2, "EXEC('SELECT 1')"), (2, 0, 1, "CREATE"), (3, 0, 1, "CREATE"), (4, 0, 1, "CREATE"), (5, 0, 1, "CREATE")]))
def t_go_batches(t: Tables) -> DataFrame:
    parts = code(t).select("object_id", splitting.batches(F.col("code")).alias("b"))
    each = parts.select("object_id", F.size("b").alias("n_batches"), F.posexplode_outer("b").alias("pos", "batch")).filter("pos is not null")
    word = F.when(F.col("batch").contains("EXEC('"), F.regexp_replace("batch", r"\s+$|^\s+", "")).otherwise(F.regexp_extract("batch", r"^\s*(\w+)", 1))
    return each.select("object_id", "pos", "n_batches", word.alias("first_word"))


@add(expected("line body", [(0, 5, "-- UPDATE n§N.Accounts SET Bucket = 'OLD' WHERE Balance = 0;")]))
def t_inactive_code(t: Tables) -> DataFrame:
    """Commented-out statements and their lines."""
    found = code(t).select("object_id", "code", F.explode(splitting.inactive(F.col("code"))).alias("x"))
    return found.select("object_id", text.line_of(F.col("code"), F.col("x.start")).alias("line"), "x.body")


_OBJECTS = [
    (0, "TSQL", "high", "PROCEDURE", "n§N", "Aging§K", ["n§N.Notify"], ["2020-03-31"], False, 6), (1, "TSQL", "high", "PROCEDURE", "n§N", "Settle§K", [], [], True, 3), (2, "ORACLE", "high", "FUNCTION", "r§N", "grade§K", [], [], False, 6),
    (3, "UNKNOWN", "low", "VIEW", "n§N", "Open§K", [], [], False, 0), (4, "TSQL", "high", "PROCEDURE", "n§N", "Tier§K", [], [], False, 3), (5, "TSQL", "high", "PROCEDURE", "n§N", "MainRun§K", ["n§N.StepB", "n§N.Settle7"], [], False, 3),
]


@add(expected("dialect confidence type schema name calls dates dynamic n_decisions", _OBJECTS))
def c_objects(t: Tables) -> DataFrame:
    """Dialect, type, name, calls, dates and flags of each object."""
    shown = masking.executable(F.col("code"))
    found = classify.dialects(code(t).select("object_id", "code", shown.alias("executable"), masking.masked(F.col("code"), identifiers=True).alias("text"), masking.masked(F.col("code")).alias("hidden")))
    name = classify.object_name(F.col("executable"))
    return found.select(
        "object_id", "detected.*", classify.object_type(F.col("executable")).alias("type"), name["schema"].alias("schema"), name["name"].alias("name"),
        classify.called_procedures(F.col("hidden")).alias("calls"), classify.hardcoded_dates(F.col("executable")).alias("dates"), classify.dynamic_sql(F.col("executable")).alias("dynamic"), classify.decision_points(F.col("hidden")).alias("n_decisions"),
    )


_PARAMETERS = [
    (0, "parameterized", 0, "AsOf", "IN", "DATE", None), (0, "parameterized", 1, "Branch", "IN", "VARCHAR(10)", "'ALL'"), (2, "parameterized", 0, "p_id", "IN", "NUMBER", None), (2, "parameterized", 1, "p_out", "OUT", "VARCHAR2", None),
    (4, "parameterized", 0, "Score", "IN", "INT", None), (4, "parameterized", 1, "Out", "OUT", "VARCHAR(10)", None), (1, "parameterless", None, None, None, None, None), (3, "parameterless", None, None, None, None, None), (5, "parameterless", None, None, None, None, None),
]


@add(expected("status pos name direction datatype initial", _PARAMETERS))
def c_parameters(t: Tables) -> DataFrame:
    """Formal parameters of each object's header."""
    p = code(t).select("object_id", procedures.parameters(F.col("code")).alias("p"))
    return p.select("object_id", "p.status", F.posexplode_outer("p.parameters").alias("pos", "x")).select("object_id", "status", "pos", "x.*")


_OPERATIONS = [
    (0, 4, 0, "n§N.Accounts", "UPDATE", "A"), (0, 4, 1, "n§N.Customers", "READ", "C"), (0, 4, 2, "n§N.Closures", "READ", "Z"), (0, 5, 0, "n§N.Accounts", "UPDATE", ""), (0, 6, 0, "#Late", "INSERT", ""), (0, 6, 1, "n§N.Accounts", "READ", ""), (0, 7, 0, "n§N.Watch", "INSERT", ""), (0, 7, 1, "n§N.Accounts", "READ", ""),
    (1, 2, 0, "n§N.Totals", "MERGE", "T"), (1, 2, 1, "n§N.Accounts", "READ", ""), (1, 3, 0, "n§N.Watch", "DELETE", ""), (1, 3, 1, "n§N.Closures", "READ", ""), (1, 3, 2, "n§N.Extra", "READ", ""), (1, 4, 0, "n§N.Scratch", "TRUNCATE", ""),
    (2, 3, 0, "r§N.accounts", "READ", ""), (3, 1, 0, "n§N.Totals", "READ", ""), (3, 1, 1, "n§N.Customers", "READ", "C"),
    (4, 2, 0, "n§N.Staff Members", "UPDATE", ""), (4, 4, 0, "n§N.Staff Members", "UPDATE", ""), (4, 7, 0, "n§N.Queue", "INSERT", ""), (4, 7, 1, "n§N.Notes", "READ", ""), (4, 7, 2, "n§N.Work", "READ", "w"), (4, 7, 3, "n§N.Rest", "READ", ""), (4, 12, 0, "n§N.Queue", "DELETE", ""), (4, 14, 0, "n§N.Log", "INSERT", ""),
    (5, 2, 0, "n§N.RunningProcessStatus", "READ", ""), (5, 4, 0, "n§N.ProcessMonitor", "INSERT", ""), (5, 7, 0, "n§N.RunningProcessStatus", "READ", ""), (5, 13, 0, "n§N.AuditStatus", "UPDATE", ""), (5, 15, 0, "n§N.RunningProcessStatus", "READ", ""),
]
#: A write that reads its own table is a read too.
_BOTH = _OPERATIONS + [(*x[:4], "READ", x[5]) for x in _OPERATIONS if x[4] in ("UPDATE", "MERGE")]


@add(expected("pos op_index table_name operation alias", _BOTH))
def e_table_operations(t: Tables) -> DataFrame:
    """One row for each table that a statement reads or writes."""
    return sqlops.with_reads_of_writes(operations(t)).select("object_id", "pos", "op_index", "table_name", "operation", "alias")


_PREDICATES = [
    (0, 4, "A.Balance > §K AND NOT EXISTS (SELECT 1 FROM n§N.Closures Z WHERE Z.AccountId = A.AccountId)", ["n§N.Customers INNER A.CustomerId = C.CustomerId AND C.Active = 'Y'"], ["NOT EXISTS SELECT 1 FROM n§N.Closures Z WHERE Z.AccountId = A.AccountId"]),
    (0, 5, "", [], []), (0, 6, "DaysDue > 90", [], []), (0, 7, "Bucket = 'LATE3'", [], []), (1, 2, "T.CustomerId = S.CustomerId", [], []), (1, 3, "AccountId IN (SELECT AccountId FROM n§N.Closures, n§N.Extra WHERE Id = §K)", [], []), (1, 4, "", [], []),
    (2, 3, "id = p_id", [], []), (3, 1, "B.CustomerId IS NOT NULL", ["big LEFT B.CustomerId = C.CustomerId"], []), (4, 2, "Id = §K", [], []), (4, 4, "", [], []), (4, 7, "", [], []), (4, 12, "", [], []), (4, 14, "", [], []), (5, 2, "", [], []), (5, 4, "", [], []), (5, 7, "", [], []), (5, 13, "", [], []), (5, 15, "", [], []),
]


@add(expected("pos predicate joined existing", _PREDICATES))
def e_predicates(t: Tables) -> DataFrame:
    """Filters, join conditions and EXISTS tests of statements."""
    o = operations(t).filter("op_index = 0")
    joined = F.transform("joins", lambda j: F.concat_ws(" ", j["table_name"], j["kind"], j["predicate"]))
    return o.select("object_id", "pos", "predicate", joined.alias("joined"), F.transform("exists", lambda e: F.concat_ws(" ", e["kind"], e["predicate"])).alias("existing"))


_ASSIGNED = [
    (0, 4, "A.DaysDue", "DATEDIFF(DAY, A.DueDate, @AsOf)", "", ""), (0, 4, "A.Fee", "A.Balance * 0.02", "", ""), (0, 7, "AccountId", "AccountId", "", ""), (0, 7, "Amount", "Balance + Fee", "", ""), (1, 2, "T.Total", "T.Total + S.Total", "MATCHED", "T.Locked = 0"),
    (1, 2, "CustomerId", "S.CustomerId", "NOT_MATCHED_BY_TARGET", ""), (1, 2, "Total", "S.Total", "NOT_MATCHED_BY_TARGET", ""), (4, 2, "Tier", "'GOLD'", "", ""), (4, 4, "Tier", "'SILVER'", "", ""), (4, 7, "StaffId", "x", "", ""), (4, 7, "Note", "(SELECT MAX(y) FROM n§N.Notes)", "", ""), (4, 7, "Tier", "'NONE'", "", ""),
    (4, 14, "Id", "§K", "", ""), (4, 14, "Note", "CHOOSE(@Score, 'low', 'high')", "", ""), (5, 4, "UserID", "ORIGINAL_LOGIN()", "", ""), (5, 4, "Description", "'StepB'", "", ""), (5, 4, "MODE", "'RUNNING'", "", ""), (5, 13, "CompletedCount", "CompletedCount+1", "", ""),
]


@add(expected("pos column expression branch condition", _ASSIGNED))
def e_assignments(t: Tables) -> DataFrame:
    """What is assigned to which column, by branch of a MERGE."""
    each = operations(t).select("object_id", "pos", F.explode("assignments").alias("a")).select("object_id", "pos", "a.*")
    return each.filter("column <> 'Bucket'").select("object_id", "pos", "column", "expression", "branch", "condition")


_ROWS = [
    (0, 5, "Bucket", 0, "DaysDue > 90", "'LATE3'"), (0, 5, "Bucket", 1, "(DaysDue > 60) AND (Secured = 1)", "'LATE2S'"), (0, 5, "Bucket", 2, "DaysDue > 60", "'LATE2'"), (0, 5, "Bucket", 3, "DaysDue > 0", "'LATE1'"), (0, 5, "Bucket", 4, "ELSE", "'CURRENT'"),
    (4, 14, "Note", 0, "CONVERT(INT, @Score) = 1", "'low'"), (4, 14, "Note", 1, "CONVERT(INT, @Score) = 2", "'high'"), (4, 14, "Note", 2, "ELSE", "NULL"),
]


@add(expected("pos field branch condition outcome", _ROWS))
def e_decision_rows(t: Tables) -> DataFrame:
    """Leaf rows of assigned CASE and CHOOSE expressions."""
    assigned = operations(t).select("object_id", "pos", F.explode("assignments").alias("a"))
    return assigned.select("object_id", "pos", F.col("a.column").alias("field"), F.posexplode(sqlops.decisions(F.col("a.expression"))).alias("branch", "row")).select("object_id", "pos", "field", "branch", "row.*")


_DENIED = "NOT (@Score >= 90) AND NOT (@Score >= 70)"
_LADDERS = [
    (2, 0, 0, "v_days > 90", "v_days > 90", "", "v_grade", "'C'", 5, 8), (2, 0, 2, "ELSE", "NOT (v_days > 90) AND NOT (v_days > 30)", "", "v_grade", "'A'", 5, 8), (2, 1, 0, "p_id = §K", "p_id = §K", "", "v_grade", "'B1'", 7, 7), (2, 1, 1, "ELSE", "NOT (p_id = §K)", "", "v_grade", "'B2'", 7, 7),
    (4, 0, 0, "@Score >= 90", "@Score >= 90", "Id = §K", "Tier", "'GOLD'", 3, 11), (4, 0, 1, "@Score >= 70", "@Score >= 70", "", "Tier", "'SILVER'", 3, 11), (4, 0, 2, "ELSE", _DENIED, "", "StaffId", "x", 3, 11), (4, 0, 2, "ELSE", _DENIED, "", "Note", "(SELECT MAX(y) FROM n§N.Notes)", 3, 11),
    (4, 0, 2, "ELSE", _DENIED, "", "Tier", "'NONE'", 3, 11), (4, 0, 2, "ELSE", _DENIED, "", "Out", "'BRONZE'", 3, 11),
]


@add(expected("chain branch condition effective row_filter field outcome line_start line_end", _LADDERS))
def e_ladders(t: Tables) -> DataFrame:
    """Ladders in which a field is set in two branches; nested ones apart."""
    return code(t).select("object_id", F.explode(procedures.ladders(masking.executable(F.col("code")))).alias("row")).select("object_id", "row.*")


_GATES = [
    (5, 1, "run_step", "StepB", "'StepA' has completed and 'StepB' has not yet completed", ["n§N.StepB"], False, "n§N.RunningProcessStatus", 3, True),
    (5, 2, "abort_if_incomplete", "StepB", "'StepB' has not yet completed", [], True, "n§N.RunningProcessStatus", 11, False),
    (5, 3, "run_step", "Settle7", "'StepB' has completed", ["n§N.Settle7"], False, "n§N.RunningProcessStatus", 20, False),
]


@add(expected("sequence gate_type step precondition procedures aborts status_table line resumes", _GATES))
def e_process_gates(t: Tables) -> DataFrame:
    """Guarded steps of a run, in order."""
    return code(t).select("object_id", F.explode(procedures.gates(F.col("code"))).alias("g")).select("object_id", "g.*")


@add(expected("total steps execution_order aborting resumable status_tables", [(5, 3, 2, ["StepB", "Settle7"], 1, True, ["n§N.RunningProcessStatus"])]))
def e_gate_summary(t: Tables) -> DataFrame:
    found = code(t).select("object_id", procedures.gates(F.col("code")).alias("g"))
    return found.select("object_id", procedures.gate_summary(F.col("g")).alias("s")).filter("s is not null").select("object_id", "s.*")


_FORMULAS = [(0, "n§N.Accounts", "A.DaysDue", "DATEDIFF(DAY, A.DueDate, @AsOf)"), (0, "n§N.Accounts", "A.Fee", "A.Balance * 0.02"), (0, "n§N.Watch", "Amount", "Balance + Fee"), (1, "n§N.Totals", "T.Total", "T.Total + S.Total"), (4, "n§N.Queue", "Note", "(SELECT MAX(y) FROM n§N.Notes)"), (5, "n§N.AuditStatus", "CompletedCount", "CompletedCount+1")]


@add(expected("table_name column expression", _FORMULAS))
def e_calculations(t: Tables) -> DataFrame:
    return sqlops.calculations(operations(t), "object_id")


_FLOWS = [
    (0, 4, 5, "N§N.ACCOUNTS", "FEEDS"), (0, 4, 6, "N§N.ACCOUNTS", "FEEDS"), (0, 4, 7, "N§N.ACCOUNTS", "FEEDS"), (0, 5, 6, "N§N.ACCOUNTS", "FEEDS"), (0, 5, 7, "N§N.ACCOUNTS", "FEEDS"),
    (4, 2, 4, "N§N.STAFF MEMBERS", "FEEDS"), (4, 2, 4, "N§N.STAFF MEMBERS", "UNRESOLVED"), (4, 7, 12, "N§N.QUEUE", "CLEARS"),
]


@add(expected("producer consumer table_name kind", _FLOWS))
def e_dependencies(t: Tables) -> DataFrame:
    """Which statement feeds which, through tables."""
    ops = sqlops.with_reads_of_writes(operations(t))
    # read on both sides of a join, taken apart once
    return relate.dependencies(checkpointed(ops.select("object_id", F.col("pos").alias("statement_id"), F.col("pos").alias("ord"), "table_name", "operation", F.col("columns").alias("fields"), (F.col("predicate") != "").alias("conditional"))))


@add(f"""SELECT c_custkey AS caller, replace(target, '§N', CAST(c_nationkey AS VARCHAR)) AS target, CASE WHEN target LIKE '%Settle7' THEN (SELECT c_custkey FROM customer WHERE c_custkey = 7) END AS callee FROM customer JOIN (VALUES (0, 'n§N.Notify'), (5, 'n§N.StepB'), (5, 'n§N.Settle7')) v(template, target) ON c_custkey % {len(TEMPLATES)} = template""")
def e_call_graph(t: Tables) -> DataFrame:
    """Calls by full name, else by a bare name that one object has."""
    base = code(t).select("object_id", masking.masked(F.col("code")).alias("text"))
    named = base.select("object_id", classify.object_name(F.col("text")).alias("n")).select("object_id", "n.schema", "n.name")
    calls = base.select(F.col("object_id").alias("caller"), F.explode(classify.called_procedures(F.col("text"))).alias("target"))
    return relate.call_graph(calls, named)


@add(expected("section claim fact status", [
    (0, "writes", 400, 400, "MATCHED"), (0, "reads", 401, 401, "MATCHED"), (0, "reads", 402, 402, "CONFLICT"), (0, "writes", 500, 500, "MATCHED"), (0, "writes", 600, 600, "CONFLICT"), (0, "reads", 601, 601, "MATCHED"), (0, "writes", 700, 700, "MATCHED"), (0, "reads", 701, 701, "MATCHED"),
    (1, "writes", 200, 200, "MATCHED"), (1, "reads", 201, 201, "CONFLICT"), (1, "writes", None, 300, "DETERMINISTIC_ONLY"), (1, "reads", 301, 301, "MATCHED"), (1, "reads", 302, 302, "MATCHED"), (1, "writes", 400, 400, "MATCHED"),
    (2, "reads", 300, 300, "CONFLICT"), (3, "reads", 100, 100, "MATCHED"), (3, "reads", 101, 101, "MATCHED"),
]))
def e_reconciled(t: Tables) -> DataFrame:
    """Claims against facts, one to one in order, per object."""
    # both sides come from them, so statements are taken apart once
    facts = checkpointed(operations(t).filter(f"object_id % {len(TEMPLATES)} < 4").select("object_id", F.when(F.col("operation") == "READ", "reads").otherwise("writes").alias("section"), (F.col("pos") * 100 + F.col("op_index")).alias("pos"), F.upper("table_name").alias("table_name"), "operation", "predicate"))
    claims = facts.filter("operation <> 'DELETE'").withColumn("predicate", F.when(F.col("pos") % 3 == 0, "changed").otherwise(F.col("predicate")))
    return relate.one_to_one(claims, facts, "object_id", [("MATCHED", ["table_name", "operation", "predicate"]), ("CONFLICT", ["table_name", "operation"]), ("CONFLICT", ["table_name"])]).select("object_id", "section", "claim", "fact", "status")


_PACKED = [
    (0, 0, "header", 0), (0, 1, "body", 0), (0, 2, "administrative", 0), (0, 3, "declaration", 0), (0, 4, "body", 0), (0, 5, "body", 6), (0, 6, "body", 0), (1, 0, "header", 0), (1, 1, "body", 3), (1, 2, "exception", 0), (1, 3, "body", 0), (1, 4, "administrative", 0), (1, 5, "body", 0),
    (2, 0, "header", 0), (2, 1, "body", 4), (2, 2, "body", 1), (2, 3, "exception", 1), (2, 4, "body", 0), (3, 0, "header", 0), (3, 1, "body", 0), (4, 0, "header", 0), (4, 1, "body", 3), (5, 0, "header", 0), (5, 1, "body", 3),
]


@add(expected("chunk family points", _PACKED))
def t_pack_chunks(t: Tables) -> DataFrame:
    """Neighbouring statements of a family merged while both budgets allow."""
    family = splitting.section_family(splitting.section_kind(F.col("statement")))
    kinds = statements(t).select("object_id", "pos", F.struct(F.col("statement").alias("text"), family.alias("family"), classify.decision_points(F.col("statement")).alias("points")).alias("p"))
    ordered = kinds.groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]).alias("pieces"))
    return ordered.select("object_id", F.posexplode(splitting.packed(F.col("pieces"), 10000, 4)).alias("chunk", "c")).select("object_id", "chunk", "c.family", "c.points")


@add(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
s AS (SELECT doc_id, list_reduce(list_prepend({'done': CAST([] AS VARCHAR[]), 'held': ''}, list_transform(ps, lambda x: {'done': CAST([] AS VARCHAR[]), 'held': x})), lambda a, x: CASE WHEN length(a.held) + length(x.held) + 2 <= 800
THEN {'done': a.done, 'held': CASE WHEN a.held = '' THEN x.held ELSE a.held || chr(10) || chr(10) || x.held END}
ELSE {'done': list_concat(a.done, CASE WHEN a.held = '' THEN CAST([] AS VARCHAR[]) ELSE [a.held] END, CASE WHEN length(x.held) <= 800 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(0, length(x.held), 700), lambda i: substr(x.held, i + 1, 800)) END), 'held': CASE WHEN length(x.held) <= 800 THEN x.held ELSE '' END} END) AS r FROM p),
c AS (SELECT doc_id, CASE WHEN r.held = '' THEN r.done ELSE list_append(r.done, r.held) END AS chunks FROM s)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk, CASE WHEN i = 1 THEN chunks[1] ELSE right(chunks[i - 1], 100) || chr(10) || chunks[i] END AS text FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM c)""")
def t_overlap_chunks(t: Tables) -> DataFrame:
    """Paragraphs packed to 800 characters, the last 100 in front of the next chunk."""
    return t.documents.select("doc_id", F.posexplode(splitting.chunked(F.col("text"))).alias("chunk", "text"))


@add("""SELECT o_orderkey, CASE WHEN n <= 3 THEN 1 ELSE CAST(ceil(n / 3.0) AS INTEGER) END AS n_pieces, CASE WHEN n <= 3 THEN [19 * n] ELSE list_concat(list_transform(range(0, n // 3), lambda i: 59), CASE n % 3 WHEN 0 THEN [] WHEN 1 THEN [19] ELSE [39] END) END AS sizes, CAST(greatest(1, ceil(n / 2.0)) AS INTEGER) AS n_dense
FROM (SELECT o_orderkey, CAST(o_orderkey % 11 AS INTEGER) AS n FROM orders)""")
def t_size_limits(t: Tables) -> DataFrame:
    """Code cut between statements, by size and by decision points."""
    n = (F.col("o_orderkey") % 11).cast("int")
    plain, dense = F.repeat(F.lit("UPDATE t SET a = 1\n"), n), F.repeat(F.lit("UPDATE t SET a = CASE WHEN b = 1 THEN 2 END\n"), n)
    cut = t.orders.select("o_orderkey", splitting.pieces(plain, splitting.size_limited, 60).alias("p"), splitting.pieces(dense, splitting.by_decisions, 4).alias("d"))
    return cut.select("o_orderkey", F.size("p").alias("n_pieces"), F.transform("p", F.length).alias("sizes"), F.size("d").alias("n_dense"))


_FOLDED = [("AAA", ["declaration:USE x|SET NOCOUNT ON|GO"]), ("RAA", ["k0:one|SET NOCOUNT ON|GO"]), ("ARA", ["k1:USE x|two|GO"]), ("RRA", ["k0:one", "k1:two|GO"]), ("AAR", ["k2:USE x|SET NOCOUNT ON|three"]), ("RAR", ["k0:one", "k2:SET NOCOUNT ON|three"]), ("ARR", ["k1:USE x|two", "k2:three"]), ("RRR", ["k0:one", "k1:two", "k2:three"])]


@add(f"""SELECT o_orderkey, folded FROM orders JOIN (VALUES {', '.join(f"({i}, {x[1]})" for i, x in enumerate(_FOLDED))}) v(i, folded) ON o_orderkey % 8 = i""")
def t_absorbed(t: Tables) -> DataFrame:
    """Sections that only administer a session join their neighbours."""
    key = F.col("o_orderkey") % 8
    section = lambda i, admin, real: F.struct(F.lit(f"k{i}").alias("kind"), F.when(F.shiftright(key, i) % 2 == 1, real).otherwise(admin).alias("text"))
    made = F.array(section(0, "USE x", "one"), section(1, "SET NOCOUNT ON", "two"), section(2, "GO", "three"))
    return t.orders.select("o_orderkey", F.transform(splitting.absorbed(made), lambda s: F.concat(s["kind"], F.lit(":"), F.replace(s["text"], F.lit("\n\n"), F.lit("|")))).alias("folded"))


@add("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 3 <> 2 AS simple, l_partkey % 3 = 0 AND l_suppkey % 2 = 0 AS unreachable, l_linenumber % 2 = 0 AND l_partkey % 5 <> 0 AS same FROM lineitem""")
def c_scalars(t: Tables) -> DataFrame:
    """Simple values, branches that a filter rules out, equal scalars."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    value = F.when(s % 3 == 0, "'text here'").when(s % 3 == 1, "-12.5").otherwise("a + b")
    branch = F.when(p % 3 == 0, "Due IS NULL").when(p % 3 == 1, "Due = 1").otherwise("due is null and x = 1")
    eligible = F.array(F.lit("Amount > 0"), F.when(s % 2 == 0, "due IS NOT NULL").otherwise("other IS NOT NULL"))
    a, b = F.when(p % 5 == 0, " ").otherwise(" Some  Text "), F.when(n % 2 == 0, "some text").otherwise("other")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", classify.simple_scalar(value).alias("simple"), classify.unreachable(branch, eligible).alias("unreachable"), measures.same_scalar(a, b).alias("same"))


@add("""WITH c AS (SELECT o_orderkey AS pos, o_custkey % 300 AS signature, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 END AS start FROM orders),
k AS (SELECT signature, start, min(pos) AS pos FROM c WHERE start IS NOT NULL GROUP BY 1, 2), u AS (SELECT signature, min(pos) AS pos FROM c WHERE start IS NULL GROUP BY 1),
f AS (SELECT signature, min(pos) AS pos FROM k GROUP BY 1)
SELECT signature, start, pos FROM k WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.signature = k.signature AND u.pos < (SELECT f.pos FROM f WHERE f.signature = k.signature) AND k.pos = (SELECT f.pos FROM f WHERE f.signature = k.signature))
UNION ALL SELECT signature, NULL, pos FROM u WHERE pos < coalesce((SELECT f.pos FROM f WHERE f.signature = u.signature), 9e18)""")
def a_chains_without_repeats(t: Tables) -> DataFrame:
    """Equal chains are one, unless both have known, other starts."""
    key = F.col("o_orderkey")
    chains = t.orders.select(key.alias("pos"), (F.col("o_custkey") % 300).alias("signature"), F.when(key % 3 != 0, key % 2).alias("start"))
    return dedup.chains_without_repeats(chains).select("signature", "start", "pos")


@add("""WITH c AS (SELECT o_orderkey AS pos, o_custkey % 200 AS g, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 't' || (o_orderkey % 3) END AS tab FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos) AS n, first_value(tab) OVER (PARTITION BY g ORDER BY pos) AS head, row_number() OVER (PARTITION BY g, tab ORDER BY pos) AS m FROM c)
SELECT pos FROM r WHERE n = 1 OR (head <> '' AND tab <> '' AND m = 1)""")
def a_contained_calculations(t: Tables) -> DataFrame:
    """Calculations once per table; a blank table is any table."""
    key = F.col("o_orderkey")
    rows = t.orders.select(key.alias("pos"), (F.col("o_custkey") % 200).alias("object_id"), F.lit("a + b").alias("expression"), F.lit("f").alias("field"), F.when(key % 3 == 0, " ").otherwise(F.concat(F.lit("t"), key % 3)).alias("table_name"))
    return report.contained_calculations(rows).select("pos")


_CALLED = [(0, "n§N.Notify", "@AsOf", None, 16), (5, "n§N.StepB", "@TIMEKEY=§K", None, 8), (5, "n§N.Settle7", "@TIMEKEY=§K", None, 22)]


@add(expected("name arguments returned line", _CALLED).replace('v."returned"', 'CAST(NULL AS VARCHAR) AS returned'))
def c_calls(t: Tables) -> DataFrame:
    """Procedures that are called by name, with arguments and lines."""
    return code(t).select("object_id", F.explode(procedures.found(F.col("code"), procedures.calls_of, procedures.CALLS)).alias("c")).select("object_id", "c.*")


@add(expected("value line", [(0, "2020-03-31", 4)]))
def c_dates(t: Tables) -> DataFrame:
    return code(t).select("object_id", F.explode(procedures.found(F.col("code"), procedures.dates_of, procedures.DATES)).alias("d")).select("object_id", "d.*")


_ANCHORS = [
    (0, 6, ["ASSIGNMENT"]), (0, 10, ["ASSIGNMENT", "CASE", "WHEN"]), (0, 11, ["ASSIGNMENT", "CASE", "WHEN"]), (0, 12, ["WHEN"]), (0, 14, ["INSERT"]), (0, 15, ["CALCULATION"]), (1, 3, ["MERGE"]), (1, 4, ["CALCULATION"]), (1, 6, ["WHEN"]), (1, 7, ["ASSIGNMENT", "CALCULATION"]), (1, 8, ["WHEN"]), (1, 9, ["INSERT"]), (1, 10, ["DELETE"]),
    (2, 1, ["RETURN"]), (2, 5, ["ASSIGNMENT", "IF"]), (2, 6, ["ELSIF"]), (2, 7, ["ASSIGNMENT", "IF"]), (2, 8, ["ASSIGNMENT", "IF"]), (2, 9, ["RETURN"]), (2, 10, ["EXCEPTION", "RETURN", "WHEN"]), (4, 3, ["IF"]), (4, 4, ["ASSIGNMENT"]), (4, 5, ["IF"]), (4, 9, ["CALCULATION", "INSERT"]), (4, 10, ["ASSIGNMENT"]), (4, 12, ["ASSIGNMENT", "IF"]), (4, 14, ["DELETE"]), (4, 16, ["INSERT"]),
    (5, 3, ["IF"]), (5, 6, ["INSERT"]), (5, 11, ["IF"]), (5, 13, ["RETURN"]), (5, 17, ["ASSIGNMENT"]), (5, 20, ["IF"]),
]


@add(expected("line kinds", _ANCHORS))
def c_anchors(t: Tables) -> DataFrame:
    """Lines that a rule should cite, and why."""
    return code(t).select("object_id", F.explode(procedures.found(F.col("code"), procedures.anchors_of, procedures.ANCHORS)).alias("a")).select("object_id", "a.*")


_SHOWN = [
    (0, 4, "n§N.Accounts.Balance > §K AND NOT EXISTS (SELECT 1 FROM n§N.Closures Z WHERE n§N.Closures.AccountId = n§N.Accounts.AccountId)"), (0, 6, "DaysDue > 90"), (0, 7, "Bucket = 'LATE3'"), (1, 2, "n§N.Totals.CustomerId = CustomerId"), (1, 3, "AccountId IN (SELECT AccountId FROM n§N.Closures, n§N.Extra WHERE Id = §K)"),
    (3, 1, "CustomerId IS NOT NULL"), (4, 2, "Id = §K"),
]


@add(expected("pos predicate", _SHOWN))
def e_rewritten(t: Tables) -> DataFrame:
    """Filters with tables for aliases."""
    # a map an object is too much to broadcast, whatever Spark estimates
    o = checkpointed(operations(t).select("object_id", "dialect", "pos", "op_index", "table_name", "alias", "predicate"))
    first = o.filter("op_index = 0 and predicate <> '' and dialect <> 'ORACLE'").join(relate.alias_maps(o).hint("merge"), "object_id", "left")
    known = F.coalesce("aliases", F.create_map().cast("map<string,string>"))
    return first.select("object_id", "pos", text.rewritten(F.col("predicate"), known).alias("predicate"))
