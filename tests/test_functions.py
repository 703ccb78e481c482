"""Text, masking, classification and splitting on cases of their own."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import classify, masking, procedures, splitting, sqlops, text, vectors
from marlstone.operators import dml, relate
from marlstone.plans.fixtures import TEMPLATES

CODE = st.lists(st.sampled_from([*"ab'-/*[]\n;() ", "SELECT ", "CASE ", "END ", "GO\n", "UPDATE t SET "]), max_size=60).map("".join)


@given(CODE)
@settings(max_examples=300, deadline=None)
def test_masks_keep_places_and_spans_tile(code):
    hidden = masking.mask(code, identifiers=True)
    assert len(hidden) == len(code) and [i for i, c in enumerate(hidden) if c == "\n"] == [i for i, c in enumerate(code) if c == "\n"]
    spans = splitting.statement_spans(code)
    assert "".join(code[a:b] for a, b in spans) == code


def test_masks_nest():
    assert masking.mask("a /* b /* c */ d */ e 'it''s' -- x\ny") == "a" + " " * 19 + "e" + " " * 13 + "\ny"
    assert "it" in masking.mask("'it' /* x */", strings=False) and "x" not in masking.mask("'it' /* x */", strings=False)


def operations(k):
    code = TEMPLATES[k].replace("§N", "1").replace("§K", "2")
    return [(o["operation"], o["table_name"]) for a, b in splitting.statement_spans(code) for o in sqlops.operations(code[a:b])]


def test_table_operations():
    assert operations(1) == [("MERGE", "n1.Totals"), ("READ", "n1.Accounts"), ("DELETE", "n1.Watch"), ("READ", "n1.Closures"), ("READ", "n1.Extra"), ("TRUNCATE", "n1.Scratch")]
    got = operations(0)
    assert ("UPDATE", "n1.Accounts") in got and ("INSERT", "#Late") in got and ("INSERT", "n1.Watch") in got and ("READ", "n1.Customers") in got and ("READ", "n1.Closures") in got
    assert ("READ", "big") not in operations(3)
    found = lambda code: [(o["operation"], o["table_name"], [(a["column"], a["expression"]) for a in o["assignments"]]) for o in sqlops.operations(code)]
    assert found("INSERT INTO t (a,b) SELECT x, (SELECT y FROM z) FROM w")[0] == ("INSERT", "t", [("a", "x"), ("b", "(SELECT y FROM z)")])
    assert [x[1] for x in found("UPDATE a SET x = 1 WHERE y IN (SELECT q FROM t3, t4)")] == ["a", "t3", "t4"]
    assert [x[1] for x in found('SELECT f(a, b), c FROM "Order Details" d, [dbo].[Other Table] o WHERE g(d.x, o.x) = 1')] == ["Order Details", "dbo.Other Table"]


def test_decisions_have_no_caps():
    assert sqlops.decision_rows("CASE WHEN a > 1 THEN CASE WHEN b = 1 THEN 'x' ELSE 'y' END END") == [("(a > 1) AND (b = 1)", "'x'"), ("a > 1", "'y'"), ("ELSE", "NULL")]
    assert len(sqlops.decision_rows("CASE " + " ".join(f"WHEN a = {i} THEN {i}" for i in range(300)) + " END")) == 301
    deep = "0"
    for i in range(60):
        deep = f"CASE WHEN a = {i} THEN {i} ELSE {deep} END"
    assert len(sqlops.decision_rows(deep)) == 61
    for i in range(400):
        deep = f"CASE WHEN a = {i} THEN {i} ELSE {deep} END"
    rows = sqlops.decision_rows(deep)
    assert len(rows) > 100 and "CASE" in rows[-1][1]


def chains(code):
    return [(r["chain"], r["condition"], r["field"], r["outcome"]) for r in procedures.ladder_rows(code)]


def test_ladders():
    assert chains("IF @a = 1\n UPDATE t SET x = 1\nELSE\n UPDATE t SET x = 2\nUPDATE t SET y = 3") == [(0, "@a = 1", "x", "1"), (0, "ELSE", "x", "2")]
    assert chains("IF @a = 1 BEGIN UPDATE t SET x = 1 END") == []
    assert chains("IF @a = 1 BEGIN UPDATE t SET x = 1 END ELSE BEGIN UPDATE t SET y = 1 END") == []
    assert chains("IF EXISTS (SELECT 1 FROM o WHERE e = @e)\nBEGIN\nSET @r = 0.1\nEND\nELSE\nBEGIN\nSET @r = 0.05\nEND")[0] == (0, "EXISTS (SELECT 1 FROM o WHERE e = @e)", "r", "0.1")
    nested = chains("IF v > 90 THEN g := 'C'; ELSIF v > 30 THEN IF p = 1 THEN g := 'B1'; ELSE g := 'B2'; END IF; ELSE g := 'A'; END IF;")
    assert nested == [(0, "v > 90", "g", "'C'"), (0, "ELSE", "g", "'A'"), (1, "p = 1", "g", "'B1'"), (1, "ELSE", "g", "'B2'")]
    cased = chains("IF @a=1\nBEGIN\nUPDATE t SET x = CASE WHEN b > 1 THEN 2\n ELSE 3\nEND\nWHERE z = 1\nEND\nELSE UPDATE t SET x = 9")
    assert cased == [(0, "@a=1", "x", procedures.NESTED_CASE), (0, "ELSE", "x", "9")]
    inserted = chains("IF @e = 1\nBEGIN\nINSERT INTO q (a, b) VALUES (@x, DATEADD(DAY, 1, @p))\nEND\nELSE\nBEGIN\nINSERT INTO q (a, b) VALUES (@x, @p)\nEND")
    assert (0, "@e = 1", "b", "DATEADD(DAY, 1, @p)") in inserted and len(inserted) == 4


def test_inactive_code():
    code = "SELECT 1\n/* UPDATE t SET x = 1;\n more */\n-- a note on updates\n\n-- DELETE FROM a.b\n-- WHERE x >= 1\nSELECT 2"
    found = [code[a:b] for a, b in splitting.inactive_spans(code)]
    assert found == ["/* UPDATE t SET x = 1;\n more */", "-- DELETE FROM a.b\n-- WHERE x >= 1"]
    left = splitting.without_inactive(code)
    assert len(left) == len(code) and left.count("\n") == code.count("\n") and "DELETE" not in left and "a note on updates" in left


def test_locks_are_operations():
    assert [(o["operation"], o["table_name"]) for o in sqlops.operations("SELECT a FROM t WHERE b = 1 FOR UPDATE", "ORACLE")] == [("READ", "t"), ("LOCK", "t")]


def test_paths_of_aliases(spark):
    maps = F.create_map(F.lit("A"), F.lit("dbo.Accounts"), F.lit("ACCOUNTS"), F.lit("dbo.Accounts"))
    shown = spark.range(1).select(text.rewritten(F.lit("A.x = B.y and Source.z > #T.w and dbo.Accounts.v = Accounts.u"), maps)).first()[0]
    assert shown == "dbo.Accounts.x = y and z > #T.w and dbo.Accounts.v = Accounts.u"


def test_parameters():
    found = procedures.parameters_of("CREATE PROCEDURE p @a INT, @b AS VARCHAR(20) = 'x,y' OUTPUT, @c DECIMAL(18, 2) = 1.5 with recompile\nAS\nBEGIN RETURN END")
    assert [tuple(p.values()) for p in found["parameters"]] == [("a", "IN", "INT", None), ("b", "OUT", "VARCHAR(20)", "'x,y'"), ("c", "IN", "DECIMAL(18,2)", "1.5")]
    found = procedures.parameters_of("CREATE OR REPLACE PROCEDURE c (p_id IN NUMBER, p_s OUT VARCHAR2, p_x IN OUT DATE, p_y NUMBER := 3) IS BEGIN NULL; END;")
    assert [p["direction"] for p in found["parameters"]] == ["IN", "OUT", "IN OUT", "IN"] and found["parameters"][3]["initial"] == "3"
    assert procedures.parameters_of("CREATE PROCEDURE z AS SELECT (1)")["status"] == "parameterless" and procedures.parameters_of("CREATE PROCEDURE b @x AS\nBEGIN\nSELECT 1 END")["status"] == "failed"


def test_gates_are_of_run_states_only():
    assert procedures.gates_of("IF @Flag = 'Y'\n UPDATE t SET x = 1\nELSE\n UPDATE t SET x = 0") == []
    guard = "IF (SELECT Done FROM dbo.JobControl WHERE Step='A')='N'\nBEGIN\nIF (SELECT Done FROM dbo.JobControl WHERE Step='B')='N'\nBEGIN RETURN END\nEND"
    assert [(g["gate_type"], g["step"]) for g in procedures.gates_of(guard)] == [("abort_if_incomplete", "A")]


def test_a_name_of_many_parentheses_and_long_alias_chains(spark):
    one = spark.createDataFrame([("(" * 9 + "a = 1" + ")" * 9,)], "f string")
    assert one.select(text.fragment(F.col("f"))).first()[0] == "a = 1"
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)], "name int, target int")
    assert relate.alias_closure(pairs).count() == 30 * 31 // 2


def test_spaces(spark):
    pairs = [("x > 5", "x < 10", False), ("x >= 5", "x > 9", True), ("x BETWEEN 1 AND 5", "x >= 5", True), ("x BETWEEN 1 AND 5", "x > 5", False), ("x = 3", "x IN (1, 3)", True), ("x = 3", "x <> 3", False), ("ELSE", "x = 1", False), ("ELSE", "ELSE", True), ("x IS NULL", "x = 1", False), ("x = 1", "y = 1", False), ("x > 1 AND y > 2", "x > 1", False), ("x > 1", "x NOT IN (5)", False)]
    frame = spark.createDataFrame(pairs, "a string, b string, e boolean")
    got = frame.select("a", "b", "e", classify.spaces_overlap(classify.space(F.col("a")), classify.space(F.col("b"))).alias("g")).collect()
    assert [(r["a"], r["b"]) for r in got if r["e"] != r["g"]] == []


def test_text(spark):
    one = spark.createDataFrame([("((a + b) * (c)) ;", "dbo.[T].Col", "ab.Field", "pro.Loans_20240131_v2")], "f string, n string, c string, b string")
    got = one.select(text.fragment(F.col("f")), text.bare_field(F.col("n")), text.column_reference(F.col("c")), text.business_name(F.col("b")), text.fragment(F.lit("(a) + (b)")), text.shortened(F.lit("a  b c d e f g h i"), 9)).first()
    assert tuple(got) == ("(a + b) * (c)", "col", "Field", "pro.Loans", "(a) + (b)", "a b c...")


def test_embedding_is_of_unit_length():
    v = vectors.embed("Some words, some more")
    assert len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-12 and not any(vectors.embed(""))


def test_embedding_equals_brute_force(spark):
    import hashlib
    import re

    texts = ["", "One word", "the dog, the dog and THE dog_1", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(vectors.embedded(F.col("t"))).collect()]
    for text_, vector in zip(texts, got):
        words = re.findall(r"[A-Za-z0-9_]+", (text_ or "").lower())
        expected = [0.0] * 384
        for i, word in enumerate(words):
            for token, weight in ((word, 1 + len(word) / 10), *(((f"{word}:{words[i + 1]}", 0.5),) if i + 1 < len(words) else ())):
                expected[int(hashlib.blake2b(token.encode(), digest_size=16).hexdigest()[:8], 16) % 384] += weight
        norm = sum(x * x for x in expected) ** 0.5 or 1.0
        assert max(abs(a - b / norm) for a, b in zip(vector, expected)) < 1e-12


def test_history_is_idempotent(spark):
    history = spark.createDataFrame([(1, "a", 1, 49999), (2, "b", 1, 49999)], "k int, v string, valid_from int, valid_to int")
    incoming = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "k int, v string")
    once = dml.scd2(history, incoming, "k", ["v"], 5)
    assert sorted(map(tuple, once.collect()), key=str) == sorted([(1, "a", 1, 49999), (2, "b", 1, 4), (2, "c", 5, 49999), (3, None, 5, 49999)], key=str)
    assert sorted(map(tuple, dml.scd2(once, incoming, "k", ["v"], 6).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_overlap_join_takes_each_pair_once(spark):
    left = spark.createDataFrame([(1, 0, 100, "a"), (1, 5, 5, "empty"), (1, None, 9, "n")], "k int, start int, end int, l string")
    right = spark.createDataFrame([(1, 50, 200, "x"), (1, 100, 120, "y"), (2, 0, 9, "z")], "k int, r_start int, r_end int, r string")
    assert [(r["l"], r["r"]) for r in relate.overlap_join(left, right, ["k"], 7).collect()] == [("a", "x")]


def test_one_to_one_is_greedy(spark):
    schema = "o string, section string, pos long, t string, op string"
    claims = spark.createDataFrame([("o", "w", 1, "A", "U"), ("o", "w", 2, "A", "U"), ("o", "r", 1, "A", "R"), ("o", "w", 3, "B", "I")], schema)
    facts = spark.createDataFrame([("o", "w", 7, "A", "U"), ("o", "w", 8, "A", "D"), ("o", "r", 7, "A", "R"), ("o", "w", 9, "C", "I")], schema)
    got = relate.one_to_one(claims, facts, "o", [("MATCHED", ["t", "op"]), ("CONFLICT", ["t"])]).collect()
    found = {(r["section"], r["claim"], r["fact"], r["status"]) for r in got}
    assert found == {("w", 1, 7, "MATCHED"), ("w", 2, 8, "CONFLICT"), ("r", 1, 7, "MATCHED"), ("w", 3, None, "LLM_ONLY"), ("w", None, 9, "DETERMINISTIC_ONLY")}
