"""Ordered classifications and small logical spaces, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (dialect, weight, pattern); a signal counts once, however often it occurs.
SIGNALS = [
    ("ORACLE", 3, r"(?m)^\s*/\s*$"),
    ("ORACLE", 3, r"(?i)\bCREATE\s+OR\s+REPLACE\b"),
    ("ORACLE", 2, r"(?i)\bEXCEPTION\s*\n?\s*WHEN\b"),
    ("ORACLE", 2, r"(?i)\bDBMS_[A-Z_]+\b"),
    ("ORACLE", 2, r"(?i)\bEXECUTE\s+IMMEDIATE\b"),
    ("ORACLE", 2, r"(?i)%TYPE\b|%ROWTYPE\b"),
    ("ORACLE", 1, r"(?i)\bVARCHAR2\b|\bNUMBER\s*\("),
    ("ORACLE", 1, r"(?i)\bROWNUM\b"),
    ("ORACLE", 1, r"(?i)\bNVL\s*\("),
    ("ORACLE", 1, r":="),
    ("TSQL", 3, r"(?im)^\s*GO\s*$"),
    ("TSQL", 3, r"(?i)\bBEGIN\s+TRY\b"),
    ("TSQL", 2, r"(?i)\bCREATE\s+(OR\s+ALTER\s+)?PROC(EDURE)?\b"),
    ("TSQL", 2, r"@\w+"),
    ("TSQL", 2, r"(?i)\bSP_EXECUTESQL\b"),
    ("TSQL", 2, r"\[(?:[A-Za-z0-9_ ]+)\]"),
    ("TSQL", 1, r"(?i)\bNVARCHAR\b|\bDATETIME2?\b|\bBIT\b"),
    ("TSQL", 1, r"(?i)\bTOP\s*\(?\s*\d+\)?"),
    ("TSQL", 1, r"(?i)\bISNULL\s*\("),
    ("TSQL", 1, r"(?i)\bIDENTITY\s*\("),
    ("TSQL", 1, r"(?i)\bOUTPUT\b"),
    ("TSQL", 1, r"(?i)@@ROWCOUNT|@@IDENTITY|@@ERROR"),
    ("POSTGRES", 3, r"(?i)\bLANGUAGE\s+PLPGSQL\b"),
    ("POSTGRES", 3, r"(?i)\bDO\s+\$\$"),
    ("POSTGRES", 2, r"(?i)\bON\s+CONFLICT\b"),
    ("POSTGRES", 2, r"(?i)\bRETURNING\b"),
    ("POSTGRES", 2, r"::[A-Za-z_][A-Za-z0-9_]*"),
    ("POSTGRES", 2, r"(?i)\bRAISE\s+NOTICE\b"),
    ("POSTGRES", 2, r"(?i)\bPERFORM\b"),
    ("POSTGRES", 2, r"(?i)\bSERIAL\b"),
    ("POSTGRES", 1, r"(?i)\bILIKE\b"),
]


def scores(text: Column) -> dict[str, Column]:
    out = {}
    for dialect in ("ORACLE", "TSQL", "POSTGRES"):
        total = F.lit(0)
        for name, weight, pattern in SIGNALS:
            if name == dialect:
                total = total + F.when(text.rlike(pattern), weight).otherwise(0)
        out[dialect] = total
    return out


def dialect(oracle: Column, tsql: Column, postgres: Column, hint: Column | None = None) -> Column:
    """Struct (dialect, confidence) by scores; a known hint wins."""
    top, lead = F.greatest(oracle, tsql), F.abs(oracle - tsql)
    winner = F.when(oracle > tsql, "ORACLE").otherwise("TSQL")
    told = F.lit(None).cast("string") if hint is None else F.when(F.upper(F.trim(hint)).isin("ORACLE", "TSQL"), F.upper(F.trim(hint)))
    name = (
        F.when(told.isNotNull(), told)
        .when((postgres >= 3) & (postgres >= top), "UNSUPPORTED")
        .when((oracle == 0) & (tsql == 0), "UNKNOWN")
        .when((oracle > 0) & (tsql > 0) & (lead <= 1), "AMBIGUOUS")
        .when((top >= 3) & (lead >= 2), winner)
        .otherwise("UNKNOWN")
    )
    known = name.isin("ORACLE", "TSQL")
    sure = F.when(told.isNotNull() | (known & (top >= 4)), "high").when(known, "medium").otherwise("low")
    return F.struct(name.alias("dialect"), sure.alias("confidence"))


def dialects(objects: DataFrame, text: str = "text", hint: str | None = None) -> DataFrame:
    found = scores(F.col(text))
    scored = objects.withColumns({f"{k.lower()}_score": v for k, v in found.items()})
    return scored.withColumn("detected", dialect(F.col("oracle_score"), F.col("tsql_score"), F.col("postgres_score"), F.col(hint) if hint else None))


def dialect_name(name: Column) -> Column:
    return F.upper(F.trim(F.coalesce(name, F.lit(""))))


def prompt_set(dialect: Column) -> Column:
    """The prompts of a supported dialect; null for others."""
    return F.when(dialect.isin("ORACLE", "TSQL"), F.lower(dialect))


OBJECTS = [("PROCEDURE", r"PROC(?:EDURE)?"), ("FUNCTION", "FUNCTION"), ("TRIGGER", "TRIGGER"), ("VIEW", "VIEW"), ("PACKAGE", "PACKAGE")]


def object_type(text: Column, filename: Column | None = None) -> Column:
    """The first pattern that fits; else by the name's part before .sql."""
    head = [F.when(text.rlike(rf"(?i)\b(?:CREATE|ALTER)\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?{p}\b"), name) for name, p in OBJECTS]
    named = [] if filename is None else [F.when(filename.rlike(rf"(?i)\.(?:Stored)?{p}\b"), name) for name, p in OBJECTS]
    return F.coalesce(*head, *named, F.when(text.rlike(r"(?i)^\s*(?:DECLARE|BEGIN)\b"), "BLOCK"), F.lit("UNKNOWN"))


def object_name(text: Column) -> Column:
    """Struct (schema, name) of the header, brackets and quotes off."""
    qualified = F.regexp_extract(text, r"(?i)\b(?:CREATE|ALTER)\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:PROC(?:EDURE)?|FUNCTION|TRIGGER|VIEW|PACKAGE(?:\s+BODY)?)\s+([\w\[\]\"$#.]+)", 1)
    parts = F.split(F.translate(qualified, '[]"', ""), r"\.")
    return F.struct(F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("schema"), F.nullif(F.element_at(parts, -1), F.lit("")).alias("name"))


def hardcoded_dates(code: Column) -> Column:
    """Date literals of executable text."""
    return F.regexp_extract_all(code, F.lit(r"'(\d{4}-\d{2}-\d{2}|\d{4}\d{2}\d{2}|\d{1,2}[-/]\w{3}[-/]\d{2,4}|\d{1,2}/\d{1,2}/\d{4})'"), F.lit(1))


def called_procedures(code: Column) -> Column:
    """Static EXEC targets."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?i)\bEXEC(?:UTE)?\s+(?!IMMEDIATE\b|sp_executesql\b)(?:@\w+\s*=\s*)?((?:\[?[A-Za-z_]\w*\]?\.){0,2}\[?[A-Za-z_]\w*\]?)"), F.lit(1)))


def dynamic_sql(code: Column) -> Column:
    return code.rlike(r"(?i)\bEXECUTE\s+IMMEDIATE\b|\bDBMS_SQL\b|\bEXEC(?:UTE)?\s*\(|\bEXEC(?:UTE)?\s+@\w+\s*(?!\s*=)|\bsp_executesql\b")


def decision_points(code: Column) -> Column:
    return F.size(F.regexp_extract_all(code, F.lit(r"(?i)\b(?:IF|ELSIF|ELSEIF|CASE|WHEN|WHILE|MERGE)\b"), F.lit(0)))


#: Text of dynamic statements.
DYNAMIC = r"(?i)\b(?:EXEC(?:UTE)?|SP_EXECUTESQL)\b|\bdynamic\s+sql\b"


def is_working_table(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return low.startswith("#") | low.contains("temp") | low.contains("tmp")


def ledger_status(parse_status: Column, text: Column, operation: Column, table: Column, covered: Column, unsupported: Column | None = None, dynamic: Column | None = None, technical: Column | None = None) -> Column:
    """What became of a construct: the first state that holds.

    Parser metadata goes before evidence; what no rule covers is uncovered
    rather than taken for technical, but for operations on working tables.
    """
    no = F.lit(False)
    known = lambda c: no if c is None else F.coalesce(c, no)
    parse = F.lower(F.coalesce(parse_status, F.lit("")))
    operated = F.coalesce(operation, F.lit("")) != ""
    return (
        F.when(known(unsupported) | parse.contains("unsupported"), "unsupported").when(known(dynamic) | F.coalesce(text, F.lit("")).rlike(DYNAMIC), "dynamic_unresolved")
        .when(parse.contains("failed") | parse.isin("error", "unparsed"), "parser_failed").when(operated & is_working_table(table), "technical_only")
        .when(known(covered), "covered_by_rule").when(known(technical), "technical_only").otherwise("uncovered")
    )


RANK = ("low", "medium", "high")


def higher_confidence(a: Column, b: Column) -> Column:
    """The larger by rank."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, RANK)), x)
    return F.get(F.array(*map(F.lit, RANK)), (F.greatest(rank(a), rank(b)) - 1).cast("int"))


def support_confidence(broken: Column, ambiguities: Column, warnings: Column, direct: Column, embedded: Column) -> Column:
    """How far a chunk's evidence carries.  ``broken``: a parse error, no
    parser, or dynamic SQL."""
    some = direct | embedded
    return F.when(broken | (ambiguities > 0), "low").when(warnings > 0, F.when(some, "medium").otherwise("low")).when(direct, "high").otherwise("low")


def rule_confidence(status: Column, evidence: Column, matched: Column, weak: Column, rule_type: Column, llm_only: Column) -> Column:
    """How far a rule can be trusted.  ``weak``: its parser failed, its support
    is low or ambiguous, or evidence is unresolved."""
    told, kind = F.lower(F.trim(F.coalesce(status, F.lit("")))), F.lower(F.trim(F.coalesce(rule_type, F.lit(""))))
    doubtful = weak | told.isin("parser_failed", "insufficient_evidence", "ambiguous") | (evidence == 0) | llm_only | (kind == "assumption")
    return F.when(doubtful | (matched < 1), "low").when(told == "verified", "high").otherwise("medium")


def contradiction_class(kind: Column, finding: Column, rule: Column, paired: Column) -> Column:
    """Struct (class, review, business): the first explanation that holds.

    ``rule`` and ``paired`` are structs of flags ordered, technical and
    insufficient, null if there is no such rule.
    """
    conflicts = ("rule_vs_rule_conflict", "condition_conflict", "outcome_conflict", "field_conflict", "table_conflict", "operation_conflict")
    flag = lambda c, name: F.coalesce(c[name], F.lit(False))
    label = F.when(kind.isin("tables_read", "tables_written"), "TECHNICAL_PROVENANCE_NOISE")
    for side in (rule, paired):
        label = label.when(flag(side, "ordered"), "VALID_ORDERED_BRANCH").when(flag(side, "technical"), "TECHNICAL_VS_BUSINESS_OVERLAP").when(flag(side, "insufficient"), "INSUFFICIENT_EVIDENCE")
    label = label.when(F.lower(F.trim(finding)).isin(*conflicts), "GENUINE_BUSINESS_CONTRADICTION").otherwise("INSUFFICIENT_EVIDENCE")
    review = label.isin("GENUINE_BUSINESS_CONTRADICTION", "INSUFFICIENT_EVIDENCE")
    return F.struct(label.alias("class"), review.alias("review"))


#: Phrases of the branches of a MERGE, in lower case.
MERGE_TEXT = r"\bmerge\b|target\.|source\.|\bwhen matched\b|\bwhen not matched\b|first(?:flagged|seen|evaluated|reconciled|watched)?date|matched records?|unmatched records?|record exists in\b|record does not exist"
NOT_MATCHED = r"when not matched|not matched by target|(?<![a-z])unmatched records?"
MATCHED = r"when matched(?!\s+by)|update existing|existing records?|record exists in\b|(?<![a-z])matched records?|target\.\w+\s*=\s*(?:source\.\w+|@)"
UNMATCHED = r"when not matched|insert (?:a )?new|insert unmatched|(?<![a-z])unmatched records?|not (currently |previously )?present|does not exist|not matched by target|record does not exist"


def merge_branch(text: Column) -> Column:
    """Struct (merge, matched, unmatched): what a rule's text says of a MERGE."""
    low = F.lower(F.coalesce(text, F.lit("")))
    denied = low.rlike(NOT_MATCHED) & ~low.rlike(r"when matched(?!\s+by)")
    return F.struct(low.rlike(MERGE_TEXT).alias("merge"), (~denied & low.rlike(MATCHED)).alias("matched"), low.rlike(UNMATCHED).alias("unmatched"))


def is_status_update(text: Column) -> Column:
    """Bookkeeping of a process' own run."""
    up = F.upper(F.coalesce(text, F.lit("")))
    return (up.contains("RUNNINGPROCESSSTATUS") | up.contains("RUNNINGPROCESSNAME")) & up.rlike(r"\bUPDATE\b") & up.rlike(r"\b(?:COMPLETED|ERRORDATE|ERRORDESCRIPTION|COUNT)\b\s*=")


def fractional_divisors(text: Column) -> Column:
    """Fields that are set to a number below 1 and divided somewhere."""
    pattern = F.lit(r"(?i)([A-Za-z_][A-Za-z0-9_$#]*)\s*:?=\s*([0-9]+(?:\.[0-9]+)?)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("field"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("value"))
    divided = lambda field: F.rlike(text, F.concat(F.lit(r"(?i)\b\Q"), field, F.lit(r"\E\b\s*/\s*(?:[0-9]+(?:\.[0-9]+)?|[A-Za-z_][A-Za-z0-9_$#]*)\b")))
    return F.transform(F.filter(pairs, lambda p: (p["value"].cast("double") < 1) & divided(p["field"])), lambda p: p["field"])


#: Fixed values: (provider, part of a model's name, most tokens of an answer), the first that fits.
CEILINGS = [
    ("bedrock", "amazon.nova-micro", 5000), ("bedrock", "amazon.nova-lite", 5000), ("bedrock", "amazon.nova-pro", 5000), ("bedrock", "amazon.nova-2-lite", 65536), ("bedrock", "amazon.nova-2-pro", 65536),
    ("bedrock", "anthropic.claude-3-haiku", 4096), ("bedrock", "anthropic.claude-3-5-sonnet", 8192), ("bedrock", "anthropic.claude-3-7-sonnet", 8192),
    ("groq", "openai/gpt-oss-120b", 65536), ("groq", "openai/gpt-oss-20b", 65536), ("groq", "llama-3.3-70b-versatile", 32768), ("groq", "llama-3.1-8b-instant", 8192), ("groq", "qwen", 32768),
]


def output_ceiling(provider: Column, model: Column, otherwise: int = 32768) -> Column:
    """Most tokens of a model's answer; ``otherwise`` for other models of a
    provider whose models all have one, null if nothing is known."""
    who, name = F.lower(F.trim(provider)), F.lower(F.trim(F.coalesce(model, F.lit(""))))
    found = F.when(F.lit(False), 0)
    for owner, part, most in CEILINGS:
        found = found.when((who == owner) & name.contains(part), most)
    return found.when(who == "bedrock", otherwise)


_COMPARISON = r"(?i)^\s*\(*\s*([\w.\[\]@#]+)\s*(<>|!=|>=|<=|=|>|<)\s*(.+?)\s*\)*\s*$"


def comparison(text: Column) -> Column:
    """Struct (left, op, right); null for compound predicates."""
    part = lambda i: F.regexp_extract(text, _COMPARISON, i)
    simple = text.rlike(_COMPARISON) & ~text.rlike(r"(?i)\b(?:AND|OR)\b")
    return F.when(simple, F.struct(part(1).alias("left"), F.when(part(2) == "!=", "<>").otherwise(part(2)).alias("op"), part(3).alias("right")))


def simple_scalar(text: Column) -> Column:
    return F.trim(text).rlike(r"^(?:N?'[^']*'|[-+]?\d+(?:\.\d+)?|\d{4}-\d{2}-\d{2}|\w+)$")


def space(text: Column) -> Column:
    """What a condition admits: (left, kind, lower, upper, with_lower,
    with_upper, values); kind is equal, range, set, negated_set, null,
    not_null, else or opaque."""
    t = F.trim(text)
    between = r"(?i)^([\w.]+)\s+BETWEEN\s+(-?\d+(?:\.\d+)?)\s+AND\s+(-?\d+(?:\.\d+)?)$"
    inside = r"(?i)^([\w.]+)\s+(NOT\s+)?IN\s*\((.*)\)$"
    null = r"(?i)^([\w.]+)\s+IS\s+(NOT\s+)?NULL$"
    compare = r"^([\w.]+)\s*(<>|!=|>=|<=|=|>|<)\s*(.+)$"
    x = lambda p, i: F.regexp_extract(t, p, i)
    number = lambda c: c.try_cast("double")
    op, right = x(compare, 2), x(compare, 3)
    members = F.transform(F.split(x(inside, 3), r"\s*,\s*"), lambda v: F.lower(F.trim(v)))
    bound = number(F.when(t.rlike(compare), right))
    kind = (
        F.when(t.rlike("(?i)^(?:ELSE|OTHERWISE|DEFAULT)$"), "else").when(t.rlike(r"(?i)\b(?:AND|OR)\b") & ~t.rlike(between), "opaque").when(t.rlike(between), "range")
        .when(t.rlike(null), F.when(x(null, 2) == "", "null").otherwise("not_null")).when(t.rlike(inside), F.when(x(inside, 2) == "", "set").otherwise("negated_set"))
        .when(t.rlike(compare) & op.isin("<>", "!="), "negated_set").when(t.rlike(compare) & (op == "="), "equal").when(t.rlike(compare) & bound.isNotNull(), "range").otherwise("opaque")
    )
    left = F.lower(F.coalesce(*(F.nullif(x(p, 1), F.lit("")) for p in (between, inside, null, compare))))
    is_between = t.rlike(between)
    lower = F.when(is_between, number(x(between, 2))).when(op.isin(">", ">="), bound)
    upper = F.when(is_between, number(x(between, 3))).when(op.isin("<", "<="), bound)
    values = F.when(t.rlike(inside), members).when(t.rlike(compare) & op.isin("=", "<>", "!="), F.array(F.lower(F.trim(right)))).otherwise(F.array().cast("array<string>"))
    ranged = kind == "range"
    return F.struct(left.alias("left"), kind.alias("kind"), F.when(ranged, lower).alias("lower"), F.when(ranged, upper).alias("upper"), (ranged & (is_between | (op == ">="))).alias("with_lower"), (ranged & (is_between | (op == "<="))).alias("with_upper"), values.alias("values"))


def spaces_overlap(a: Column, b: Column) -> Column:
    """Whether some value may satisfy both.

    Two half-open ranges that face each other don't overlap here, a range and
    a negated set neither, and a catch-all only overlaps a catch-all.
    """
    same = a["left"] == b["left"]
    points = lambda s: s["kind"].isin("equal", "set")
    two_sided = lambda s: s["lower"].isNotNull() & s["upper"].isNotNull()

    def within(v: Column, s: Column) -> Column:
        n = v.try_cast("double")
        low = s["lower"].isNull() | (n > s["lower"]) | (s["with_lower"] & (n == s["lower"]))
        high = s["upper"].isNull() | (n < s["upper"]) | (s["with_upper"] & (n == s["upper"]))
        return F.coalesce(low & high, F.lit(False))

    meets = lambda s, r: F.exists(s["values"], lambda v: within(v, r))
    touch = lambda hi, lo: (hi["upper"] > lo["lower"]) | ((hi["upper"] == lo["lower"]) & hi["with_upper"] & lo["with_lower"])
    same_side = (a["lower"].isNotNull() & b["lower"].isNotNull() & a["upper"].isNull() & b["upper"].isNull()) | (a["upper"].isNotNull() & b["upper"].isNotNull() & a["lower"].isNull() & b["lower"].isNull())
    some_two = two_sided(a) | two_sided(b)
    ranges = same_side | (some_two & F.coalesce(touch(a, b), F.lit(True)) & F.coalesce(touch(b, a), F.lit(True)))
    overlap = (
        F.when((a["kind"] == "else") | (b["kind"] == "else"), (a["kind"] == "else") & (b["kind"] == "else"))
        .when(~same | a["kind"].isin("opaque") | b["kind"].isin("opaque"), False)
        .when((a["kind"] == "null") | (b["kind"] == "null"), (a["kind"] == "null") & (b["kind"] == "null"))
        .when((a["kind"] == "not_null") | (b["kind"] == "not_null"), True)
        .when(points(a) & points(b), F.arrays_overlap(a["values"], b["values"]))
        .when(points(a) & (b["kind"] == "negated_set"), F.size(F.array_except(a["values"], b["values"])) > 0)
        .when(points(b) & (a["kind"] == "negated_set"), F.size(F.array_except(b["values"], a["values"])) > 0)
        .when((a["kind"] == "negated_set") & (b["kind"] == "negated_set"), True)
        .when(points(a) & (b["kind"] == "range"), meets(a, b))
        .when(points(b) & (a["kind"] == "range"), meets(b, a))
        .when((a["kind"] == "range") & (b["kind"] == "range"), ranges)
        .otherwise(False)
    )
    return F.coalesce(overlap, F.lit(False))


def unreachable(branch: Column, eligibility: Column) -> Column:
    """Branch asks for null where the filter asks for not null."""
    field = F.lower(F.regexp_extract(branch, r"(?i)^\s*([\w.]+)\s+IS\s+NULL\s*$", 1))
    wanted = F.transform(eligibility, lambda e: F.lower(F.regexp_extract(e, r"(?i)([\w.]+)\s+IS\s+NOT\s+NULL", 1)))
    return (field != "") & F.array_contains(wanted, field)


#: Columns of bookkeeping.
BOOKKEEPING = ("errordate", "errordescription", "error_date", "error_description", "runcount", "run_count", "processname", "process_name", "starttime", "start_time", "endtime", "end_time", "completed")


def is_audit_table(name: Column, columns: Column) -> Column:
    """By name, or by two or more of the usual bookkeeping columns."""
    listed = F.lower(F.array_join(F.coalesce(columns, F.array().cast("array<string>")), " "))
    hits = sum((F.when(listed.contains(c), 1).otherwise(0) for c in BOOKKEEPING), F.lit(0))
    return name.rlike(r"(?i)HISTORY|MOVEMENT|AUDIT_LOG|AUDIT_TRAIL|RUNSTATUS|PROCESSMONITOR|PROCESS_MONITOR|JOBLOG|JOB_LOG|ERRORLOG|ERROR_LOG") | (hits >= 2)


#: Phrases for all other rows, and words that say nothing of an outcome.
OTHERWISE = ("else", "otherwise", "default", "all other cases")
FILLERS = r"\b(?:is|are|was|were|becomes?|become|classified|classification|status|field|value)\b"


def told_condition(text: Column) -> Column:
    """Struct (left, op, right) of a condition in SQL or plain words; else null.

    Conditions of days without a field have the left side __implicit__, the
    branches of a MERGE __merge__, all other rows __catch_all__.
    """
    raw = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    plain = F.replace(raw, F.lit("_"), F.lit(" "))
    part = lambda p, i: F.regexp_extract(plain, p, i)
    name = lambda x: F.replace(F.trim(F.translate(x, '[]"`', "")), F.lit(" "), F.lit("_"))
    made = lambda left, op, right: F.struct(left.alias("left"), op.alias("op"), right.alias("right"))
    of = lambda *texts: made(*map(F.lit, texts))
    number, field = r"(\d+(?:\.\d+)?)", r"([a-z0-9 .]+?)"
    c = comparison(raw)
    days_between, days = rf"^{number}\s*(?:to|-)\s*{number}\s+days?\b", rf"^(<=|>=|<|>|more than|over|at most|at least|less than)\s*{number}\s+days?\b"
    word = part(days, 1)
    sign = F.when(word.isin("more than", "over"), ">").when(word == "at least", ">=").when(word == "at most", "<=").when(word == "less than", "<").otherwise(word)
    empty = rf"^{field}\s+(?:is\s+)?(not\s+)?(?:null|missing|empty)$"
    between = rf"{field}\s+(?:is\s+)?between\s+{number}\s+and\s+{number}"
    out = (
        F.when(raw == "", None).when(raw.isin(*OTHERWISE), of("__catch_all__", "", "")).when(raw.isin("source row matches target", "when matched", "matched"), of("__merge__", "matched", ""))
        .when(raw.isin("source row does not match target", "when not matched", "not matched") | raw.contains("non-matching") | raw.contains("not matched"), of("__merge__", "not_matched", ""))
        .when(c.isNotNull(), F.when((c["op"] == "=") & c["left"].contains("target") & c["right"].contains("src"), of("__merge__", "matched", "")).otherwise(made(name(c["left"]), c["op"], c["right"])))
        .when(plain.rlike(days_between), made(F.lit("__implicit__"), F.lit("between"), F.concat(part(days_between, 1), F.lit(".."), part(days_between, 2))))
        .when(plain.rlike(days), made(F.lit("__implicit__"), sign, part(days, 2)))
        .when(plain.rlike(empty), made(name(part(empty, 1)), F.when(part(empty, 2) != "", "isnotnull").otherwise("isnull"), F.lit("null")))
        .when(plain.rlike(between), made(name(part(between, 1)), F.lit("between"), F.concat(part(between, 2), F.lit(".."), part(between, 3))))
    )
    for phrase, op in ((r"(?:greater than|more than|exceeds|over)", ">"), (r"(?:at least|greater than or equal to)", ">="), (r"(?:less than|under)", "<"), (r"(?:at most|less than or equal to)", "<=")):
        p = rf"{field}\s+(?:is\s+)?{phrase}\s+{number}"
        out = out.when(plain.rlike(p), made(name(part(p, 1)), F.lit(op), part(p, 2)))
    return out


def conditions_agree(a: Column, b: Column) -> Column:
    """Whether two ``told_condition`` say the same; null if one says nothing."""
    implicit = (a["left"] == "__implicit__") | (b["left"] == "__implicit__")
    return F.when(a.isNotNull() & b.isNotNull(), (a["op"] == b["op"]) & (a["right"] == b["right"]) & (implicit | (a["left"] == b["left"])))


#: Words that two outcomes needn't share.
OUTCOME_STOP = tuple("a an and are as at by for from if in into is it of on or row rows set sets setting the then to update updates updated with when where this that account record days day value values field fields based upon specified only".split())


def told_outcome(text: Column, stop: Sequence[str] = OUTCOME_STOP) -> Column:
    """Distinct words of an outcome: of the right side of an assignment, without
    fillers; letters that stand alone in capitals count."""
    said = F.trim(F.coalesce(text, F.lit("")))
    right = F.regexp_replace(said, r"^\s*[\w.\[\]@#]+\s*:?=\s*", "")
    raw = F.regexp_replace(F.translate(F.lower(right), "_-", "  "), FILLERS, " ")
    same = lambda w: F.when(w == "pct", "percentage").when(w == "provisioning", "provision").otherwise(w)
    words = F.transform(F.regexp_extract_all(raw, F.lit(r"[a-z][a-z0-9]*|\d+(?:\.\d+)?"), F.lit(0)), same)
    letters = F.transform(F.regexp_extract_all(said, F.lit(r"\b[A-Z]\b"), F.lit(0)), F.lower)
    return F.array_sort(F.array_union(F.filter(words, lambda w: ~w.isin(*stop)), letters))


def outcomes_agree(a: Column, b: Column) -> Column:
    """Whether one of two ``told_outcome`` has all words of the other; null if one is empty."""
    within = lambda x, y: F.size(F.array_except(x, y)) == 0
    return F.when((F.size(a) > 0) & (F.size(b) > 0), within(a, b) | within(b, a))
