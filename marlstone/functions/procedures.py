"""Procedures taken apart: IF ladders, parameters, run gates.

A reader over the tokens of masked text follows blocks, conditions and
statements of T-SQL and PL/SQL; what it doesn't know is a plain statement.
Everything runs in Arrow UDFs, one object a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.arrow import mapped
from marlstone.functions.masking import mask
from marlstone.functions.splitting import comma_spans
from marlstone.functions.sqlops import bare, operations

_WORDS = "IF ELSE ELSIF ELSEIF THEN BEGIN END CASE WHILE LOOP FOR EXCEPTION SELECT INSERT UPDATE DELETE MERGE TRUNCATE SET EXEC EXECUTE RETURN PRINT RAISERROR RAISE DECLARE FETCH OPEN CLOSE COMMIT ROLLBACK WITH DROP CREATE WHEN".split()
_TOKEN = re.compile(rf"(?i)\b(?:{'|'.join(_WORDS)})\b|[();]|:=")
_STARTS = frozenset("SELECT INSERT UPDATE DELETE MERGE TRUNCATE SET EXEC EXECUTE RETURN PRINT RAISERROR RAISE DECLARE FETCH OPEN CLOSE COMMIT ROLLBACK WITH DROP CREATE IF BEGIN WHILE".split())
#: Words that go on with a statement of a kind instead of starting one, the first time.
_GOES_ON = {"UPDATE": {"SET"}, "INSERT": {"SELECT", "EXEC", "EXECUTE", "WITH"}, "WITH": {"SELECT", "INSERT", "UPDATE", "DELETE", "MERGE"}, "FOR": {"SELECT"}, "DECLARE": {"SELECT", "SET"}, "CREATE": {"SELECT", "UPDATE", "INSERT"}, "OPEN": {"SELECT"}}
NESTED_CASE = "(nested CASE — see separate decision table)"


class Reader:
    """Ladders and plain statements of one text, in order."""

    def __init__(self, code: str) -> None:
        self.code, self.hidden = code, mask(code, identifiers=True)
        self.tokens = [(m.group().upper(), m.start(), m.end()) for m in _TOKEN.finditer(self.hidden)]
        self.ladders: list[dict] = []
        self.plain: list[tuple[int, int]] = []
        i = 0
        while i < len(self.tokens):
            i = max(self.statement(i, self.tokens[i][1] if not i else self.tokens[i - 1][2])[0], i + 1)

    def word(self, i: int) -> str:
        return self.tokens[i][0] if i < len(self.tokens) else ""

    def at(self, i: int) -> int:
        return self.tokens[i][1] if i < len(self.tokens) else len(self.code)

    def closed(self, i: int) -> int:
        """After the parenthesis or CASE that token i opens."""
        opened, closing = ("(", ")") if self.word(i) == "(" else ("CASE", "END")
        depth = 0
        while i < len(self.tokens):
            if self.word(i) == opened:
                depth += 1
            elif self.word(i) == closing:
                depth -= 1
                if not depth:
                    return i + 1
            i += 1
        return i

    def ends_line(self, a: int, b: int) -> bool:
        return "\n" in self.code[a:b]

    def statement(self, i: int, start: int) -> tuple[int, int]:
        """The token after the statement at token i, and where it ends."""
        word = self.word(i)
        if word == "IF":
            return self.ladder(i)
        if word == "BEGIN" and not re.match(r"(?i)\s+TRAN", self.hidden[self.tokens[i][2] :][:12]):
            return self.block(i + 1)
        if word in ("WHILE", "LOOP"):
            if word == "WHILE":
                i = self.condition(i + 1)[0]
                if self.word(i) not in ("LOOP", "BEGIN"):
                    return self.statement(i, self.at(i))
            return self.block(i + 1)
        if word in ("END", "ELSE", "ELSIF", "ELSEIF", "THEN", ";", ")", "EXCEPTION"):
            return i + 1, self.tokens[i][2]
        return self.simple(i, start)

    def block(self, i: int) -> tuple[int, int]:
        """Statements up to the END of a block, with what follows the END."""
        last = self.tokens[i - 1][2]
        while i < len(self.tokens):
            if self.word(i) == "END":
                end = self.tokens[i][2]
                if self.word(i + 1) in ("IF", "LOOP", "CASE") and not self.ends_line(end, self.at(i + 1)):
                    i, end = i + 1, self.tokens[i + 1][2]
                if self.word(i + 1) == ";" and not self.code[end : self.at(i + 1)].strip(" \tTRYCATHtrycath"):
                    i, end = i + 1, self.tokens[i + 1][2]
                return i + 1, end
            i, last = self.statement(i, last)
        return i, len(self.code)

    def simple(self, i: int, start: int) -> tuple[int, int]:
        kind, i = self.word(i), i if self.word(i) in (":=", "(", "CASE") else i + 1
        allowed, before = set(_GOES_ON.get(kind, ())), ""
        while i < len(self.tokens):
            word = self.word(i)
            if word in ("(", "CASE"):
                i = self.closed(i)
                before = word
                continue
            if word == ";":
                self.plain.append((start, self.tokens[i][1]))
                return i + 1, self.tokens[i][2]
            if word in ("END", "ELSE", "ELSIF", "ELSEIF", "EXCEPTION") and not (kind == "MERGE" and before == "THEN"):
                break
            if word in _STARTS:
                if word in allowed:
                    allowed = set() if kind != "WITH" else _GOES_ON.get(word, set())
                    kind = word if kind == "WITH" else kind
                elif not (kind == "MERGE" and (before == "THEN" or word == "SET")) and not (word == "WITH" and not self.ends_line(self.tokens[i - 1][2] if i else 0, self.at(i))) and not (word == "SELECT" and re.search(r"(?i)\b(?:UNION(?:\s+ALL)?|EXCEPT|INTERSECT)\s*$", self.hidden[start : self.at(i)])) and not (word == "SET" and kind == "UPDATE"):
                    break
            before = word
            i += 1
        self.plain.append((start, self.at(i)))
        return i, self.at(i)

    def condition(self, i: int) -> tuple[int, int]:
        """The token that ends a condition: THEN, or the statement after it."""
        while i < len(self.tokens) and self.word(i) != "THEN" and self.word(i) not in _STARTS and self.word(i) not in (";", "LOOP"):
            i = self.closed(i) if self.word(i) in ("(", "CASE") else i + 1
        return i, self.at(i)

    def ladder(self, i: int) -> tuple[int, int]:
        found: dict = {"start": self.at(i), "branches": []}
        self.ladders.append(found)
        oracle, end = None, self.at(i)
        while True:
            word = self.word(i)
            condition = "ELSE"
            if word != "ELSE" or (not oracle and self.word(i + 1) == "IF" and not self.code[self.tokens[i][2] : self.at(i + 1)].strip()):
                i += 1 + (word == "ELSE")
                after, stop = self.condition(i)
                condition = " ".join(self.code[self.tokens[i - 1][2] : stop].split())
                i, begin = after, stop
                oracle = self.word(i) == "THEN" if oracle is None else oracle
                if oracle:
                    i, begin = i + 1, stop + len("THEN")
            else:
                i, begin = i + 1, self.tokens[i][2]
            seen, statements = len(self.ladders), len(self.plain)
            if oracle:
                last = begin
                while i < len(self.tokens) and self.word(i) not in ("ELSE", "ELSIF", "ELSEIF", "END"):
                    i, last = self.statement(i, last)
                end = self.at(i)
            else:
                i, end = self.statement(i, begin) if i < len(self.tokens) else (i, len(self.code))
            nested = len(self.ladders) > seen
            found["branches"].append({"condition": condition, "start": begin, "end": end, "nested": nested, "plain": self.plain[statements:]})
            if oracle and self.word(i) == "END":
                i, end = self.block(i)
                break
            if not (self.word(i) == "ELSE" or oracle and self.word(i) in ("ELSIF", "ELSEIF")) or condition == "ELSE":
                break
        found["end"] = end
        return i, end


def _assigned(code: str) -> tuple[list[tuple[str, str]], str]:
    """(field, value) pairs of one statement, and the filter of its write."""
    text = code.strip()
    plain = re.match(r"(?is)^\s*(?:SET\s+)?(@?[\w.]+)\s*:?=\s*(.+?)\s*;?\s*$", text)
    if plain and not re.match(r"(?i)\s*(?:UPDATE|SELECT)\b", text):
        return [(plain[1], plain[2])], ""
    for row in operations(text):
        if row["operation"] in ("UPDATE", "MERGE", "INSERT"):
            return [(a["column"].split(".")[-1], a["expression"]) for a in row["assignments"]], row["predicate"]
    return [], ""


LADDER = "array<struct<chain:int,branch:int,condition:string,effective:string,row_filter:string,field:string,outcome:string,line_start:int,line_end:int>>"


def ladder_rows(code: str) -> list[dict]:
    """Assignments of ladders in which some field is set in two branches.

    A ladder within a branch is one of its own; the branch around it has no
    assignments, as its condition alone doesn't decide them.
    """
    out: list[dict] = []
    line = lambda at: code.count("\n", 0, max(at, 0)) + 1
    chain = 0
    for found in sorted(Reader(code).ladders, key=lambda x: x["start"]):
        rows, often, above = [], {}, []
        for n, branch in enumerate(found["branches"]):
            denied = " AND ".join(f"NOT ({c})" for c in above)
            effective = branch["condition"] if branch["condition"] != "ELSE" else denied or "ELSE"
            above.append(branch["condition"])
            own = [] if branch["nested"] else [_assigned(code[a:b]) for a, b in branch["plain"]]
            for fields, where in own:
                for field, value in fields:
                    shown = NESTED_CASE if re.search(r"(?i)\bCASE\b", mask(value)) else value.strip().rstrip(";").strip()
                    rows.append({"branch": n, "condition": branch["condition"], "effective": effective, "row_filter": where, "field": field.lstrip("@"), "outcome": shown})
            for field in {f.lstrip("@").casefold() for fields, _ in own for f, _ in fields}:
                often[field] = often.get(field, 0) + 1
        if len(found["branches"]) > 1 and max(often.values(), default=0) > 1:
            end = max(found["branches"][-1]["end"] - 1, found["start"])
            while end > found["start"] and code[end].isspace():
                end -= 1
            out += [{"chain": chain, **row, "line_start": line(found["start"]), "line_end": line(end)} for row in rows]
            chain += 1
    return out


def ladders(code: Column) -> Column:
    return mapped(lambda t: ladder_rows(t or ""), LADDER, code)


PARAMETERS = "struct<status:string,parameters:array<struct<name:string,direction:string,datatype:string,initial:string>>>"
_HEAD = re.compile(r"(?i)\b(?:PROC(?:EDURE)?|FUNCTION)\s+((?:\[[^\]]+\]|\"[^\"]+\"|[\w$#]+)(?:\s*\.\s*(?:\[[^\]]+\]|\"[^\"]+\"|[\w$#]+))*)")
_OPTION = re.compile(r"(?i)\b(?:WITH\s+(?:RECOMPILE|ENCRYPTION|SCHEMABINDING|NATIVE_COMPILATION|EXECUTE\s+AS)|EXECUTE\s+AS|FOR\s+REPLICATION|(?:RETURNS|CALLED)\s+(?:NULL\s+)?ON\s+NULL\s+INPUT|RETURNS\b)")
_TSQL_PARAMETER = re.compile(r"(?is)^\s*@([\w$#]+)\s+(?:AS\s+)?([\w.\[\]]+(?:\s*\([^)]*\))?)\s*(?:=\s*(.+?))?\s*(\b(?:OUTPUT|OUT|READONLY)\b)?\s*$")
_ORACLE_PARAMETER = re.compile(r"(?is)^\s*([\w$#]+)\s+(?:(IN\s+OUT|IN|OUT)\s+)?(?:NOCOPY\s+)?([\w.%$#]+(?:\s*\([^)]*\))?)\s*(?:(?::=|DEFAULT\b)\s*(.+?))?\s*$")


def parameters_of(code: str) -> dict:
    """Formal parameters of a procedure's or function's header.

    The status is parameterized, parameterless, or failed where a header has
    parameters that can't be read.
    """
    shown, hidden = mask(code, strings=False), mask(code)
    head = _HEAD.search(hidden)
    out: list[dict] = []
    if head is None:
        return {"status": "parameterless", "parameters": out}
    rest, told = hidden[head.end() :], shown[head.end() :]
    listed = re.match(r"\s*\(", rest)
    opens = re.search(r"(?im)^[ \t]*AS[ \t]*$", rest) or re.search(r"(?i)\bAS\b(?!\s+[\w.\[\]]+\s*(?:\([^)]*\))?\s*(?:=|,|OUT\b|OUTPUT\b|@|$))", rest) or re.search(r"(?i)\bAS\b", rest)
    if "@" in rest[: opens.start() if opens else len(rest)]:
        end = opens.start() if opens else len(rest)
        option = _OPTION.search(rest[:end])
        block = told[: option.start() if option else end].strip()
        if block.startswith("(") and block.endswith(")"):
            block = block[1:-1]
        pattern, way = _TSQL_PARAMETER, lambda m: ("OUT" if m[4] and m[4].upper() in ("OUT", "OUTPUT") else "IN", m[1], m[2], m[3])
    elif listed:
        depth = 0
        for end, c in enumerate(rest):
            depth += (c == "(") - (c == ")")
            if c == ")" and not depth:
                break
        block = told[listed.end() : end]
        pattern, way = _ORACLE_PARAMETER, lambda m: (" ".join((m[2] or "IN").upper().split()), m[1], m[3], m[4])
    else:
        return {"status": "parameterless", "parameters": out}
    parts = [block[a:b].strip() for a, b in comma_spans(block)]
    for part in filter(None, parts):
        got = pattern.match(part)
        if got is None:
            return {"status": "failed", "parameters": []}
        direction, name, datatype, initial = way(got)
        out.append({"name": name, "direction": direction, "datatype": re.sub(r"\s+", "", datatype).upper(), "initial": initial})
    return {"status": "parameterized" if out else "parameterless", "parameters": out}


def parameters(code: Column) -> Column:
    return mapped(lambda t: parameters_of(t or ""), PARAMETERS, code)


GATES = "array<struct<sequence:int,gate_type:string,step:string,precondition:string,procedures:array<string>,aborts:boolean,status_table:string,line:int,resumes:boolean>>"
#: Parts of the names of tables that hold the state of runs, and what done and open look like.
_STATE_TABLE = re.compile(r"(?i)RunningProcess|ProcessStatus|RunStatus|BatchStatus|JobStatus|JobControl|ProcessControl|RunControl|Checkpoint")
_DONE, _OPEN = {"Y", "YES", "1", "TRUE", "C", "COMPLETE", "COMPLETED"}, {"N", "NO", "0", "FALSE"}
_TERM = re.compile(r"(?is)\(\s*SELECT\s+[\w\[\]]+\s+FROM\s+([\w.\[\]]+)\s+WHERE\s+[\w\[\]]+\s*=\s*'([^']+)'\s*\)\s*(=|<>|!=)\s*'([^']*)'")


def gates_of(code: str) -> list[dict]:
    """Guarded steps of a run, in order: IFs that read the state of a run.

    A guard inside a step that is told already is no step of its own.
    """
    out: list[dict] = []
    shown = mask(code, strings=False)
    reader, until = Reader(shown), -1
    for found in sorted(reader.ladders, key=lambda x: x["start"]):
        first = found["branches"][0]
        if found["start"] < until:
            continue
        terms = [(bare(m[1]), m[2].strip(), m[3], m[4].strip()) for m in _TERM.finditer(shown[found["start"] : first["start"]]) if _STATE_TABLE.search(m[1])]
        if not terms:
            continue
        body = shown[first["start"] : first["end"]]
        called = [bare(m[1]) for m in re.finditer(r"(?i)\bEXEC(?:UTE)?\s+((?:\[?\w+\]?\.)*\[?\w+\]?)", mask(body))]
        called = list({c.lower(): c for c in reversed(called) if not c.lower().startswith("sp_")}.values())[::-1]
        aborts = not called and bool(re.search(r"(?i)\bRETURN\b", mask(body)))
        logged = re.search(r"'([A-Za-z_]\w*)'\s*,\s*'RUNNING'", body, re.I)
        pending = [t for t in terms if t[3].upper() in _OPEN]
        step = called[0].split(".")[-1] if called else logged[1] if logged else (pending or terms)[-1][1]
        said = []
        for _, name, op, value in terms:
            done = (value.upper() in _DONE) == (op == "=")
            own = name.lower() == step.lower()
            said.append(f"'{name}' has {'already ' if own and done else '' if done else 'not yet ' if own else 'not '}completed")
        until = max(until, first["end"])
        out.append({
            "sequence": len(out) + 1, "gate_type": "abort_if_incomplete" if aborts else "run_step" if called else "guarded_block", "step": step, "precondition": " and ".join(said), "procedures": called, "aborts": aborts,
            "status_table": terms[0][0], "line": shown.count("\n", 0, found["start"]) + 1, "resumes": bool(called) and any(t[3].upper() in _OPEN and t[1].lower() == step.lower() for t in terms),
        })
    return out


def gates(code: Column) -> Column:
    return mapped(lambda t: gates_of(t or ""), GATES, code, once=True)


def gate_summary(found: Column) -> Column:
    """Struct of an object's gates: how many, steps in order, aborts, whether a
    run resumes, tables of state; null without gates."""
    runs = F.filter(found, lambda g: g["gate_type"] == "run_step")
    names = F.transform(runs, lambda g: g["step"])
    first = F.filter(names, lambda n, i: ~F.exists(F.slice(names, F.lit(1), i), lambda m: F.lower(m) == F.lower(n)))
    return F.when(F.size(found) > 0, F.struct(
        F.size(found).alias("total"), F.size(first).alias("steps"), first.alias("execution_order"), F.size(F.filter(found, lambda g: g["aborts"])).alias("aborting"), F.exists(runs, lambda g: g["resumes"]).alias("resumable"),
        F.array_sort(F.array_distinct(F.transform(found, lambda g: g["status_table"]))).alias("status_tables"),
    ))


CALLS = "array<struct<name:string,arguments:string,returned:string,line:int>>"
_CALL = re.compile(r"(?i)\bEXEC(?:UTE)?\s+(?:(@\w+)\s*=\s*)?((?:\[[^\]]+\]|[A-Za-z_]\w*)(?:\s*\.\s*(?:\[[^\]]+\]|[A-Za-z_]\w*))*)(?:\s+|$)([^\n\r;]*)")


def calls_of(code: str) -> list[dict]:
    """Procedures that are called by name, in order, with their arguments.

    What is run from a variable or a text has no name to list.
    """
    hidden, shown = mask(code), mask(code, strings=False)
    out = []
    for got in _CALL.finditer(hidden):
        name = re.sub(r"\s+", "", got[2])
        if bare(name).upper() in ("SP_EXECUTESQL", "IMMEDIATE", "AS"):
            continue
        out.append({"name": name, "arguments": shown[got.start(3) : got.end(3)].strip().rstrip(",").strip(), "returned": got[1], "line": code.count("\n", 0, got.start()) + 1})
    return out


DATES = "array<struct<value:string,line:int>>"
#: How dates are written.
_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-[A-Za-z]{3}-\d{2,4}")


def dates_of(code: str) -> list[dict]:
    """Date literals of live code, in order."""
    shown = mask(code, strings=False)
    literals = ((m.start(), m[1].strip()) for m in re.finditer(r"'((?:[^']|'')*)'", shown))
    return [{"value": value, "line": code.count("\n", 0, at) + 1} for at, value in literals if _DATE.fullmatch(value)]


ANCHORS = "array<struct<line:int,kinds:array<string>>>"
#: What makes a line worth citing.
_DECIDES = re.compile(r"(?i)\b(?:CASE|WHEN|IF|ELSIF|ELSEIF|WHILE|LOOP|EXCEPTION|RAISE|RETURN)\b")
_CALCULATES = re.compile(r"(?i)\b(?:SUM|AVG|MIN|MAX|COUNT|ROUND|ABS|COALESCE|GREATEST)\s*\(|\b[A-Za-z_]\w*\s*[+*/%]\s*[A-Za-z_]\w*\b")
_WRITES = re.compile(r"(?i)(?:^|;)\s*(UPDATE|INSERT|DELETE|MERGE)\b")
_CLAUSE_ENDS = re.compile(r"(?i)\b(?:WHERE|FROM|ON|GROUP|ORDER|HAVING|RETURNING)\b")


def anchors_of(code: str) -> list[dict]:
    """Lines that a rule should cite: decisions, writes, assignments, formulas.

    An equals sign assigns in a SET clause only; an assignment stands for the
    write that it is on the line with.
    """
    out, clause = [], ""
    for number, line in enumerate(mask(code).splitlines(), 1):
        kinds = {m[0].upper() for m in _DECIDES.finditer(line)}
        writes = {m[1].upper() for m in _WRITES.finditer(line)}
        if writes:
            clause = ""
        if re.search(r"(?i)\bSELECT\b", line):
            clause = "SELECT" if not re.search(r"(?i)\bFROM\b", line) else ""
        elif clause == "SELECT" and re.search(r"(?i)\bFROM\b", line):
            clause = ""
        in_set = clause == "SET" or bool(re.search(r"(?i)\bSET\b", line))
        ends = _CLAUSE_ENDS.search(line)
        head = line[: ends.start()] if ends else line
        assigns = clause != "SELECT" and ":=" in head or in_set and re.search(r"\b[A-Za-z_]\w*\b\s*=", head)
        if clause != "SELECT":
            clause = "SET" if in_set and not ends else ""
        if line.rstrip().endswith("=") and "UPDATE" in writes:
            assigns, writes = False, writes - {"UPDATE"}
        kinds |= (writes - {"UPDATE", "INSERT"} | {"ASSIGNMENT"}) if assigns else writes
        if _CALCULATES.search(line):
            kinds.add("CALCULATION")
        if kinds:
            out.append({"line": number, "kinds": sorted(kinds)})
    return out


def found(code: Column, of, kind: str) -> Column:
    """``calls_of``, ``dates_of`` or ``anchors_of`` each text."""
    return mapped(lambda t: of(t or ""), kind, code)
