"""Splitting code and text: statements, batches, sections, chunks.

Splitters that need state are Arrow UDFs over one text; packing of sections is
a fold (``aggregate``) over the ordered pieces of one object.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.arrow import mapped, streamed
from marlstone.functions.masking import mask

SPAN = "array<struct<start:int,end:int>>"
_STARTS = re.compile(r"(?i)(SELECT|INSERT|UPDATE|DELETE|MERGE|TRUNCATE|WITH|DECLARE|EXEC(?:UTE)?|CREATE|ALTER|DROP|IF|ELSE|ELSIF|WHILE|BEGIN|END|SET|RETURN|PRINT|RAISERROR|COMMIT|ROLLBACK|FETCH|OPEN|CLOSE|USE|GO)\b")
_GO = re.compile(r"(?im)^[ \t]*GO[ \t]*$")
_CASE = re.compile(r"(?i)\b(CASE|END)\b")


def statement_spans(code: str) -> list[tuple[int, int]]:
    """Spans that tile the text, a statement each.

    A statement ends at a semicolon, or before a line that starts with a
    statement's keyword, outside parentheses and CASE.  SET continues an
    UPDATE or MERGE, SELECT an INSERT, a CTE or a set operation, and INSERT,
    UPDATE and DELETE a MERGE's branch.
    """
    hidden = mask(code, identifiers=True)
    cuts, depth, case, open_kind, last = [0], 0, 0, "", ""
    at = 0
    for line in hidden.splitlines(keepends=True):
        head = line.lstrip()
        got = _STARTS.match(head)
        word = got[1].upper() if got else ""
        previous = last.rstrip()
        continues = (
            depth > 0 or case > 0 or not open_kind
            or (word == "SET" and open_kind in ("UPDATE", "MERGE"))
            or (word in ("SELECT", "WITH", "EXEC", "EXECUTE") and open_kind == "INSERT" and not re.search(r"(?i)\bSELECT\b|\bVALUES\b", hidden[cuts[-1] : at]))
            or (word == "SELECT" and re.search(r"(?i)(?:\bUNION(?:\s+ALL)?|\bEXCEPT|\bINTERSECT|\bAS|\))$", previous) and (open_kind == "WITH" or not previous.endswith((")", "AS", "as"))))
            or (word in ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE") and open_kind == "WITH" and previous.endswith(")"))
            or (word in ("INSERT", "UPDATE", "DELETE") and open_kind == "MERGE" and re.search(r"(?i)\bTHEN$", previous))
            or (word == "END" and previous.upper().endswith(("THEN", "ELSE")))
        )
        if word and not continues and at > cuts[-1] and hidden[cuts[-1] : at].strip():
            cuts.append(at)
            open_kind = word
        elif word and not open_kind:
            open_kind = word
        for k, c in enumerate(line):
            if c == "(":
                depth += 1
            elif c == ")":
                depth = max(0, depth - 1)
            elif c == ";" and not depth:
                cuts.append(at + k + 1)
                rest = _STARTS.match(line[k + 1 :].lstrip())
                open_kind, case = rest[1].upper() if rest else "", 0
        if open_kind not in ("BEGIN", "END", "IF", "ELSE"):
            for token in _CASE.finditer(line):
                case = case + 1 if token[1].upper() == "CASE" else max(0, case - 1)
        at += len(line)
        if head.strip():
            last = line
    cuts.append(len(code))
    spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    # white space at the end belongs to the statement before it
    if len(spans) > 1 and not code[slice(*spans[-1])].strip():
        spans[-2:] = [(spans[-2][0], spans[-1][1])]
    return spans


def batch_spans(code: str) -> list[tuple[int, int]]:
    hidden, cuts = mask(code, identifiers=True), [0]
    parts = []
    for got in _GO.finditer(hidden):
        parts.append((cuts[-1], got.start()))
        cuts.append(got.end())
    parts.append((cuts[-1], len(code)))
    return [(a, b) for a, b in parts if code[a:b].strip()]


def comma_spans(text: str) -> list[tuple[int, int]]:
    hidden, depth, start, out = mask(text, identifiers=True), 0, 0, []
    for k, c in enumerate(hidden):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append((start, k))
            start = k + 1
    return [*out, (start, len(text))]


def _spans(text: Column, f) -> Column:
    return mapped(lambda t: [] if t is None else [{"start": a, "end": b} for a, b in f(t)], SPAN, text)


def parts(text: Column, spans: Column) -> Column:
    """The trimmed texts of spans."""
    return F.transform(spans, lambda s: F.trim(F.substring(text, s["start"] + 1, s["end"] - s["start"])))


def statements(objects: DataFrame, code: str = "code") -> DataFrame:
    """``objects`` with a row a statement: pos, start, end, statement."""
    spanned = objects.withColumn("__s", _spans(F.col(code), statement_spans))
    # of an inner explode, Spark makes a filter on the spans and moves it, with
    # the Python function in it, below the exchange that deals out the objects
    rows = spanned.select(*objects.columns, F.posexplode_outer("__s").alias("pos", "span")).filter("pos is not null")
    return rows.select(*objects.columns, "pos", F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.substring(F.col(code), F.col("span.start") + 1, F.col("span.end") - F.col("span.start")).alias("statement"))


def batches(text: Column) -> Column:
    return parts(text, _spans(text, batch_spans))


def comma_parts(text: Column) -> Column:
    return parts(text, _spans(text, comma_spans))


def packed(pieces: Column, chars: int = 6000, decisions: int = 10) -> Column:
    """Neighbours merged greedily while family and both budgets allow.

    ``pieces``: array<struct<text,family,points>>, in order.
    """
    empty = F.array().cast("array<struct<text:string,family:string,points:int>>")

    def step(done: Column, piece: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        fits = F.coalesce((last["family"] == piece["family"]) & (F.length(last["text"]) + F.length(piece["text"]) + 1 <= chars) & (last["points"] + piece["points"] <= decisions), F.lit(False))
        merged = F.struct(F.concat(last["text"], F.lit("\n"), piece["text"]).alias("text"), last["family"].alias("family"), (last["points"] + piece["points"]).alias("points"))
        same = F.struct(piece["text"].alias("text"), piece["family"].alias("family"), piece["points"].cast("int").alias("points"))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged))).otherwise(F.concat(done, F.array(same)))

    return F.aggregate(pieces, empty, step)


def _cut(paragraph: str, most: int, overlap: int) -> list[str]:
    """Pieces of ``most`` characters, each starting ``overlap`` before the last ended."""
    step = most - overlap if most > overlap else most
    return [paragraph[at : at + most] for at in range(0, len(paragraph), step)]


def overlapping_chunks(text: str, most: int = 800, overlap: int = 100) -> list[str]:
    """Paragraphs packed up to ``most``, long ones cut on their own; each chunk
    but the first has the end of the one before in front, on a line of its own."""
    chunks: list[str] = []
    held: list[str] = []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        if len("\n\n".join(held)) + len(paragraph) + 2 <= most:
            held.append(paragraph)
            continue
        chunks += ["\n\n".join(held)] if held else []
        held = [paragraph] if len(paragraph) <= most else []
        chunks += [] if held else _cut(paragraph, most, overlap)
    chunks += ["\n\n".join(held)] if held else []
    if not overlap:
        return chunks
    return [c if not k else f"{chunks[k - 1][-overlap:]}\n{c}" for k, c in enumerate(chunks)]


_POINTS = re.compile(r"(?i)\b(?:IF|ELSIF|ELSEIF|CASE|WHEN|WHILE|MERGE)\b")


def points(code: str) -> int:
    """Decision points of executable text."""
    return len(_POINTS.findall(mask(code)))


def by_decisions(text: str, most: int = 10, chars: int = 6000) -> list[str]:
    """A text with too many decision points, cut between statements."""
    if points(text) <= most:
        return [text]
    out: list[str] = []
    held, n = "", 0
    for a, b in statement_spans(text):
        statement = text[a:b]
        own = points(statement)
        together = f"{held}\n\n{statement}" if held else statement
        if held and (n + own > most or len(together) > chars):
            out.append(held)
            held, n = statement, own
        else:
            held, n = together, n + own
    return [*out, held] if held else out


def size_limited(text: str, most: int = 6000) -> list[str]:
    """Pieces of at most ``most`` characters.

    A text a quarter over that stays whole if it branches; else it is cut
    between statements, what is still too long between lines, and at last
    anywhere.
    """
    if len(text) <= most:
        return [text]
    hidden = mask(text).upper()
    word = lambda w: re.search(rf"\b{w}\b", hidden)
    if len(text) <= int(1.25 * most) and (word("IF") and word("ELSE") or word("CASE")):
        return [text]
    pieces = _filled((text[a:b] for a, b in statement_spans(text)), "\n", most, counted=0)
    out: list[str] = []
    for piece in pieces:
        for part in _filled(piece.split("\n"), "\n", most, counted=1) if len(piece) > most else [piece]:
            out += [part[at : at + most] for at in range(0, len(part), most)]
    return out


def _filled(parts, between: str, most: int, counted: int) -> list[str]:
    """Parts joined while they fit; a separator counts or not."""
    out: list[str] = []
    held = None
    for part in parts:
        if held and len(held) + counted * len(between) + len(part) > most:
            out.append(held)
            held = part
        else:
            held = f"{held}{between}{part}" if held else part
    return [*out, held] if held else out


def pieces(text: Column, cut, *limits: int) -> Column:
    """Pieces of a text by ``by_decisions`` or ``size_limited``."""
    return mapped(lambda t: None if t is None else cut(t, *limits), "array<string>", text)


def absorbed(sections: Column) -> Column:
    """Sections without those that only administer a session.

    Their text goes in front of the next real section, after the last one if
    none follows; if all are such, they are one section.  ``sections``:
    array<struct<kind,text>>, in order.
    """
    one = "struct<kind:string,text:string>"
    empty = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit("").alias("held"))
    joined = lambda a, b: F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit("\n\n"), b))
    section = lambda kind, text: F.struct(kind.cast("string").alias("kind"), text.cast("string").alias("text"))

    def step(s: Column, x: Column) -> Column:
        kept = F.struct(F.concat(s["done"], F.array(section(x["kind"], joined(s["held"], x["text"])))).alias("done"), F.lit("").alias("held"))
        return F.when(administrative(x["text"]), F.struct(s["done"].alias("done"), joined(s["held"], x["text"]).alias("held"))).otherwise(kept)

    def finish(s: Column) -> Column:
        last = F.get(s["done"], F.size(s["done"]) - 1)
        with_last = F.concat(F.slice(s["done"], F.lit(1), F.size(s["done"]) - 1), F.array(section(last["kind"], joined(last["text"], s["held"]))))
        return F.when(s["held"] == "", s["done"]).when(F.size(s["done"]) == 0, F.array(section(F.lit("declaration"), s["held"]))).otherwise(with_last)

    return F.aggregate(sections, empty, step, finish)


def administrative(text: Column) -> Column:
    """Only USE, SET .. ON/OFF and GO, besides comments; and at least one."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"--.*$", ""))), lambda x: x != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"(?i)^(?:USE\s+[\w\[\]]+|SET\s+\w+\s+(?:ON|OFF)|GO)\s*;?$"))


def chunked(text: Column, most: int = 800, overlap: int = 100) -> Column:
    return streamed(lambda t: overlapping_chunks(t or "", most, overlap), "array<string>", text)


INACTIVE = "array<struct<start:int,end:int,body:string>>"
#: What commented-out statements look like, and what only code has.
_DEAD = re.compile(r"(?is)\b(?:UPDATE|INSERT\s+INTO|DELETE\s+FROM|MERGE\s+INTO|TRUNCATE\s+TABLE|DROP\s+TABLE|SELECT\b.{0,200}?\bFROM)\b")
_SHAPE = re.compile(r"(?im)(?:\w+\.\w+|@\w+|[<>=!]=|\bSET\s+\w+\s*=|;\s*$)")
_MARKER = "-- [INACTIVE CODE REMOVED - see verification report]"


def inactive_spans(code: str) -> list[tuple[int, int]]:
    """Comments that hold code: blocks, and runs of neighbouring line comments."""
    spans = [m.span() for m in re.finditer(r"(?s)/\*.*?\*/", code)]
    run: list[int] = []
    for m in [*re.finditer(r"(?m)^[ \t]*--.*$", code), None]:
        if run and (m is None or code[run[1] : m.start()] not in ("\n", "\r\n")):
            spans.append((run[0], run[1]))
            run = []
        if m:
            run = [run[0] if run else m.start(), m.end()]
    return sorted(s for s in spans if _DEAD.search(code[slice(*s)]) and _SHAPE.search(code[slice(*s)]))


def without_inactive(code: str) -> str:
    """``code`` with a mark in place of dead code; length and lines stay."""
    out = list(code)
    for a, b in inactive_spans(code):
        put = iter(_MARKER)
        for i in range(a, b):
            out[i] = code[i] if code[i] in "\r\n" else next(put, " ")
    return "".join(out)


def inactive(code: Column) -> Column:
    return mapped(lambda t: [{"start": a, "end": b, "body": t[a:b].strip()} for a, b in inactive_spans(t or "")], INACTIVE, code)


#: Line kinds of procedural code, first match wins.
def section_kind(statement: Column) -> Column:
    t = F.regexp_replace(statement, r"^\s+", "")
    return (
        F.when(t.rlike(r"(?i)^(?:USE|SET\s+\w+\s+(?:ON|OFF)|GO)\b"), "administrative").when(t.rlike(r"(?i)^(?:CREATE|ALTER)\b"), "header").when(t.rlike(r"(?i)^DECLARE\s+\w+\s+CURSOR\b|^CURSOR\b|^(?:OPEN|FETCH|CLOSE)\b"), "cursor")
        .when(t.rlike(r"(?i)^DECLARE\b"), "declaration").when(t.rlike(r"(?i)^(?:EXCEPTION\b|BEGIN\s+CATCH\b)"), "exception").when(t.rlike(r"(?i)^(?:IF|ELSE|ELSIF|WHILE|BEGIN)\b"), "nested_block").otherwise("main_body")
    )


def section_family(kind: Column) -> Column:
    """Kinds that may share a chunk: a block is part of the body around it."""
    return F.when(kind.isin("main_body", "nested_block"), "body").otherwise(kind)
