"""Cleaning, measuring and keying text: column expressions throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F﻿]"
#: What an instruction to a model looks like.
INJECTION = (
    r"(?i)ignore\s+(all\s+)?(the\s+)?(previous|prior|above)\s+instructions",
    r"(?i)disregard\s+(the\s+)?(system|previous|above)\s+(prompt|instructions)",
    r"(?i)you\s+are\s+now\s+(a|an)\s+\w+",
    r"(?i)new\s+instructions?\s*:",
    r"(?i)\bsystem\s*:\s*\S",
    r"(?i)\bassistant\s*:\s*\S",
    r"(?i)</?(system|assistant|user)>",
    r"(?i)reveal\s+(your|the)\s+(system\s+)?prompt",
    r"(?i)forget\s+(everything|all)\s+(you|that)",
    r"(?i)do\s+not\s+(follow|apply)\s+(the\s+)?(schema|rules|format)",
    r"(?i)respond\s+only\s+with\s+",
)


def flags(named: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in named.items())))


def guarded(text: Column, least: int = 5, most: int = 500_000) -> Column:
    """Struct of cleaned text, rejected, warnings."""
    clean = F.regexp_replace(text, CONTROL, "")
    warnings = flags({"control characters removed": F.length(clean) < F.length(text), "truncated": F.length(clean) > most})
    return F.struct(F.substring(clean, 1, most).alias("text"), (F.coalesce(F.length(F.trim(clean)), F.lit(0)) < least).alias("rejected"), warnings.alias("warnings"))


def injections(text: Column, patterns: Sequence[str] = INJECTION) -> Column:
    """Numbers of the patterns that the text has; of code, give its comments
    and literals (``masking.hidden``), where instructions could hide."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(patterns))))


def line_of(text: Column, offset: Column) -> Column:
    """Line (from 1) of a character offset (from 0); null if unknown."""
    head = F.substring(text, F.lit(1), offset)
    inside = (offset >= 0) & (offset <= F.length(text))
    return F.when(inside, F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1)


def found_at(text: Column, part: Column) -> Column:
    """Offset of the first occurrence; null, not -1, if there is none."""
    at = F.instr(text, part)
    return F.when(at > 0, at - 1)


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normal(text: Column) -> Column:
    return F.lower(clean(text))


def fragment(text: Column) -> Column:
    """Normal text without closing ; and , and without outer parentheses.

    Parentheses are taken off as long as they enclose the whole.
    """
    bare = F.regexp_replace(normal(text), r"[;,\s]+$", "")
    taken_off = lambda t: F.when(encloses(t), F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    opening = F.sequence(F.lit(0), F.length(F.regexp_extract(F.replace(bare, F.lit(" "), F.lit("")), r"^\(*", 0)))
    return F.aggregate(opening, bare, lambda t, _: taken_off(t))


def encloses(text: Column) -> Column:
    """Whether the first parenthesis is closed by the last character."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    depth = F.aggregate(
        F.split(inner, ""),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda s, c: F.struct((s["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), F.least(s["low"], s["d"] + F.when(c == ")", -1).otherwise(0)).alias("low")),
        lambda s: (s["d"] == 0) & (s["low"] == 0),
    )
    return text.startswith("(") & text.endswith(")") & F.when(F.length(text) > 2, depth).otherwise(F.length(text) == 2)


def identifier(name: Column) -> Column:
    return F.upper(F.trim(F.translate(name, '[]"`', "")))


def bare_field(name: Column) -> Column:
    """Last part of a dotted name, without quotes, lower case."""
    return F.lower(F.trim(F.element_at(F.split(F.translate(name, '[]"`', ""), r"\."), -1)))


def column_reference(name: Column) -> Column:
    """Without an alias of at most 2 characters, or at most 4 small ones."""
    alias, rest = F.regexp_extract(name, r"^([^.]+)\.(.+)$", 1), F.regexp_extract(name, r"^([^.]+)\.(.+)$", 2)
    short = (F.length(alias) > 0) & ((F.length(alias) <= 2) | alias.rlike("^[a-z]{1,4}$"))
    return F.when(short, rest).otherwise(name)


#: Endings of copies of an object.
ENDING = r"(?i)_(?:V|VER|VERSION)\d{1,3}$|_\d{8}$|_\d{6}$|_\d{4}$|_(?:BAK|BACKUP|OLD|COPY\d*|TEMP|TMP|FINAL\d*|NEW|ARCHIVE|ARCHIVED|DEPRECATED|DRAFT|WIP|REV\d*)$"


def business_name(name: Column) -> Column:
    """Up to three dated or versioned endings taken off, while letters stay."""
    name = F.trim(F.coalesce(name, F.lit("")))
    out = name
    for _ in range(3):
        shorter = F.regexp_replace(out, ENDING, "")
        out = F.when(shorter.rlike("[A-Za-z]"), shorter).otherwise(out)
    return F.when(F.upper(name).isin("UNKNOWN_OBJECT", "UNKNOWN", "ANONYMOUS_BLOCK"), name).otherwise(out)


def tokens(text: Column, per: float = 3.5) -> Column:
    return tokens_of(F.length(text), per)


def tokens_of(length: Column, per: float = 3.5) -> Column:
    """Tokens of a text of so many characters."""
    return F.greatest(F.lit(1), F.ceil(length / F.lit(per)).cast("long"))


def clamped_tokens(wanted: Column, limit: Column, used: Column, margin: int = 200, floor: int = 200) -> Column:
    """What a per-minute limit leaves after the prompt and a margin.

    Without a limit as many as wanted; null if under ``floor`` are left, and
    never fewer than that.
    """
    left = limit - used - margin
    return F.when(limit.isNull(), wanted).when(left >= floor, F.greatest(F.lit(floor), F.least(wanted, left)))


def shortened(text: Column, most: int) -> Column:
    flat = clean(text)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("..."))).otherwise(flat)


def degenerate(text: Column, run: int = 20, share: float = 0.25) -> Column:
    """Six or more repeats: 20 characters and a quarter of the text at least."""
    found = F.regexp_extract(text, r"(.{2,24}?)\1{5,}", 0)
    return (F.length(found) >= run) & (F.length(found) >= share * F.length(text))


def truncated(text: Column, most: int = 40) -> Column:
    """An odd number of quotes, or a short phrase without an end."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    odd = lambda q: F.pmod(F.length(bare) - F.length(F.replace(bare, F.lit(q), F.lit(""))), F.lit(2)) == 1
    return (bare != "") & (odd("'") | odd('"') | ((F.length(bare) <= most) & ~bare.rlike(r"[.!?)\]}'\"]$") & bare.contains(" ")))


def jargon(text: Column, terms: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms)))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 12 hex digits; null and empty parts don't count."""
    joined = F.concat_ws("|", *(F.nullif(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 12))


def content_tokens(text: Column, stop: Sequence[str] = ()) -> Column:
    """Distinct identifiers of three letters or more, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_]{2,}"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def predicate_tokens(text: Column, stop: Sequence[str] = ()) -> Column:
    numbers = F.regexp_extract_all(text, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))
    return F.array_union(content_tokens(text, stop), numbers)


def overlap_coefficient(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


#: Schemas that are no aliases, and names of the sides of a MERGE.
SCHEMAS, SIDES = ("PRO", "DBO", "SYS", "TMP", "OMS", "CFG"), ("TARGET", "SOURCE", "SRC", "TGT")
_PATH = r"(?<![A-Za-z0-9_#])(?:#?[A-Za-z_][A-Za-z0-9_]*\.)+[A-Za-z_][A-Za-z0-9_]*"


def shown_path(path: Column, tables: Column) -> Column:
    """A dotted path with tables for its aliases (map of capital alias to table).

    What is no known alias but looks like one, by up to three letters or as the
    side of a MERGE, is left out; a table's own name stays.
    """
    def shown(part: Column) -> Column:
        table = F.try_element_at(tables, F.upper(part))
        bare = F.regexp_replace(F.element_at(F.split(table, r"\."), -1), "^#+", "")
        alias = part.rlike("^[A-Za-z]{1,3}$") & ~F.upper(part).isin(*SCHEMAS) | F.upper(part).isin(*SIDES)
        return F.when(table.isNotNull(), F.when(F.lower(bare) == F.lower(part), part).otherwise(table)).when(alias, "").otherwise(part)

    parts = F.split(path, r"\.")
    head = F.filter(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), shown), lambda x: x != "")
    return F.array_join(F.concat(head, F.array(F.element_at(parts, -1))), ".")


def rewritten(text: Column, tables: Column) -> Column:
    """A text with all its dotted paths shown with tables for aliases."""
    paths, between = F.regexp_extract_all(text, F.lit(_PATH), F.lit(0)), F.split(text, _PATH, -1)
    put = lambda b: F.concat(F.get(b, F.lit(0)), F.array_join(F.transform(paths, lambda p, i: F.concat(shown_path(p, tables), F.get(b, i + 1))), ""))
    return F.when(F.size(paths) > 0, F.get(F.transform(F.array(between), put), F.lit(0))).otherwise(text)
