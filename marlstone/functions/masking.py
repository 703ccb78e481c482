"""Blanking comments and literals, offsets kept.

Nested comments and quote states need a scanner, so this is an Arrow UDF; one
pass and one scanner serve all variants.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

from marlstone.functions.arrow import mapped

_TOKEN = re.compile(r"--[^\n]*|/\*|'|\"|\[|`")
_NEST = re.compile(r"/\*|\*/")
_KEEP_LINES = re.compile(r"[^\n]")


def mask(text: str, comments: bool = True, strings: bool = True, identifiers: bool = False) -> str:
    """``text`` with what is named blanked by as many spaces."""
    out, at = [], 0
    while (got := _TOKEN.search(text, at)) is not None:
        out.append(text[at : got.start()])
        start, token = got.start(), got.group()
        if token.startswith("--"):
            end, hide = got.end(), comments
        elif token == "/*":
            depth, end, hide = 1, got.end(), comments
            while depth:
                inner = _NEST.search(text, end)
                if inner is None:
                    end = len(text)
                    break
                depth += 1 if inner.group() == "/*" else -1
                end = inner.end()
        else:
            close = "]" if token == "[" else token
            hide, end = strings if token == "'" else identifiers, got.end()
            while True:
                stop = text.find(close, end)
                if stop < 0:
                    end = len(text)
                    break
                end = stop + 1
                if text[end : end + 1] != close:
                    break
                end += 1
        part = text[start:end]
        out.append(_KEEP_LINES.sub(" ", part) if hide else part)
        at = end
    out.append(text[at:])
    return "".join(out)


def masked(text: Column, comments: bool = True, strings: bool = True, identifiers: bool = False) -> Column:
    return mapped(lambda t: None if t is None else mask(t, comments, strings, identifiers), "string", text)


def executable(text: Column) -> Column:
    """Comments blanked, literals kept."""
    return masked(text, strings=False)


def comments_and_strings(text: str) -> str:
    """Only what ``mask`` would blank: where instructions could hide."""
    hidden = mask(text)
    return "".join(c if h != c or c == "\n" else " " for c, h in zip(text, hidden))


def hidden(text: Column) -> Column:
    """Comments and literals only, the rest blanked."""
    return mapped(lambda t: None if t is None else comments_and_strings(t), "string", text)
