"""Claims of language models: shape repair, salvage, call with retries.

No model runs here.  ``call`` is a table function for one given by the caller.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salvage(text: str, field: str) -> list[dict]:
    """The complete objects of an array field of JSON that was cut off."""
    at = text.find(f'"{field}"')
    at = text.find("[", at) + 1 if at >= 0 else 0
    decoder, found = json.JSONDecoder(), []
    while at:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        try:
            item, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        if isinstance(item, dict):
            found.append(item)
    return found


def salvaged(text: Column, field: str) -> Column:
    """Array of the complete items, each as JSON."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [json.dumps(x, sort_keys=True, ensure_ascii=False) for x in salvage(t or "", field)])

    return run(text)


def shaped(answer: Column, sections: dict[str, str]) -> Column:
    """Struct of the named lists of a JSON answer, and of warnings.

    ``sections`` has the type of each list's items.  What is missing or no list
    is an empty list; fields that an item lacks are null, others are dropped.
    """
    raw = {name: F.get_json_object(answer, f"$.{name}") for name in sections}
    whole = F.get_json_object(answer, "$").isNotNull() & F.trim(answer).startswith("{")
    lists = {name: F.when(F.trim(raw[name]).startswith("["), F.from_json(raw[name], f"array<{kind}>")) for name, kind in sections.items()}
    amiss = [F.when(~F.coalesce(whole, F.lit(False)), "no JSON object"), *(F.when(raw[n].isNull(), f"{n} is missing").when(lists[n].isNull(), f"{n} is no list") for n in sections)]
    filled = [F.coalesce(lists[n], F.array().cast(f"array<{kind}>")).alias(n) for n, kind in sections.items()]
    return F.struct(*filled, F.array_compact(F.array(*amiss)).alias("warnings"))


class Transient(Exception):
    """A failure that is worth another try."""


def with_retries(f: Callable[[], str], attempts: int = 3, first: float = 1.0, most: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """``f``, tried again after transient failures only."""
    for attempt in range(attempts):
        try:
            return f()
        except Transient:
            if attempt + 1 == attempts:
                raise
            sleep(min(most, first * 2**attempt) * (0.5 + random.random() / 2))
    raise AssertionError


def call(prompts: DataFrame, model: Callable[[str], str], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``cache_key``, response_text, error: each distinct prompt asked once.

    A failure degrades its own row, not the job.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, prompt in zip(frame["cache_key"], frame["prompt"]):
                try:
                    out.append((key, with_retries(lambda p=prompt: model(p), sleep=sleep), None))
                except Exception as failure:
                    out.append((key, None, str(failure)))
            yield pd.DataFrame(out, columns=["cache_key", "response_text", "error"])

    return prompts.select("cache_key", "prompt").dropDuplicates(["cache_key"]).mapInPandas(run, "cache_key string, response_text string, error string")
