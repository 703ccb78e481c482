"""All queries but the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import change, code, evidence, ledger, more, rules, select, texts
from marlstone.plans.common import Query


def _all() -> dict[str, Query]:
    return select.CATALOGUE | change.CATALOGUE | texts.CATALOGUE | evidence.CATALOGUE | code.CATALOGUE | rules.CATALOGUE | more.CATALOGUE | ledger.CATALOGUE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query.run for name, query in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: query.sql for name, query in _all().items() if query.sql}
