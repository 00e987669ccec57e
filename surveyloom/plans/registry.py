"""Named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.plans.survey import survey_clean_sql, survey_raw_sql

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own or a given name, with its check if it has one."""
    def register(run: Query) -> Query:
        ENTRIES[name or run.__name__] = Entry(run, sql)
        return run
    return register


def over_raw(sql: str, extra: str = "") -> str:
    """``sql`` with ``survey_raw`` (and further named tables) in reach."""
    return f"with survey_raw as ({survey_raw_sql()}){', ' + extra if extra else ''} {sql}"


def over_clean(sql: str, extra: str = "") -> str:
    return over_raw(sql, f"survey_clean as ({survey_clean_sql()}){', ' + extra if extra else ''}")


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)
