"""Registered queries by name, their DuckDB SQL, and SQL forms of the text rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL if there is any."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def six(c: Column) -> Column:
    return F.round(c, 6)


#: White space of all scripts, as a class of RE2.
SPACE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def STRIPPED(x: str) -> str:  # noqa: N802 - SQL of a rule
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def NORMAL(x: str) -> str:  # noqa: N802
    """SQL of :func:`spanloom.functions.text.normalised`; look-arounds become groups, twice for overlaps."""
    x = f"translate({STRIPPED(x)}, '{T.FULL_WIDTH}', '{T.HALF_WIDTH}')"
    for sign, letters in T.ROMAN.items():
        x = f"replace({x}, '{sign}', '{letters}')"
    x = f"regexp_replace({x}, '[\\x{{E000}}-\\x{{F8FF}}]', '', 'g')"
    x = f"regexp_replace({x}, '(?m)^{SPACE}*[-•●·]{SPACE}*', '', 'g')"
    x = f"regexp_replace({x}, '(?m)^{SPACE}*(?:\\p{{Nd}}+[)）]|[a-zA-Z][)）])', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '{SPACE}+', '', 'g'), '[；;。，,：:!?]+$', '')"
    x = f"regexp_replace({x}, '(?:{T.FUNCTION_WORDS})$', '')"
    for before, letter, after, digit in (("[A-Z]", "l", "([A-Z0-9])", "1"), ("[A-Z]", "l", "()$", "1"), ("[0-9]", "l", "([A-Z])", "1"), ("[0-9]", "O", "([0-9])", "0"), ("[0-9]", "o", "([0-9])", "0")):
        for _ in range(2):
            x = f"regexp_replace({x}, '({before}){letter}{after}', '\\1{digit}\\2', 'g')"
    return x
