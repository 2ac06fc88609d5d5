"""A register of queries by name, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """``query(sql)`` registers a function under its name; without SQL where SQL cannot express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def register(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return register


# SQL of the title and DOI normalisers, as functions/text.py has them.
def title_sql(column: str) -> str:
    from scholion.functions.text import ACCENTED, BASES

    return f"trim(regexp_replace(regexp_replace(translate(lower(coalesce({column}, '')), '{ACCENTED}', '{BASES}'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def doi_sql(column: str) -> str:
    return f"nullif(regexp_replace(lower(trim({column})), '^(https?://[a-z.]*/)?(doi:\\s*)?', ''), '')"


def blank_sql(column: str) -> str:
    return f"nullif(trim({column}), '')"
