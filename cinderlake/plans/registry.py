"""Collects queries with the DuckDB SQL for each."""

from __future__ import annotations

from cinderlake.plans.oracles import sql


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, oracle: str | None = None):
        """Registers the decorated function; ``oracle`` may name the tables of ``plans.oracles``."""

        def register(function):
            self.queries[name] = function
            if oracle:
                self.oracles[name] = sql(oracle)
            return function

        return register
