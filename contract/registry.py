"""Collects registered queries with the independent SQL that checks them."""

import re
from collections.abc import Callable

from . import fixtures

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    """A named building block of oracle SQL; blocks may use earlier ones."""
    CTES[name] = body.strip()


for _name in fixtures.VIEWS:
    cte(_name, fixtures.duck_view(_name))


def _needed(body: str) -> list[str]:
    """Blocks the body uses, each after the blocks it uses itself."""
    ordered: list[str] = []

    def visit(text: str, open_names: frozenset) -> None:
        for name in CTES:
            if name in ordered or name in open_names:
                continue
            if re.search(rf"\b{name}\b", text):
                visit(CTES[name], open_names | {name})
                ordered.append(name)

    visit(body, frozenset())
    return ordered


def with_ctes(body: str, recursive: bool = False) -> str:
    parts = [f"{name} as (\n{CTES[name]}\n)" for name in _needed(body)]
    body = body.strip()
    if body.startswith("with "):
        parts.append(body[len("with "):])
        body = ""
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(parts) + "\n" + body if parts else body


def query(name: str, sql: str | None = None, recursive: bool = False):
    def register(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = (sql, recursive)
        return fn

    return register


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(body, recursive) for name, (body, recursive) in SQL.items()}
