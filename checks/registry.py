"""Registration of queries with the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from checks.oracle_views import VIEWS

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, tuple] = {}

DEPENDS = {"raw_transactions": ["transactions"], "predictions": ["transactions"], "case_actions": ["transactions"],
           "watchlist": ["accounts"]}
EXTRA: dict[str, tuple[str, list[str]]] = {}


def define(name: str, body: str, *needs: str) -> None:
    """A shared SQL expression other queries can name."""
    EXTRA[name] = (body, list(needs))


def sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for d in (EXTRA[name][1] if name in EXTRA else DEPENDS.get(name, [])):
            add(d)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{n} AS ({(EXTRA[n][0] if n in EXTRA else VIEWS[n]).strip()})" for n in order]
    body = body.strip()
    if parts and body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if parts and body.startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, body: str | None = None, *needs: str):
    def keep(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if body is not None:
            ORACLE[name] = (body, needs)
        return fn
    return keep


def oracle() -> dict[str, str]:
    return {name: sql(body, *needs) for name, (body, needs) in ORACLE.items()}
