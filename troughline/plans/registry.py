"""Named queries over the given tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from troughline.functions.keys import SLOT_FACTORS, SLOT_PRIME

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register `fn(spark, sf_dir)`; without `sql` the query is checked against brute force in tests."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def draw_sql(source: str, reps: int, seed: int, lead: str = "") -> str:
    """SQL twin of the draws by `functions.keys.mixed_slot`: `rep, pick` for every row of `source` (pos, k) and replicate."""
    names = "ab"
    step = lambda expr: ", ".join(expr(x, *f) for x, f in zip(names, SLOT_FACTORS))
    sql = f"SELECT *, {step(lambda x, per_rep, per_pos, c, d: f'(rep * {per_rep} + pos * {per_pos} + {seed}) % {SLOT_PRIME} AS {x}0')} FROM {source}, range({reps}) r(rep)"
    sql = f"SELECT *, {step(lambda x, a, b, first, d: f'(xor({x}0, {x}0 >> 15) * {first}) % {SLOT_PRIME} AS {x}1')} FROM ({sql})"
    sql = f"SELECT *, {step(lambda x, a, b, c, second: f'(xor({x}1, {x}1 >> 13) * {second}) % {SLOT_PRIME} AS {x}2')} FROM ({sql})"
    return f"SELECT {lead}rep, (xor(a2, a2 >> 16) % {SLOT_PRIME} * {SLOT_PRIME} + xor(b2, b2 >> 16) % {SLOT_PRIME}) % k AS pick FROM ({sql})"
