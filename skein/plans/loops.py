"""Loops, driven from the driver over lazily planned rounds."""

from __future__ import annotations

import enum
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

from skein.operators.flow import Expr, Flow, col
from skein.session import checkpoint


class EmitKind(enum.Enum):
    #: Rows when they leave only.
    LAST = 0
    #: Also the rows that stay, after each round.
    AFTER = 1
    #: As AFTER, and the rows that enter the first round.
    BEFORE = 2


@dataclass(frozen=True)
class IterCondition:
    """At most ``max_iters`` rounds (None: as many as it takes); ``until``: when a row leaves. A null condition is false."""

    max_iters: int | None = None
    until: Expr | None = None

    def __post_init__(self) -> None:
        if self.max_iters is not None and self.max_iters < 1:
            raise ValueError("a loop needs at least one round")
        if self.max_iters is None and self.until is None:
            raise ValueError("a loop without an end")


def run_loop(seed: Flow, condition: IterCondition, kind: EmitKind, body: Callable[[Flow], Flow], every: int = 5) -> Flow:
    """The rows that leave the loop.

    State is the frontier, the rows that stay. A row's condition is tested before the first round and after each one but the
    last, after which all rows leave. Every ``every`` rounds the frontier is written, and the loop ends if it is empty; give 1
    for a body with an aggregate that has a value for no rows, else such rounds go on from nothing. The first round always
    runs. Operators of the body work on one round's rows. The rounds of a body are pure: state between rounds is in columns.
    """
    left: list[Flow] = []

    def split(flow: Flow) -> Flow:
        if condition.until is None:
            return flow
        done = F.coalesce(col(condition.until), F.lit(False))
        left.append(Flow(flow.df.where(done), flow.scope))
        return inside(flow.df.where(~done))

    def inside(df) -> Flow:
        return Flow(df, seed.scope, level=seed.level + 1)

    stay = split(inside(seed.df))
    if kind is EmitKind.BEFORE:
        left.append(stay)
    n = 0
    while True:
        n += 1
        out = body(stay)
        if n == condition.max_iters:
            left.append(Flow(out.df, out.scope))
            break
        cut = n % every == 0
        if cut:
            out = inside(checkpoint(out.df))
        stay = split(out)
        if kind is not EmitKind.LAST:
            left.append(stay)
        if cut and stay.df.isEmpty():
            break
    names = seed.df.columns if set(left[-1].df.columns) == set(seed.df.columns) else left[-1].df.columns
    return Flow(reduce(lambda a, b: a.unionAll(b), (f.df.select(*names) for f in left)), seed.scope, seed.key, seed.level)
