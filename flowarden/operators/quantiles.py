"""Exact order statistics by narrowing, so that no task ever holds a whole column.

Spark's exact ``percentile`` keeps every distinct value in one buffer. Here each round sketches the
interval that holds the wanted rank, counts around the sketched bracket, and keeps the part that must
hold the rank. An interval is gathered only once its *counted* size is at most ``GATHER_LIMIT``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowarden.session import materialise

GATHER_LIMIT = 20_000
ACCURACY = 10_000


@dataclass
class _Interval:
    col: str
    ranks: list[int]
    size: int
    below: int = 0
    lo: float | None = None
    hi: float | None = None

    def values(self) -> Column:
        c = F.col(f"`{self.col}`").cast("double")
        cond = c.isNotNull() & ~F.isnan(c)
        if self.lo is not None:
            cond = cond & (c > F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (c < F.lit(self.hi))
        return F.when(cond, c)


def order_statistics(
    df: DataFrame, ranks: Mapping[str, Callable[[int], Sequence[int]]]
) -> dict[str, tuple[int, dict[int, float]]]:
    """Per column: the number of values and the 0-based order statistics that ``ranks(n)`` asks for.

    NULL and NaN are ignored. Ranks outside the column are dropped.
    """
    cols = list(ranks)
    df = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    counts = df.agg(*[F.count(F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double"))).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    found: dict[str, tuple[int, dict[int, float]]] = {}
    todo: list[_Interval] = []
    for i, c in enumerate(cols):
        n = counts[i]
        found[c] = (n, {})
        for r in sorted(set(ranks[c](n))):
            if not 0 <= r < n:
                continue
            last = todo[-1] if todo and todo[-1].col == c else None
            if last and r - last.ranks[-1] <= 1:
                last.ranks.append(r)
            else:
                todo.append(_Interval(c, [r], n))

    while todo:
        small = [t for t in todo if t.size <= GATHER_LIMIT]
        large = [t for t in todo if t.size > GATHER_LIMIT]
        if small:
            # intervals over the same stretch share one gathered list
            stretches = {(t.col, t.lo, t.hi): t for t in small}
            got = df.agg(*[F.sort_array(F.collect_list(t.values())).alias(f"v{i}") for i, t in enumerate(stretches.values())]).first()
            lists = dict(zip(stretches, got))
            for t in small:
                values = lists[(t.col, t.lo, t.hi)]
                for r in t.ranks:
                    found[t.col][1][r] = values[r - t.below]
        todo = _narrow(df, large, found) if large else []
        if any(t.size > GATHER_LIMIT for t in todo):
            # a small share of the rows is left: further rounds read only these
            inside = [t.values().isNotNull() for t in todo]
            df = materialise(df.where(reduce(Column.__or__, inside)), "narrowed")
    return found


def _narrow(df: DataFrame, intervals: list[_Interval], found) -> list[_Interval]:
    slack = 2.0 / ACCURACY
    # targets inside the same stretch of a column share one sketch
    shared: dict[tuple, tuple[_Interval, list[float]]] = {}
    for t in intervals:
        probs = shared.setdefault((t.col, t.lo, t.hi), (t, []))[1]
        probs += [
            max(0.0, (t.ranks[0] - t.below + 0.5) / t.size - slack),
            min(1.0, (t.ranks[-1] - t.below + 0.5) / t.size + slack),
        ]
    sketched = df.agg(*[F.percentile_approx(t.values(), ps, ACCURACY).alias(f"b{i}") for i, (t, ps) in enumerate(shared.values())]).first()
    edges = {key: iter(values) for key, values in zip(shared, sketched)}
    brackets = [(next(edges[t.col, t.lo, t.hi]), next(edges[t.col, t.lo, t.hi])) for t in intervals]
    measures = []
    for i, (t, (a, b)) in enumerate(zip(intervals, brackets)):
        v = t.values()
        measures += [
            F.count(F.when(v < F.lit(a), 1)).alias(f"lt{i}"),
            F.count(F.when(v == F.lit(a), 1)).alias(f"ea{i}"),
            F.count(F.when((v > F.lit(a)) & (v < F.lit(b)), 1)).alias(f"in{i}"),
            F.count(F.when((v == F.lit(b)) & F.lit(b != a), 1)).alias(f"eb{i}"),
        ]
    counted = df.agg(*measures).first()
    out: list[_Interval] = []
    for i, (t, (a, b)) in enumerate(zip(intervals, brackets)):
        lt, ea, inside, eb = counted[4 * i : 4 * i + 4]
        at_a = t.below + lt
        past_a, past_in, past_b = at_a + ea, at_a + ea + inside, at_a + ea + inside + eb
        parts: dict[str, _Interval] = {}
        for r in t.ranks:
            if r < at_a:
                parts.setdefault("lt", _Interval(t.col, [], lt, t.below, t.lo, a)).ranks.append(r)
            elif r < past_a:
                found[t.col][1][r] = a
            elif r < past_in:
                parts.setdefault("in", _Interval(t.col, [], inside, past_a, a, b)).ranks.append(r)
            elif r < past_b:
                found[t.col][1][r] = b
            else:
                rest = t.size - lt - ea - inside - eb
                parts.setdefault("gt", _Interval(t.col, [], rest, past_b, b, t.hi)).ranks.append(r)
        out += parts.values()
    return out


def exact_quantiles(df: DataFrame, probs: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between order statistics; None for an empty column."""

    def wanted(ps):
        return lambda n: [r for p in ps for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))] if n else []

    stats = order_statistics(df, {c: wanted(ps) for c, ps in probs.items()})
    out: dict[str, list[float | None]] = {}
    for c, ps in probs.items():
        n, got = stats[c]
        out[c] = []
        for p in ps:
            if n == 0:
                out[c].append(None)
                continue
            pos = p * (n - 1)
            lo, hi = got[math.floor(pos)], got[math.ceil(pos)]
            out[c].append(lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos)))
    return out


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in cols}).items()}
