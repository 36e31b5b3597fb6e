"""Running totals and ranks over a whole table, without a single-partition window.

A global ``row_number`` or running ``sum`` moves every row into one task. Here the rows are cut into
contiguous key ranges: each range is scanned by its own window, and the totals of the ranges before it
are added. Range bounds come from a small uniform sample and become literals, so they affect balance
only; the result is exact for any bounds, and the same in a recomputed task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowarden.session import materialise

SAMPLE_PER_RANGE = 32
ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 1024
HASH_RANGE_DIGITS = 3  # 4,096 ranges
RANGES_PER_RUN = 16  # at most one range a run is ranked row by row
MAX_OFFSETS = 100_000  # range totals up to here are broadcast
PLAIN_TOP_ROWS = 1_000_000  # tables up to here go through a plain top-n
PRUNE_SAMPLE = 20_000
TOP_N_LIMIT = 1_000_000  # larger n are ranked in ranges


def _key_columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    keys = []
    for i, name in enumerate(names):
        dtype = df.schema[name].dataType
        c = F.col(f"`{name}`")
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.unix_micros(c.cast("timestamp"))
        keys.append(c.alias(f"k{i}"))
    return keys


def _literal(row: T.Row, dtype: T.StructType) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, dtype.fields)])


def _sorted_sample(keyed: DataFrame, rows: int, want: int) -> list[T.Row]:
    """About ``want`` of the ``rows`` keys in Spark's own order."""
    picked = keyed.select("__run_key").sample(fraction=min(1.0, want / rows), seed=17)
    return picked.agg(F.sort_array(F.collect_list("__run_key"))).first()[0]


def _range_bounds(keyed: DataFrame, ranges: int | None) -> list[T.Row]:
    if ranges == 1:
        return []
    rows = keyed.count()
    if ranges is None:
        # several ranges per shuffle partition even out their hashing
        most = min(MAX_RANGES, 4 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        ranges = min(most, -(-rows // ROWS_PER_RANGE))
    want = ranges * SAMPLE_PER_RANGE
    if ranges <= 1 or rows <= want:  # one range holds it
        return []
    sample = _sorted_sample(keyed, rows, want)
    step = max(1, len(sample) // ranges)
    bounds: list[T.Row] = []
    for row in sample[step::step]:
        if not bounds or row != bounds[-1]:
            bounds.append(row)
    return bounds


def _below(keys: Sequence[Column], bound: Sequence) -> Column:
    """Whether the leading keys sort before ``bound`` (NULL first), as plain comparisons."""
    k, v = keys[0], bound[0]
    less = F.lit(False) if v is None else k.isNull() | (k < F.lit(v))
    if len(bound) == 1:
        return less
    return less | (k.eqNullSafe(F.lit(v)) & _below(keys[1:], bound[1:]))


def _within(keys: Sequence[Column], bounds: list[T.Row], first: int, last: int) -> Column:
    """Whether the key lies in one of the ranges ``first`` to ``last``."""
    low = ~_below(keys, bounds[first - 1]) if first else F.lit(True)
    return low & _below(keys, bounds[last]) if last < len(bounds) else low


def _range_id(df: DataFrame, keys: Sequence[Column], bounds: list[T.Row], name: str = "__range") -> DataFrame:
    """Add the number of bounds at or below the key, by halving steps in an array of the bounds.

    A step is one comparison however many bounds there are; nested conditions would make a method that grows with them,
    and beyond 8,000 bytes the JVM no longer compiles it.
    """
    if not bounds:
        return df.withColumn(name, F.lit(0))
    keyed = df.withColumn("__bound_key", F.struct(*keys))
    dtype = keyed.schema["__bound_key"].dataType
    known = F.array(*[_literal(b, dtype) for b in bounds])
    out, at, step = keyed, F.lit(0), 1 << (len(bounds).bit_length() - 1)
    while step:
        out = out.withColumn(name, at + F.when(F.col("__bound_key") >= F.get(known, at + F.lit(step - 1)), step).otherwise(0))
        at, step = F.col(name), step >> 1
    return out.drop("__bound_key")


def running(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, str | Column],
    by: Sequence[str] = (),
    ranges: int | None = None,
    totals_as: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums in ascending ``order``, restarted for each ``by`` group.

    ``totals_as`` maps the name of a running sum to a column for its group's total. ``order`` must end in a unique key. One group may hold most of the rows: it is spread over ranges.
    """
    by, order = list(by), list(order)
    keyed = df.withColumn("__run_key", F.struct(*_key_columns(df, [*by, *order])))
    bounds = _range_bounds(keyed, ranges)
    totals_as = dict(totals_as or {})
    addends = {f"__a{i}": (F.col(c) if isinstance(c, str) else c) for i, c in enumerate(sums.values())}
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = _range_id(df.withColumns(addends), _key_columns(df, [*by, *order]), bounds)
    if not bounds:
        whole = Window.partitionBy(*by, "__range")
        new = {name: F.sum(a).over(within) for name, a in zip(sums, addends)}
        new |= {totals_as[name]: F.sum(a).over(whole) for name, a in zip(sums, addends) if name in totals_as}
        return cut.withColumns(new).drop("__range", *addends)

    totals = cut.groupBy(*by, "__range").agg(*[F.sum(a).alias(a) for a in addends])
    # a range is contiguous, so there is one total per range and one more per group: small, and counted here
    rows = totals.limit(MAX_OFFSETS + 1).collect()
    bounded = len(rows) <= MAX_OFFSETS
    if bounded:
        totals = df.sparkSession.createDataFrame(rows, totals.schema)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)],
        F.col("__range").alias("__r"),
        *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"{a}_off") for a in addends],
        *[F.sum(a).over(Window.partitionBy(*by)).alias(totals_as[n]) for n, a in zip(sums, addends) if n in totals_as],
    )
    match = F.col("__range") == F.col("__r")
    for i, b in enumerate(by):
        match = match & F.col(b).eqNullSafe(F.col(f"__by{i}"))
    out = cut.withColumns({f"{a}_in": F.sum(a).over(within) for a in addends})
    out = out.join(F.broadcast(offsets) if bounded else offsets, match)
    out = out.withColumns({name: F.col(f"{a}_in") + F.col(f"{a}_off") for name, a in zip(sums, addends)})
    return out.select(*df.columns, *sums, *totals_as.values())


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank", by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """1-based position in ascending ``order`` (whose last column is unique), per ``by`` group."""
    return running(df, order, {name: F.lit(1).cast("long")}, by, ranges)


def ranked_by_range(df: DataFrame, order: Sequence[str], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """``ranked``, with the rows in that order, for what is stored next: a task for each key range of at most about a million rows.

    Ranges are counted before the rows move, so no total is joined to them, and a task sorts its one range alone, which
    fits its memory however large the table is.
    """
    keys = _key_columns(df, order)
    if ranges is None:
        ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_RANGE))
    bounds = _range_bounds(df.withColumn("__run_key", F.struct(*keys)), ranges)
    cut = _range_id(df, keys, bounds)
    sizes = {r["__range"]: r["count"] for r in cut.groupBy("__range").count().collect()}  # a row for each range
    before = [0]
    for at in range(len(bounds)):
        before.append(before[-1] + sizes.get(at, 0))
    placed = cut.repartitionById(len(bounds) + 1, F.col("__range")).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place in the range, which is a partition
    offset = F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("__range"))
    return placed.withColumn("__own", own).withColumn(name, F.col("__own") + 1 + offset).select(*df.columns, name)


def ranked_by_hash(df: DataFrame, hashed: str, key: str, rows: int, name: str = "rank") -> DataFrame:
    """``ranked`` in the order of an md5 column (ties by the unique ``key``) for ``rows`` rows, which are stored without that column.

    Digits of a hash are uniform, so the first ones cut even ranges without a sample, and the ranges are counted in what was
    stored: the table is read once, in shuffle tasks of about a million rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-rows // (cores * ROWS_PER_RANGE)))
    cut = df.withColumn("__range", F.coalesce(F.substring(hashed, 1, HASH_RANGE_DIGITS), F.lit(""))).repartition(tasks, "__range")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(hashed, key))
    stored = materialise(cut.withColumn("__own", own).drop(hashed), "ranked")
    sizes = stored.groupBy("__range").count().orderBy("__range").toArrow()  # a row for each range
    n = sizes["count"].to_numpy()
    before = pa.table({"__range": sizes["__range"], "__before": pa.array(n.cumsum() - n, pa.int64())})
    out = stored.join(F.broadcast(df.sparkSession.createDataFrame(before)), "__range")
    return out.withColumn(name, F.col("__before") + F.col("__own")).select(*[c for c in df.columns if c != hashed], name)


def run_totals(df: DataFrame, order: Sequence[str], size: int, sums: Mapping[str, str], runs: int, rest: bool = True, ranges: int | None = None) -> DataFrame:
    """``run`` (from 1), its row count ``total`` and its sums, for runs of ``size`` rows in ascending ``order`` (ending in a unique key).

    Rows behind the last of ``runs`` runs count in that one, or, without ``rest``, nowhere. Key ranges are added up in one
    scan; a range inside one run goes to it as a whole, and only the rows of ranges that a run's border cuts are ranked.
    """
    keys = _key_columns(df, order)
    if ranges is None:
        ranges = min(MAX_RANGES, max(RANGES_PER_RUN * runs, df.count() // ROWS_PER_RANGE))
    bounds = _range_bounds(df.withColumn("__run_key", F.struct(*keys)), ranges)
    measures = [F.count(F.lit(1)).alias("total"), *[F.sum(c).alias(n) for n, c in sums.items()]]
    totals = _range_id(df, keys, bounds).groupBy("__range").agg(*measures).orderBy("__range").toArrow()  # a row for each range

    def run_of(position):  # 0-based
        return position // size + 1

    whole, split, before = [], {}, 0
    for i, (at, rows) in enumerate(zip(totals["__range"].to_pylist(), totals["total"].to_pylist())):
        first, last = (min(run_of(p), runs) if rest else run_of(p) for p in (before, before + rows - 1))
        if first == last:
            whole.append((i, first))
        else:
            split[at] = before
        before += rows
    index, run = (pa.array([pair[k] for pair in whole], pa.int64()) for k in (0, 1))
    inside = totals.take(index).drop_columns("__range").add_column(0, "run", run)
    pieces = df.sparkSession.createDataFrame(inside)
    if split:
        offset = F.element_at(F.create_map(*[F.lit(x) for pair in split.items() for x in pair]), F.col("__range")).cast("long")
        own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
        run = F.floor((offset + own - 1) / F.lit(size)).cast("long") + 1
        held = df.where(reduce(Column.__or__, [_within(keys, bounds, at, at) for at in split]))
        placed = _range_id(held, keys, bounds).withColumn("run", F.least(run, F.lit(runs)) if rest else run)
        pieces = pieces.unionByName(placed.groupBy("run").agg(*measures))
    return pieces.where(F.col("run") <= runs).groupBy("run").agg(F.sum("total").alias("total"), *[F.sum(n).alias(n) for n in sums])


def smallest(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` first rows in ascending ``order`` (ending in a unique key), whatever the table's size.

    A plain top-n sends n rows from every task to one. On a large table the candidates are first cut down
    by a key bound that is *counted* to keep at least n rows, so the result is the same.
    """
    keyed = df.withColumn("__run_key", F.struct(*_key_columns(df, order)))
    dtype = keyed.schema["__run_key"].dataType
    kept, rows = keyed, keyed.count()
    while rows > max(PLAIN_TOP_ROWS, 4 * n):
        sample = _sorted_sample(kept, rows, PRUNE_SAMPLE)
        at, enough = int(1.5 * n / rows * len(sample)) + 8, 0
        while at < len(sample):
            cut = kept.where(F.col("__run_key") <= _literal(sample[at], dtype))
            enough = cut.count()
            if enough >= n:
                break
            at *= 2
        if enough < n or enough > 0.9 * rows:
            break
        kept, rows = cut, enough
    kept = kept.drop("__run_key")
    if n <= TOP_N_LIMIT:
        return kept.orderBy(*order).limit(n)
    return ranked(kept, order, "__pos").where(F.col("__pos") <= n).drop("__pos")


def between(df: DataFrame, order: Sequence[str], skip: int, n: int, most_rows: int = PLAIN_TOP_ROWS) -> DataFrame:
    """The ``n`` rows behind the ``skip`` first ones in ascending ``order`` (ending in a unique key), in that order.

    Sorting with an offset would gather skip + n rows in one task. Key ranges are counted instead, and the table is cut
    to the ranges that hold the wanted positions until at most ``most_rows`` (or four times ``n``) rows are left.
    """
    keys = _key_columns(df, order)
    kept, rows = df, df.count()
    while rows > max(most_rows, 4 * n):
        bounds = _range_bounds(kept.withColumn("__run_key", F.struct(*keys)), min(MAX_RANGES, rows // most_rows + 1))
        sizes = {r["__range"]: r["count"] for r in _range_id(kept, keys, bounds).groupBy("__range").count().collect()}
        first = 0
        while first < len(bounds) and skip >= sizes.get(first, 0):
            skip -= sizes.get(first, 0)
            first += 1
        last, held = first, sizes.get(first, 0)
        while last < len(bounds) and held < skip + n:
            last += 1
            held += sizes.get(last, 0)
        kept = kept.where(_within(keys, bounds, first, last))
        before, rows = rows, held
        if held > 0.9 * before:
            break
    return kept.orderBy(*order).offset(skip).limit(n)
