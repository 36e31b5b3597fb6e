"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources share the size of the whole table by weight; a target stops at ``MOST_TIMES`` its source's size and
what it leaves is shared by weight again, until no target is above (water filling).

Positions: a source runs through its documents in a fixed pseudo-random order, again and again, until its target is
met: whole passes, then the leading part of one more pass, cut at the document that comes nearest. A copy that
begins after ``u`` words of its source gets the training time ``t`` in 0..1 at which the source's integrated
schedule has asked for ``u`` words; documents of all sources are then range-sorted by ``t``.

Running sizes are taken within hashed slices of a source, whose totals are added up first, so a source that holds
most rows is spread over all slices. The order is that of the hash itself: it does not depend on how many slices,
partitions or executors there are, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowarden.operators.ordered import ranked
from flowarden.session import materialise

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SLICE_ROWS = 200_000
LEAST_SLICES = 64
WORD = r"[^\x20\x09-\x0D]+"
TILT = (1.6, 1.0, 0.4)  # how strongly the first, second and third kind of source lean to the beginning (above 1) or end


def n_words(text: Column | str) -> Column:
    """Number of words in a whole text; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    marks = F.translate(F.regexp_replace(text, WORD, "w"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """``(source, source_size)`` with ``rank`` (from 0, by code point), ``weight`` and ``target``.

    One row per source. Sources without a word get the target 0. An empty table gives no row.
    """
    keyed = ranked(sizes, ["source"], "rank").withColumn("rank", F.col("rank") - 1)
    table = F.array(*[F.lit(w).cast("long") for w in weights])
    keyed = materialise(keyed.withColumn("weight", F.element_at(table, (F.col("rank") % len(weights)).cast("int") + 1)), "sources")
    cap = F.col("source_size") * most_times
    total = keyed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    full, share, filled = F.lit(False), 0.0, -1
    while True:
        # sources already full keep their cap; the others share what is left by weight
        row = keyed.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == filled or not row["weight"]:
            break
        filled, share = row["n"], (total - row["capped"]) / row["weight"]
        full = full | (F.col("weight") * F.lit(share) > cap)
    target = F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.lit(share))
    return keyed.withColumn("target", target)


def plan(
    docs: DataFrame, keep: list[str], weights: tuple = WEIGHTS, most_times: int = MOST_TIMES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Every row of ``docs``, its ``keep`` columns renamed ``__0``, ``__1``, ..., with its part in the mix.

    Added: size, rank (of the source), source_size, target, begins (words of the source before the row), passes and
    taken. ``passes`` is how often the mix holds the whole document, 0 to ``most_times``; ``taken`` is ``passes``
    times its size. A null text has size 0 and is never taken; null sources are one source, the last; rows with a
    null id are ordered by their text. Rows that agree in id and size are interchangeable.
    """
    named = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)],
        F.coalesce(F.concat(F.lit("a"), F.col(source_col).cast("string")), F.lit("b")).alias("source"),  # null last, never null
        n_words(text_col).alias("size"),
        F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long").alias("key"),
        F.col(id_col).alias("id"),
    )
    if text_col not in keep:  # a slim table: read the texts once
        rows = materialise(rows, "sizes")
    slices = max(LEAST_SLICES, docs.count() // SLICE_ROWS)
    rows = rows.withColumn("slice", F.floor(F.col("key") * slices / F.lit(float(1 << 32))).cast("int"))
    per_slice = materialise(rows.groupBy("source", "slice").agg(F.sum("size").alias("part")), "slices")
    targets = source_targets(per_slice.groupBy("source").agg(F.sum("part").alias("source_size")), weights, most_times)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    known = per_slice.withColumn("before", F.coalesce(F.sum("part").over(earlier), F.lit(0))).drop("part").join(targets.drop("weight"), "source")
    within = Window.partitionBy("source", "slice").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(known, ["source", "slice"]).withColumn("begins", F.sum("size").over(within) - F.col("size") + F.col("before"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    passes = F.least(whole + (F.col("begins") + F.col("size") / 2 <= rest).cast("long"), F.lit(most_times).cast("long"))
    rows = rows.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(F.lit(0).cast("long")))
    kept = [f"__{i}" for i in range(len(keep))]
    return rows.select(*kept, "size", "rank", "source_size", "target", "begins", "passes", (F.col("passes") * F.col("size")).alias("taken"))


def training_time(done: Column, tilt: Column) -> Column:
    """The time in 0..1 at which a source has been asked for the share ``done`` of its target.

    Its schedule falls (or rises) evenly from ``tilt`` to ``2 - tilt`` times its mean weight. Integrated, that asks
    for tilt * t - (tilt - 1) * t^2 by time t; the inverse solves the square equation.
    """
    bend = tilt - 1
    straight = F.abs(bend) < 1e-9
    root = F.sqrt(F.greatest(tilt * tilt - 4 * bend * done, F.lit(0.0)))
    return F.when(straight, done).otherwise((tilt - root) / (2 * F.when(straight, F.lit(1.0)).otherwise(bend)))


def position_of(copy: Column, tilt: tuple = TILT) -> Column:
    """Training position in 0..1 of the given copy (from 0) of a planned row."""
    tilts = F.array(*[F.lit(float(x)) for x in tilt])
    own = F.element_at(tilts, (F.col("rank") % len(tilt)).cast("int") + 1)
    done = F.least((F.col("begins") + copy * F.col("source_size")) / F.col("target"), F.lit(1.0))
    return training_time(done, own)


def positions(planned: DataFrame, tilt: tuple = TILT) -> DataFrame:
    """One row per copy the mix holds, with ``copy`` (from 0) and ``position`` in 0..1."""
    copies = planned.where("passes > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int") - 1)))
    return copies.withColumn("position", position_of(F.col("copy"), tilt))


def spans(planned: DataFrame, tilt: tuple = TILT) -> DataFrame:
    """Planned rows with the positions of their first and last copy (null if the mix holds none), range-sorted by the first."""
    held = F.col("passes") > 0
    placed = planned.withColumns({
        "first_position": F.when(held, position_of(F.lit(0), tilt)), "last_position": F.when(held, position_of(F.col("passes") - 1, tilt)),
    })
    return placed.repartitionByRange("first_position", "begins").sortWithinPartitions("first_position", "begins")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, tilt: tuple = TILT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents, whole and repeated as planned, range-sorted by training position; ``docs``' columns only.

    Documents without a word are not part of a mix. An empty table stays empty.
    """
    columns = docs.columns
    placed = positions(plan(docs, columns, weights, MOST_TIMES, id_col, text_col, source_col), tilt)
    own = f"__{columns.index(id_col)}"
    ordered = placed.repartitionByRange("position", own, "copy").sortWithinPartitions("position", own, "copy")
    return ordered.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(columns)])
