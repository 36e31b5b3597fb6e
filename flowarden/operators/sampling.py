"""Labelled unions, samples and splits. Randomness is ``md5(key‖seed)``: the same rows on any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowarden.operators.ordered import ranked, running, smallest
from flowarden.session import materialise

HASH_DIGITS = 12  # hex digits of a hash that bound a sample


def hash_order(key: str, seed: int | str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def label_union(attack: DataFrame, normal: DataFrame, name: str = "true_label") -> DataFrame:
    return attack.withColumn(name, F.lit(1)).unionByName(normal.withColumn(name, F.lit(0)))


def _hash_bound(n: int, rows: int, slack: float) -> str | None:
    """The md5 prefix below which at least ``n`` of ``rows`` rows lie, up to chance; none if that is all of them."""
    share = slack * (n + 6 * n**0.5 + 20) / max(rows, 1)
    return None if share >= 1 else format(int(share * 16**HASH_DIGITS), f"0{HASH_DIGITS}x")


def first_by_hash(df: DataFrame, n: int, hashed: str, key: str) -> DataFrame:
    """The ``n`` rows with the smallest md5 in column ``hashed`` (ties by ``key``), with two passes over ``df``.

    md5 is uniform, so the bound below which ``n`` of N rows lie is known from N alone, up to chance: rows under a
    slightly wider bound are stored and counted, and the bound is widened in the unlikely case that they are too few.
    """
    rows = df.count()
    slack = 1.0
    while True:
        bound = _hash_bound(n, rows, slack)
        if bound is None:
            return df.orderBy(hashed, key).limit(n)
        kept = materialise(df.where(F.col(hashed) < F.lit(bound)), "sample")
        if kept.count() >= n:
            return kept.orderBy(hashed, key).limit(n)
        slack *= 2


def sample_n(df: DataFrame, n: int, seed: int | str, key: str) -> DataFrame:
    """Exactly min(n, rows) rows without replacement."""
    return first_by_hash(df.withColumn("__h", hash_order(key, seed)), n, "__h", key).drop("__h")


def sample_per_class(df: DataFrame, n: int, seed: int | str, key: str, label: str = "label") -> DataFrame:
    """``sample_n`` for each of the two classes, with two passes over ``df`` for both: one counts, one keeps rows under the classes' bounds."""
    y = F.col(label)
    sizes = df.agg(*[F.count(F.when(y == k, 1)) for k in (0, 1)]).first()
    hashed = df.withColumn("__h", hash_order(key, seed))
    under = [(y == k) & (F.col("__h") < F.lit(_hash_bound(n, sizes[k], 1.0) or "g")) for k in (0, 1)]  # "g" is above all digits
    kept = materialise(hashed.where(under[0] | under[1]), "sample")
    held = kept.agg(*[F.count(F.when(y == k, 1)) for k in (0, 1)]).first()
    if any(held[k] < min(n, sizes[k]) for k in (0, 1)):  # hardly ever: draw each class with a widening bound
        return sample_n(df.where(y == 1), n, seed, key).unionByName(sample_n(df.where(y == 0), n, seed, key))
    one, zero = (kept.where(y == k).orderBy("__h", key).limit(n).drop("__h") for k in (1, 0))
    return one.unionByName(zero)


def shuffle(df: DataFrame, seed: int | str, key: str) -> DataFrame:
    """Rows in seeded pseudo-random order, as a range-partitioned sort."""
    return df.orderBy(hash_order(key, seed), key)


def shuffle_position(df: DataFrame, seed: int | str, key: str, name: str = "pos") -> DataFrame:
    """The 0-based position each row takes in ``shuffle``."""
    keyed = df.withColumn("__h", hash_order(key, seed))
    return ranked(keyed, ["__h", key], "__pos").withColumn(name, F.col("__pos") - 1).drop("__h", "__pos")


def _rank_in_class(df: DataFrame, label: str, key: str, seed: int | str) -> DataFrame:
    keyed = df.withColumn("__h", hash_order(key, seed))
    return ranked(keyed, ["__h", key], "__pos", by=[label]).drop("__h")


def stratified_split(df: DataFrame, fractions: Sequence[float], label: str, key: str, seed: int | str = 42, exact: bool = True, name: str = "split") -> DataFrame:
    """Assign each row to split 0, 1, … so that every class is cut in the same proportions.

    ``exact`` cuts each class by rank. Otherwise each row decides by its own hash, with no shuffle at all,
    and the proportions hold up to sampling noise.
    """
    cuts, total = [], 0.0
    for f in fractions[:-1]:
        total += f
        cuts.append(total)

    def assign(position: Column, bounds: Sequence[Column]) -> Column:
        expr = F.lit(len(fractions) - 1)
        for i in range(len(bounds) - 1, -1, -1):
            expr = F.when(position < bounds[i], F.lit(i)).otherwise(expr)
        return expr

    if not exact:
        unit = F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
        return df.withColumn(name, assign(unit, [F.lit(c) for c in cuts]))
    keyed = df.withColumn("__h", hash_order(key, seed))
    numbered = running(keyed, ["__h", key], {"__pos": F.lit(1).cast("long")}, [label], totals_as={"__pos": "__size"})
    bounds = [F.round(F.col("__size") * F.lit(c)) for c in cuts]
    return numbered.withColumn(name, assign(F.col("__pos") - 1, bounds)).select(*df.columns, name)


def stratified_folds(df: DataFrame, k: int, label: str, key: str, seed: int | str = 42, name: str = "fold") -> DataFrame:
    """Fold 0..k−1 per row; each class is dealt evenly over the folds."""
    numbered = _rank_in_class(df, label, key, seed)
    return numbered.withColumn(name, ((F.col("__pos") - 1) % k).cast("int")).drop("__pos")


def head_then_sample(df: DataFrame, n: int, seed: int | str, key: str, order: str | None = None) -> DataFrame:
    """The first 2n rows in ``order``, then n of them at random."""
    first = smallest(df, [order, key] if order and order != key else [key], 2 * n)
    return first.orderBy(hash_order(key, seed), key).limit(n)


def unused_rows(everything: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key appears in no split."""
    return everything.join(used.select(key), key, "left_anti")
