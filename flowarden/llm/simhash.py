"""SimHash near-duplicates by a Gray-order hierarchical index.

1. A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles (repeats count).
2. Equal fingerprints collapse by an aggregate, so copies never meet as rows.
3. Distinct fingerprints are routed to groups that share masked bit patterns: with ``bits + 1`` bands, two
   fingerprints within ``bits`` agree on one band. A counted group of more than ``GROUP_ROWS`` is not solved but
   routed again over the bands of its remaining bits. Four levels leave at most 2^20 different patterns of the
   default 64 bits in a group, so no group can grow with the corpus, however alike its members are.
4. Within a task the groups are sorted by Gray rank. Runs of neighbours share a parent node whose mask holds the
   bits common to all below it. Pairs of nodes are walked from the top: bits fixed in both and different add up; a
   sum above ``bits`` prunes the pair with all below it, and a pair that cannot reach it links all below it at once.
   Only what stays undecided descends. The task keeps labels, so pairs of nodes already in one class are left out,
   and it returns a star per class (at most one edge per row), never the pairs.
5. The stars are joined to classes by distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowarden.llm.components import connected_components
from flowarden.session import materialise

SHINGLE_WORDS = 3
BITS = 3
SEED = 42
GROUP_ROWS = 8192  # larger groups are routed over more bits
FANOUT = 8
BLOCK_ROWS = 262_144  # rows a task indexes at a time, at group boundaries
PAIRS_AT_ONCE = 1 << 19
HASHES_AT_ONCE = 1 << 18


def fingerprint_of(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of one whole UTF-8 text; zero without a word."""
    import xxhash

    parts = text.lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    if len(parts) <= words:
        starts, ends = [0], [len(joined)]
    else:
        starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
        ends = ends[words - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), HASHES_AT_ONCE):
        part = range(i, min(i + HASHES_AT_ONCE, len(starts)))
        hashes = np.fromiter((digest(joined[starts[j] : ends[j]], SEED) for j in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column | str, words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint column (long) of a text column; a null text has no word and so the fingerprint zero."""

    @F.arrow_udf("long")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, words) for t in texts.cast(pa.large_binary()).to_pylist()], pa.int64())

    return compute(F.col(text) if isinstance(text, str) else text)


def gray_rank(bits: Column) -> Column:
    """Position of a 64-bit pattern in the reflected Gray code (as a signed long, so upper halves swap)."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


# ---- routing by shared masked patterns -----------------------------------------------------------------
def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def child_masks(mask: int, bands: int) -> list[int]:
    """The mask extended by each of ``bands`` runs of the bits it leaves open."""
    open_bits = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(i * len(open_bits) / bands) for i in range(bands + 1)]
    return [mask | sum(1 << b for b in open_bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _route(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """``(fp, path)`` to one row per child: its path and the bits of ``fp`` under the child's mask."""
    bands = len(masks[0])
    table = F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in row]) for row in masks])
    child = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    cut = rows.select("fp", "path", child.alias("band"))
    mask = F.element_at(F.element_at(table, F.col("path") + 1), F.col("band") + 1)
    return cut.select("fp", (F.col("path") * bands + F.col("band")).alias("path"), F.col("fp").bitwiseAND(mask).alias("pattern"))


# ---- the index inside a task ---------------------------------------------------------------------------
def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped


def _levels(fps: np.ndarray, group: np.ndarray) -> list[dict]:
    """Nodes bottom-up; each holds the AND and OR of its rows, its row range and its range of children."""
    rows = np.arange(len(fps))
    levels = [{"all": fps, "any": fps, "group": group, "row": rows, "end": rows + 1}]
    while True:
        low = levels[-1]
        g = low["group"]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(g)])
        if size.max() == 1:
            return levels
        within = np.arange(len(g)) - np.repeat(first, size)
        start = np.flatnonzero(within % FANOUT == 0)
        end = np.r_[start[1:], len(g)]
        levels.append({
            "all": np.bitwise_and.reduceat(low["all"], start), "any": np.bitwise_or.reduceat(low["any"], start),
            "group": g[start], "row": low["row"][start], "end": low["end"][end - 1], "child": start, "children": end - start,
        })


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and for each the number of its range."""
    size = end - start
    which = np.repeat(np.arange(len(start)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[which], which


def link_block(fps: np.ndarray, group: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For rows in (group, Gray rank) order: the first row of each row's class within its group."""
    labels = np.arange(len(fps))
    if not len(fps):
        return labels
    levels = _levels(fps, group)
    top = np.arange(len(levels[-1]["group"]))
    top = top[levels[-1]["end"] - levels[-1]["row"] > 1]
    stack = [(len(levels) - 1, top, top)] if len(top) else []
    while stack:
        depth, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            stack.append((depth, a[PAIRS_AT_ONCE:], b[PAIRS_AT_ONCE:]))
            a, b = a[:PAIRS_AT_ONCE], b[:PAIRS_AT_ONCE]
        at = levels[depth]
        if depth:
            low, high = np.minimum.reduceat(labels, at["row"]), np.maximum.reduceat(labels, at["row"])
            new = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
        else:
            new = labels[a] != labels[b]
        a, b = a[new], b[new]
        fixed = ~((at["all"][a] ^ at["any"][a]) | (at["all"][b] ^ at["any"][b]))
        sure = np.bitwise_count((at["all"][a] ^ at["all"][b]) & fixed).astype(np.int64)
        near = sure <= bits
        a, b, sure, fixed = a[near], b[near], sure[near], fixed[near]
        if not depth:
            labels = _join_labels(labels, a, b)
            continue
        whole = sure + np.bitwise_count(~fixed) <= bits
        if whole.any():
            x, y = a[whole], b[whole]
            for node in (x, y):
                members, which = _ranges(at["row"][node], at["end"][node])
                labels = _join_labels(labels, at["row"][x][which], members)
        a, b = a[~whole], b[~whole]
        wide = at["children"][b]
        cells, which = _ranges(np.zeros(len(a), np.int64), at["children"][a] * wide)
        i, j = at["child"][a][which] + cells // wide[which], at["child"][b][which] + cells % wide[which]
        own = i == j
        cross = i < j
        if cross.any():
            stack.append((depth - 1, i[cross], j[cross]))
        if depth > 1 and own.any():  # popped first: what lies close together is joined before pairs further apart are met
            stack.append((depth - 1, i[own], j[own]))
    return labels


def _star_edges(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(path, pattern, fp):
            new = np.r_[True, (path[1:] != path[:-1]) | (pattern[1:] != pattern[:-1])]
            labels = link_block(fp.view(np.uint64), np.cumsum(new), bits)
            moved = labels != np.arange(len(fp))
            return pa.RecordBatch.from_pydict({"a": pa.array(fp[moved]), "b": pa.array(fp[labels[moved]])})

        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, np.asarray(batch.column(i)).astype(np.int64)]) for i, h in enumerate(held)]
            if len(held[0]) >= BLOCK_ROWS:
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield solve(*[h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield solve(*held)

    return run


def near_links(fps: DataFrame, bits: int = BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) that span every class of links within ``bits``.

    Edges are spanning stars of the classes each group finds, not all links: their transitive closure is that of
    the links. An empty table gives none.
    """
    masks: list[int] = [0]
    pending, found = fps.select("fp", F.lit(0).alias("path")), None
    while True:
        table = [child_masks(m, bits + 1) for m in masks]
        routed = _route(pending, table)
        masks = [m for row in table for m in row]
        last = len(masks) >= (bits + 1) ** 4 or bin(masks[0]).count("1") + bits + 1 > 64
        hot = None
        if not last:
            counted = routed.groupBy("path", "pattern").count().where(F.col("count") > group_rows).select("path", "pattern")
            hot = materialise(counted, "hot-groups")
            if hot.isEmpty():
                hot = None
        light = routed if hot is None else routed.join(hot, ["path", "pattern"], "left_anti")
        ordered = light.repartition("path", "pattern").select("path", "pattern", "fp")
        ordered = ordered.withColumn("rank", gray_rank(F.col("fp"))).sortWithinPartitions("path", "pattern", "rank")
        edges = ordered.select("path", "pattern", "fp").mapInArrow(_star_edges(bits), "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if hot is None:
            return found
        pending = materialise(routed.join(hot, ["path", "pattern"], "left_semi").select("fp", "path").distinct(), "deeper")


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", bits: int = BITS) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct fingerprint: its class, and the smallest id reachable by links.

    Null ids are passed over when the smallest is taken (null if a class has no other). Repeated rows and repeated ids
    are allowed: classes are made of fingerprints. An empty table gives no row.
    """
    first = materialise(docs.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("low")), "fingerprints")
    roots = connected_components(near_links(first.select("fp"), bits))
    placed = materialise(
        first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots"
    )
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return placed.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, bits: int = BITS
) -> DataFrame:
    """Every row's id, fingerprint (16 hex digits) and class id. Rows are kept as they are: nulls, repeats and ties too."""
    marked = materialise(docs.select(F.col(id_col), fingerprint(text_col, words).alias("fp")), "marked")
    classes = duplicate_classes(marked, id_col, "fp", bits)
    named = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(classes, "fp").select(id_col, named, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` (its columns only) with one row left of each class: that of the smallest id.

    A class without any id, or with its smallest id on several rows, keeps one of those rows.
    """
    columns = docs.columns
    marked = materialise(docs.withColumn("__fp", fingerprint(text_col, words)), "marked-documents")
    slim = marked.select(F.col(id_col).alias("id"), F.col("__fp").alias("fp"))
    classes = materialise(duplicate_classes(slim, "id", "fp", bits), "classes")
    keepers = slim.join(classes, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    # ids may repeat, so a class names one keeping fingerprint and the number of rows that could stay
    several = keepers.groupBy("root", "fp", "component_id").count()
    chosen = several.groupBy("root").agg(F.min(F.struct("fp", "component_id", "count")).alias("k"))
    keep = chosen.select(F.col("k.component_id").alias("__id"), F.col("k.fp").alias("__fp"), F.col("k.count").alias("__n"))
    rows = marked.join(keep, "__fp").where(F.col(id_col).eqNullSafe(F.col("__id")))
    repeated = rows.where("__n > 1").dropDuplicates(["__fp"])
    return rows.where("__n = 1").unionByName(repeated).select(*columns)
