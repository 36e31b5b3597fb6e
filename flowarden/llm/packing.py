"""Packing token sequences by cutting-stock column generation.

1. One pass tokenizes every whole text, closes it with the end id and cuts it into full pieces and one rest. Only
   piece sizes and checksums leave the task (token ids on request).
2. The histogram of piece lengths, in classes of ``GRAIN`` tokens, is all the driver needs: at most
   capacity / ``GRAIN`` counts, whatever the table holds.
3. The linear program over patterns (how many pieces of each class fill a sequence) is solved by the revised simplex
   method from a greedy basis; new patterns are priced by a knapsack dynamic program over the current prices. Pattern counts are rounded
   down and what that leaves over, at most one sequence's worth of each pattern, is packed first-fit decreasing.
4. Pieces are ranked within their class (spread over hashed slices whose totals are summed, so a class with most of
   the pieces is not one task's work) and a rank determines pattern, sequence and place by a binary search.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowarden.session import materialise

CAPACITY = 2048
GRAIN = 4
END_ID = 1
SLICE_ROWS = 500_000
LEAST_SLICES = 64
GAP = 1e-5  # the linear program stops within this share of its bound
ROUNDS = 400
BATCH_CHARS = 4_000_000  # of texts whose pieces leave a task together


# ---- tokenizing ----------------------------------------------------------------------------------------
def _same_as_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as byte strings, if the file is plain byte-level BPE whose merges are in the order of their ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    usual = model["type"] == "BPE" and not spec.get("normalizer") and not spec.get("post_processor")
    if not (usual and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [model["vocab"]["".join(p)] for p in pairs] != list(range(256, 256 + len(pairs))):
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [i for i in range(256) if i not in visible]
    byte = {chr(i): i for i in visible} | {chr(256 + k): i for k, i in enumerate(hidden)}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


class Encoder:
    """Ids of whole texts by a tokenizer file.

    Texts of Latin letters, whose character classes no library disputes, are merged by a faster implementation of the
    same vocabulary where the file allows it; all others, and texts that may name a special token, by the tokenizer.
    """

    def __init__(self, path: str):
        import json
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as file:
            ranks = _same_as_ranks(json.load(file))
        if ranks:
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = re.compile(r"[\t\n\r -~\xa1-\xac\xae-ɏ]*").fullmatch

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids; a null text is empty."""
        if not text:
            return b""
        if self.fast and "<|" not in text and self.plain(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process: it is loaded once."""
    return Encoder(path)


def _pieces(tokenizer: str | None, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json")).encode
        end = np.array([END_ID], "<u4").tobytes()

        def made(rows):
            cols = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc_id, text in rows:
                data = encode(text) + end
                total = len(data) // 4
                for start in range(0, total, capacity):
                    part = data[4 * start : 4 * (start + capacity)]
                    row = (doc_id, start, len(part) // 4, zlib.crc32(part), total, np.frombuffer(part, "<u4").tolist() if keep_ids else None)
                    for c, v in zip(cols.values(), row):
                        c.append(v)
            if not keep_ids:
                del cols["ids"]
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.list_(pa.int32()) if k == "ids" else pa.int64()) for k, v in cols.items()})

        for batch in batches:
            rows, chars = [], 0
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append(row)
                chars += len(row[1] or "")
                if chars >= BATCH_CHARS:
                    yield made(rows)
                    rows, chars = [], 0
            if rows:
                yield made(rows)

    return run


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Full pieces and a rest of every document: doc_id, start, length, ids_crc32, doc_tokens (and ids).

    Every row counts as a document of its own: a null or empty text is its end id alone, rows with a null or a
    repeated id are cut like any other. An empty table gives no piece.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_pieces(tokenizer, capacity, keep_ids), schema)


# ---- patterns (driver: at most capacity / GRAIN classes) -----------------------------------------------
def _best_pattern(size: np.ndarray, price: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dearest filling of ``room`` by classes of ``size``, each any number of times (knapsack dynamic program)."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for at in range(1, room + 1):
        fits = np.searchsorted(size, at, "right")
        best[at] = best[at - 1]
        if fits:
            values = best[at - size[:fits]] + price[:fits]
            k = int(np.argmax(values))
            if values[k] > best[at] + 1e-12:
                best[at], pick[at] = values[k], k
    pattern, at = np.zeros(len(size), np.int64), room
    while at > 0:
        if pick[at] < 0:
            at -= 1
        else:
            pattern[pick[at]] += 1
            at -= size[pick[at]]
    return best[room], pattern


def _first_basis(size: np.ndarray, need: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """One pattern per class: the largest class that has pieces left and the fullest rest, until a class is used up.

    A pattern holds no class used up before it, so the columns form a triangular, hence regular, basis.
    """
    n = len(size)
    left, live = need.astype(float), np.ones(n, bool)
    basis, amount = np.zeros((n, n)), np.zeros(n)
    for _ in range(n):
        open_ = np.flatnonzero(live)
        pattern = np.zeros(n, np.int64)
        pattern[open_[-1]] = 1
        rest = room - size[open_[-1]]
        fits = open_[size[open_] <= rest]
        if len(fits):  # fullness first, larger pieces at equal fullness
            pattern[fits] += _best_pattern(size[fits], size[fits] / room * (1 + 1e-3 * size[fits] / room), rest)[1]
        used = np.flatnonzero(pattern)
        times = left[used] / pattern[used]
        out = used[int(np.argmin(times))]
        basis[:, out], amount[out] = pattern, times.min()
        left = np.maximum(left - times.min() * pattern, 0.0)
        left[out], live[out] = 0.0, False
    return basis, amount


def solve_patterns(size: np.ndarray, need: np.ndarray, room: int, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[int, np.ndarray]]:
    """``(times, pieces of each class)``: whole patterns that use every class exactly ``need`` times.

    ``size`` ascends, no class is larger than ``room`` and every class is needed. Columns are generated until the
    program is within ``gap`` of its bound, no pattern is worth its price, or ``rounds`` are over.
    """
    n = len(size)
    if not n:
        return []
    basis, amount = _first_basis(size, need, room)
    inverse = np.linalg.inv(basis)
    bound = float(need @ size) / room
    for turn in range(rounds):
        price = np.maximum(inverse.sum(0), 0.0)
        value, column = _best_pattern(size, price, room)
        bound = max(bound, float(price @ need) / max(value, 1.0))  # prices scaled by the dearest pattern are feasible
        if value <= 1 + 1e-9 or amount.sum() <= bound * (1 + gap):
            break
        step = inverse @ column
        can = step > 1e-9
        if not can.any():
            break
        ratio = np.full(n, np.inf)
        ratio[can] = amount[can] / step[can]
        out = int(np.argmin(ratio))
        basis[:, out] = column
        inverse[out] /= step[out]
        others = np.arange(n) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        if turn % 100 == 99:  # against drift
            inverse = np.linalg.inv(basis)
        amount = np.maximum(inverse @ need, 0.0)
    chosen: list[tuple[int, np.ndarray]] = []
    left = need.astype(np.int64).copy()
    for k in np.argsort(-amount, kind="stable"):
        column = basis[:, k].astype(np.int64)
        used = column > 0
        times = min(int(amount[k] + 1e-7), int((left[used] // column[used]).min()))
        if times > 0:
            chosen.append((times, column))
            left -= times * column
    return chosen + _first_fit(size, left, room)


def _first_fit(size: np.ndarray, left: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    free, made = np.empty(0, np.int64), []
    for k in np.argsort(-size, kind="stable"):
        for _ in range(int(left[k])):
            at = np.flatnonzero(free >= size[k])
            if len(at):
                at = at[np.argmin(free[at])]
            else:
                free = np.append(free, room)
                made.append(np.zeros(len(size), np.int64))
                at = len(free) - 1
            free[at] -= size[k]
            made[at][k] += 1
    return [(1, p) for p in made]


def _placement(size: np.ndarray, need: np.ndarray, room: int) -> dict[str, np.ndarray]:
    """Ranks, class after class, cut into intervals: where each starts, its pattern's first sequence, pieces per sequence."""
    patterns = solve_patterns(size, need, room)
    base, start = np.concatenate([[0], np.cumsum(need)]), []
    sequence = np.concatenate([[0], np.cumsum([t for t, _ in patterns])]).astype(np.int64)
    for k in range(len(size)):
        at = base[k]
        for p, (times, column) in enumerate(patterns):
            if column[k]:
                start.append((at, sequence[p], column[k]))
                at += times * column[k]
    table = np.array(start, np.int64).reshape(-1, 3)
    return {"class_base": base[:-1], "start": table[:, 0], "sequence": table[:, 1], "each": table[:, 2]}


# ---- packing -------------------------------------------------------------------------------------------
def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """``pieces`` (doc_id, start, length, ...) with ``sequence_id`` and ``offset``: every sequence gapless from 0.

    ``pieces`` should be stored: it is read for the histogram and for the ranks. Pieces that agree in all columns are
    interchangeable. An empty table gives no row.
    """
    kind = F.ceil(F.col("length") / grain).cast("int")
    rows = pieces.withColumns({"__kind": kind})
    count = {r["__kind"]: r["n"] for r in rows.groupBy("__kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = np.array(sorted(count), np.int64)
    place = _placement(size, np.array([count[k] for k in size], np.int64), capacity // grain)
    slices = max(LEAST_SLICES, sum(count.values()) // SLICE_ROWS)
    rows = rows.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(slices)).cast("int"))
    before = Window.partitionBy("__kind").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__kind", "__slice").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("__kind", "__slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__kind", "__slice").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("__rank", F.row_number().over(within)).join(offsets, ["__kind", "__slice"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before") - 1).drop("__before", "__slice")
    kinds = size

    @F.arrow_udf("struct<sequence_id:long,slot:long>")
    def locate(kind: pa.Array, rank: pa.Array) -> pa.Array:
        k = np.searchsorted(kinds, np.asarray(kind))
        at = place["class_base"][k] + np.asarray(rank)
        i = np.searchsorted(place["start"], at, "right") - 1
        past = at - place["start"][i]
        found = place["sequence"][i] + past // place["each"][i], past % place["each"][i]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["sequence_id", "slot"])

    placed = ranked.withColumn("__at", locate("__kind", "__rank"))
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.desc("__kind"), "__slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(*pieces.columns, "__kind", F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.slot").alias("__slot"))
    return placed.select(*pieces.columns, "sequence_id", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``; one row per piece."""
    return pack(materialise(token_pieces(docs, id_col, text_col, tokenizer, CAPACITY, keep_ids), "pieces"))
