"""Language identification by hyperdimensional profiles.

Every letter of every script has a fixed random vector of +1 and -1, made from a hash of its code point. A trigram is the elementwise product (binding) of its letters'
vectors, each rolled (permuted) by its place; a text is the sum (bundle) of its trigrams' vectors. A language's
prototype is the bundle of all its learning texts. A text gets the language whose prototype has the largest cosine
after the mean direction of all prototypes, which every language shares, is taken out of both.

Learning is one pass: tasks bundle the counted trigrams of each text and return one summed vector per language;
Spark adds them up, all in whole numbers, so the model does not depend on the partitioning. The model (languages x
``DIMENSIONS`` numbers) is the only thing gathered: it does not grow with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SEED = 20240601
PLAIN = 27  # symbols of the gap and a-z, whose bound trigrams are tabulated; any other letter's is its code point + PLAIN
SYMBOLS = 0x110000 + PLAIN
AT_ONCE = 4096  # trigrams bound at once
UNKNOWN = "und"


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    """Symbol of every code point: 0 for anything but a letter."""
    points = np.arange(0x110000, dtype=np.int32)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    table = np.where(letter, points + PLAIN, 0).astype(np.int32)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = 1 + i
    return table


def letter_vectors(symbols: np.ndarray) -> np.ndarray:
    """(symbols, DIMENSIONS) vectors of +1 and -1, the bits of a seeded mixing function of each symbol."""
    words = DIMENSIONS // 64
    z = symbols.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + np.uint64(SEED << 32)
    z = z * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    bits = np.unpackbits(z.astype("<u8").view(np.uint8).reshape(len(symbols), -1), axis=1, bitorder="little")
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def bind(codes: np.ndarray) -> np.ndarray:
    """(codes, DIMENSIONS) vectors of trigrams, bound from their letters'."""
    symbols, place = np.unique(np.stack([codes // (SYMBOLS * SYMBOLS), codes // SYMBOLS % SYMBOLS, codes % SYMBOLS]), return_inverse=True)
    letters = letter_vectors(symbols)
    first, second, third = place.reshape(3, -1)
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


@lru_cache(1)
def _plain_vectors() -> np.ndarray:
    """Vectors of all trigrams of a-z and gaps, the same in every task."""
    a, b, c = np.indices((PLAIN, PLAIN, PLAIN), np.int64).reshape(3, -1)
    codes = (a * SYMBOLS + b) * SYMBOLS + c
    return np.concatenate([bind(codes[at : at + AT_ONCE]) for at in range(0, len(codes), AT_ONCE)])


def trigrams(text: str) -> np.ndarray:
    """Codes of the letter trigrams of a whole text; runs of other characters count as one gap. No letter: none."""
    symbols = _symbol_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not symbols.any():
        return np.empty(0, np.int64)
    padded = np.concatenate([[0], symbols, [0]]).astype(np.int64)
    kept = padded[np.r_[True, (padded[1:] != 0) | (padded[:-1] != 0)]]
    return (kept[:-2] * SYMBOLS + kept[1:-1]) * SYMBOLS + kept[2:]


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the vectors of counted trigrams (codes not repeated), as whole numbers."""
    a, b, c = codes // (SYMBOLS * SYMBOLS), codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    plain = np.maximum(np.maximum(a, b), c) < PLAIN
    tabled, others = ((a * PLAIN + b) * PLAIN + c)[plain], codes[~plain]
    # floats hold these sums exactly, and multiply fast
    kind = np.float32 if counts.sum() < 1 << 24 else np.float64
    out = np.zeros(DIMENSIONS, np.int64)
    for vectors, own, n in ((_plain_vectors().__getitem__, tabled, counts[plain]), (bind, others, counts[~plain])):
        for at in range(0, len(own), AT_ONCE):
            out += (n[at : at + AT_ONCE].astype(kind) @ vectors(own[at : at + AT_ONCE]).astype(kind)).astype(np.int64)
    return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language from all rows with a text and a language. No such row: an empty model."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                codes = trigrams(text.as_py())
                if len(codes):
                    own = sums.setdefault(lang.as_py(), np.zeros(DIMENSIONS, np.int64))
                    own += bundle(*np.unique(codes, return_counts=True))
        for lang, own in sums.items():
            at = pa.array(np.arange(DIMENSIONS, dtype=np.int32))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * DIMENSIONS), "at": at, "value": pa.array(own)})

    rows = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).where(
        F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()
    )
    parts = rows.mapInArrow(add, "lang string, at int, value long")
    added = parts.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    model: dict[str, np.ndarray] = {}
    for row in added.collect():  # languages x DIMENSIONS
        model.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["at"]] = row["value"]
    return dict(sorted(model.items()))


def identify(text: Column | str, model: dict[str, np.ndarray]) -> Column:
    """Struct ``(lang_pred, score)`` of a text column.

    ``score`` is the cosine with the language's prototype, cut to 0..1. A null text, a text without a letter and an
    empty model give ``und`` and 0. Ties go to the first language in order.
    """
    names = list(model)
    matrix = np.array([v / max(np.linalg.norm(v), 1e-12) for v in model.values()]).reshape(len(names), DIMENSIONS)
    centre = matrix.mean(0) if len(names) > 1 else np.zeros(DIMENSIONS)
    own = matrix - centre
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    direction = centre / max(np.linalg.norm(centre), 1e-12)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for item in texts:
            text = item.as_py()
            codes = trigrams(text) if text and names else ()
            if not len(codes):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            vector = bundle(*np.unique(codes, return_counts=True)).astype(np.float32)
            near = own @ (vector - (vector @ direction) * direction)
            best = int(np.argmax(near))
            langs.append(names[best])
            length = float(np.linalg.norm(vector))
            scores.append(min(1.0, max(0.0, float(matrix[best] @ vector) / length)) if length else 0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(F.col(text) if isinstance(text, str) else text)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
