"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

1. A word's letters are a binary vector: the k-th occurrence of a letter is one dimension. A replaced letter changes
   two dimensions, an inserted or deleted one changes one, so near words lie within a Hamming distance of two.
2. The dimensions are dealt to ``PARTS`` parts. Vectors that differ in at most two dimensions agree on all parts but
   two, so with every pair of parts left out once, some signature of both is equal; words of neighbouring lengths
   differ in one dimension and need every single part left out once. The length is part of a signature. Signatures are
   64-bit hashes of whole projections: equal ones of unlike projections only add candidates.
3. Signatures are joined by equality, and the join keeps what the edit distance verifies.
4. The chain of forms is followed by pointer doubling; counts grow five times with every step, so few rounds do.

Letters are dealt to parts in the order of their counts, which evens the parts out; any dealing gives the same result.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowarden.session import materialise

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP_EVERY = 199
LEAST_CHARS = 6
LEAST_COUNT = 5
FORM_FACTOR = 5
PARTS = 7
SAME, SHORTER, LONGER = 0, 1, 2


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """``(id, run)``: every run of letters of every whole text, of at least ``least`` code points, A-Z lower-cased."""
    found = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    return found.where(F.char_length("run") >= least).select("id", lowered.alias("run"))


def thinned(run: Column, seed: Column, every: int = DROP_EVERY) -> Column:
    """The run, or, if ``every`` divides the crc32 of ``seed:run``, the run without its code point at crc32 % length."""
    h = F.crc32(F.concat(seed, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, shorter).otherwise(run)


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` over all documents, with one letter taken out of a run now and then as a slip of the pen would.

    A null text has no word; a null id reads as an empty one. An empty table gives no row.
    """
    seed = F.coalesce(F.col("id").cast("string"), F.lit(""))
    words = runs(docs, id_col, text_col, least_chars).select(thinned(F.col("run"), seed).alias("word"))
    counted = words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


# ---- signatures ----------------------------------------------------------------------------------------
def letter_order(words: DataFrame) -> str:
    """The letters of the words by falling count: one short row per different letter."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    return "".join(r["letter"] for r in letters.orderBy(F.desc("count"), "letter").collect())


def signatures_of(word: str, place: dict[str, int], parts: int = PARTS) -> list[tuple[int, int]]:
    """(role, 64-bit signature) of one word: for words of its length, of one letter more, and of one letter less."""
    import xxhash

    seen: dict[str, int] = {}
    dealt: list[list[str]] = [[] for _ in range(parts)]
    for letter in word:
        k = seen[letter] = seen.get(letter, 0) + 1
        dealt[(place.get(letter, ord(letter)) + k) % parts].append(f"{letter}{k}")
    texts = [" ".join(sorted(part)) for part in dealt]

    def signature(kind: int, length: int, without: tuple[int, ...]) -> int:
        kept = "|".join(t for i, t in enumerate(texts) if i not in without)
        value = xxhash.xxh64_intdigest(f"{kind} {length} {without} {kept}")
        return value - (1 << 64) if value >> 63 else value

    one, two = [(i,) for i in range(parts)], combinations(range(parts), 2)
    out = [(SAME, signature(0, len(word), w)) for w in two]
    out += [(SHORTER, signature(1, len(word), w)) for w in one]
    return out + [(LONGER, signature(1, len(word) - 1, w)) for w in one]


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``(sig, role, word, n)``, one row per signature of every word."""
    place = {letter: i for i, letter in enumerate(letter_order(words))}

    @F.arrow_udf("array<struct<role:int,sig:long>>")
    def compute(texts: pa.Array) -> pa.Array:
        rows = [signatures_of(t.as_py(), place, parts) for t in texts]
        flat = [s for r in rows for s in r]
        made = pa.StructArray.from_arrays([pa.array([r for r, _ in flat], pa.int32()), pa.array([s for _, s in flat], pa.int64())], ["role", "sig"])
        offsets = [0]
        for r in rows:
            offsets.append(offsets[-1] + len(r))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)

    return words.select("word", "n", F.explode(compute("word")).alias("s")).select("s.sig", "s.role", "word", "n")


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``(word, n, near, near_n)``: every pair of different words one edit apart, in both directions.

    ``words`` (word, n) holds each word once. Candidates are bounded by nothing but equal signatures; the join is
    sort-merged and split where a signature is common.
    """
    held = materialise(signatures(words, parts), "signatures")
    a = held.where(F.col("role") != LONGER).select("sig", F.col("role").alias("ra"), F.col("word").alias("a"), F.col("n").alias("na"))
    b = held.where(F.col("role") != SHORTER).select(F.col("sig").alias("sig_b"), F.col("role").alias("rb"), F.col("word").alias("b"), F.col("n").alias("nb"))
    meets = ((F.col("ra") == SAME) & (F.col("rb") == SAME) & (F.col("a") < F.col("b"))) | ((F.col("ra") == SHORTER) & (F.col("rb") == LONGER))
    met = a.join(b, (F.col("sig") == F.col("sig_b")) & meets & (F.levenshtein("a", "b", 1) == 1))
    pairs = materialise(met.select("a", "na", "b", "nb").distinct(), "near-pairs")
    there = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n"))
    back = pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n"))
    return there.unionByName(back)


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for every word with a form (``word``, ``form``): where the chain of forms ends."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "chain")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(at.join(further, "root", "left").select("word", "root", "next"), "chain")
        if moved.where(F.col("next").isNotNull()).isEmpty():
            return at
        at = moved.select("word", F.coalesce("next", "root").alias("root"))


def group_variants(words: DataFrame, factor: int = FORM_FACTOR, parts: int = PARTS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every counted word.

    The form is the near word of the largest count (ties: first in code-point order) if it is ``factor`` times as
    frequent. ``words`` (word, n) holds each word once, as ``counted_words`` gives them. No word: no row.
    """
    best = near_words(words, parts).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "word", "left")
    is_form = F.col("form_n") >= factor * F.col("n")
    placed = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    placed = materialise(placed, "forms")
    ends = roots(placed.where(F.col("form").isNotNull()))
    return placed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants of the words of whole texts; see ``counted_words`` and ``group_variants``."""
    return group_variants(materialise(counted_words(docs, id_col, text_col), "words"))
