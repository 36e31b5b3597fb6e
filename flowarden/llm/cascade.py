"""Quality rules as a short-circuit cascade.

A rule gives True for a text it rejects. On a bounded sample (``SAMPLE_ROWS`` expected rows, of which those that fail the
base rule are left out, as the cascade does) every rule is timed and its rejections are counted; the cascade then runs the rules in order of
rejections per second, and a text's first rejection ends its run. The verdict is "no rule rejects", so the order
decides about time only: results do not depend on the sample or its timings.

The base figures of a text (words, symbols, repeated lines, words in repeated windows) are computed for every row,
since they are part of the result; rules share them and whatever else they derive from the same text.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SAMPLE_ROWS = 2000
SEED = 20240606
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\x0b\x0c\r"
_SYMBOL_BYTES = SYMBOLS.encode()
_SPACES = dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")


class Text:
    """One whole text and what rules share about it. A null text is an empty one."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return [w for w in self.text.translate(_SPACES).split(" ") if w]

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        data = self.text.encode("utf-8", "surrogatepass")
        return len(data) - len(data.translate(None, _SYMBOL_BYTES))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        return [line for line in self.text.split("\n") if line.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of ``WINDOW_WORDS`` words found at least twice."""
        n = len(self.words) - WINDOW_WORDS + 1
        if n < 2:
            return 0
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in self.words])
        # windows numbered by doubling (1, 2, 4, 8 words), exactly: a pair of numbers gets a number of its own
        width = 1
        while width < WINDOW_WORDS:
            pairs = ids[:-width] * (ids.max() + 1) + ids[width:]
            ids = np.unique(pairs, return_inverse=True)[1]
            width *= 2
        again = np.flatnonzero(np.bincount(ids)[ids] > 1)
        edges = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edges, again, 1)
        np.add.at(edges, again + WINDOW_WORDS, -1)
        return int((np.cumsum(edges) > 0).sum())

    @property
    def base_failed(self) -> bool:
        return len(self.words) < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED_PERCENT * len(self.words)


# ---- rules: True rejects -------------------------------------------------------------------------------
def word_length(t: Text) -> bool:
    """Mean word length outside 2..20 characters."""
    return not 2 * len(t.words) <= t.word_chars <= 20 * len(t.words)


def symbols(t: Text) -> bool:
    """More than one symbol to two words."""
    return 2 * t.n_symbols > len(t.words)


def repeated_lines(t: Text) -> bool:
    """More than half of the lines repeat an earlier one."""
    return 2 * t.n_dup_lines > len(t.lines)


def few_letters(t: Text) -> bool:
    """Under 60 % of the words hold a letter."""
    return 10 * sum(any(map(str.isalpha, w)) for w in t.words) < 6 * len(t.words)


def upper_case(t: Text) -> bool:
    """Over 60 % of the words are written in capitals (two letters at least)."""
    return 10 * sum(len(w) > 1 and w.isupper() for w in t.words) > 6 * len(t.words)


def one_word(t: Text) -> bool:
    """A single word makes up over 30 % of the text."""
    return 10 * max(Counter(t.words).values(), default=0) > 3 * len(t.words)


def cut_lines(t: Text) -> bool:
    """Over 30 % of the lines end in an ellipsis."""
    return 10 * sum(line.rstrip(BLANKS).endswith(("...", "…")) for line in t.lines) > 3 * len(t.lines)


def bullets(t: Text) -> bool:
    """Over 90 % of the lines begin with a bullet."""
    return 10 * sum(line.lstrip(BLANKS)[0] in "-*•‣·" for line in t.lines) > 9 * len(t.lines)


RULES: tuple[Callable[[Text], bool], ...] = (word_length, symbols, repeated_lines, few_letters, upper_case, one_word, cut_lines, bullets)


# ---- the cascade ---------------------------------------------------------------------------------------
def measure(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """For each rule, seconds and share of rejections on the sampled rows that pass the base rule. None of them: zeros.

    About ``sample_rows`` rows are drawn one by one, so neither null nor frequent ids crowd the sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, rows = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if Text(text).base_failed:
                    continue
                rows += 1
                for i, rule in enumerate(rules):
                    own = Text(text)
                    own.words, own.lines, own.word_chars, own.n_symbols, own.n_dup_lines  # shared figures exist anyway
                    start = time.perf_counter()
                    rejected[i] += rule(own)
                    seconds[i] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict({"rule": pa.array(range(len(rules)), pa.int32()), "seconds": pa.array(seconds), "rejected": pa.array(rejected), "rows": pa.array([rows] * len(rules), pa.int64())})

    share = min(1.0, sample_rows / max(1, docs.count()))
    picked = docs.select(F.col(text_col).cast("string").alias("text")).where(F.rand(SEED) < share)
    parts = picked.mapInArrow(run, "rule int, seconds double, rejected long, rows long")
    got = {r["rule"]: r for r in parts.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("k"), F.sum("rows").alias("n")).collect()}
    return {rule.__name__: (got[i]["s"] / max(1, got[i]["n"]), got[i]["k"] / max(1, got[i]["n"])) if i in got else (0.0, 0.0) for i, rule in enumerate(rules)}


def ordered_rules(measured: dict[str, tuple[float, float]], rules=RULES) -> tuple:
    """Most rejections per second first; rules that reject nothing come last, cheapest first."""
    def merit(rule):
        seconds, share = measured[rule.__name__]
        return (-share / max(seconds, 1e-9), seconds)

    return tuple(sorted(rules, key=merit))


def assess(text: Column | str, rules=RULES) -> Column:
    """Struct of the base figures, ``base_failed``, ``kept`` and ``rejected_by`` (first rule, in the given order).

    Null and empty texts have no word and fail the base rule.
    """
    kind = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,kept:boolean,rejected_by:string>"

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            t = Text(text)
            failed = t.base_failed
            by = "base" if failed else next((rule.__name__ for rule in rules if rule(t)), None)
            rows.append((len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, by is None, by))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run(F.col(text) if isinstance(text, str) else text)


def quality(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, base figures and verdict of every row; ``rejected_by`` may differ between runs where several rules reject."""
    order = ordered_rules(measure(docs, rules, text_col), rules)
    return docs.select(F.col(id_col), assess(text_col, order).alias("q")).select(id_col, "q.*")
