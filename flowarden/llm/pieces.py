"""SentencePiece encoding and decoding of merge-type (BPE) models by a prefix table.

1. A merge-type encoding is right exactly if every two neighbouring tokens are what their own joined text encodes to.
   So the last token of a prefix is unique: among the vocabulary's matches that end there (an Aho-Corasick automaton
   finds them), the one that is compatible with the last token of the prefix before it.
2. Two tokens are compatible if no merge across their border comes before the merges that made them. Both are taken
   apart from the outside in, the later made first; each state must hold no pair across the border that would have
   been merged earlier. Equal ranks merge from left to right. Answers are kept in a bounded table.
3. The ids are read backwards from the table of last tokens, so a text of n characters takes time in proportion to n,
   also without any white space.
4. Texts are cut where the vocabulary proves that no token can cross: around characters that no longer token holds, and
   before white space if no token holds it after another character. Pieces met before come from a bounded table.

Only normalisation (the model's own rules) is asked of the library; its ``encode`` and ``decode`` serve the tests.
"""

from __future__ import annotations

import codecs
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NO_TEXT_BYTES = re.compile("[\udc80-\udcff]")
CONTROL = "\ud800"  # stands for a control id until bytes are joined: none are joined across it
LEADING = re.compile(f"^({CONTROL}*){SPACE}")
KEPT_PIECES = 450_000  # texts of at most KEPT_CHARS whose ids a worker remembers
KEPT_CHARS = 32
KEPT_PAIRS = 1_000_000
HEAD = 7  # characters of a beginning whose table is kept
KEPT_HEADS = 150_000


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("flowarden_each_byte", _each_byte)


class PieceTable(dict):
    """The vocabulary of a merge-type model with byte fallback; as a dictionary: ids (as bytes) of text pieces met before."""

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.normalize, self.end_id = model.normalize, model.eos_id()
        self.leading = model.normalize("a").startswith(SPACE)
        of_byte = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
        if len(of_byte) < 256 or any(map(model.is_unused, range(size))):
            raise ValueError("needs a model with byte fallback and without unused pieces")
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(size)]
        plain = [i for i in range(size) if not special[i]]
        self.surface = [n if not s else CONTROL for n, s in zip(names, special)]
        self.surface[model.unk_id()] = " ⁇ "
        for b, i in of_byte.items():  # bytes above 127 wait as lone surrogates until their character is whole
            self.surface[i] = bytes([b]).decode("utf-8", "surrogateescape")
        self._learn(names, plain, {i: -model.get_score(i) for i in plain})
        self.bytes_of = lambda c: [of_byte[b] for b in c.encode()]

    def _learn(self, names: list[str], plain: list[int], cost: dict[int, float]) -> None:
        """Ranks, the last merge of every token that encodes to itself, and the automaton over these."""
        joined = {c for i in plain if len(names[i]) > 1 for c in names[i]}
        token = {names[i]: i for i in plain if len(names[i]) == 1}
        single = [c for c in sorted(joined) if c not in token]  # characters that only longer tokens hold
        token |= {c: len(names) + k for k, c in enumerate(single)}
        self.nameless = bool(single)
        self.texts = dict(enumerate(names + single))
        self.size = len(self.texts)
        steps = {c: r for r, c in enumerate(sorted(set(cost.values())))}
        self.rank, self.left, self.right, self.made, self.pairs = [-1] * self.size, {}, {}, {}, {}
        longer = sorted((i for i in plain if len(names[i]) > 1), key=lambda i: (cost[i], len(names[i]), i))
        for i in longer:
            text = names[i]
            for cut in range(1, len(text)):
                a, b = token.get(text[:cut]), token.get(text[cut:])
                if a is not None and b is not None and self._compatible(a, b):
                    self.rank[i], self.left[i], self.right[i] = steps[cost[i]], a, b
                    token[text] = i
                    self.made[a * self.size + b] = i
                    break
        self.pairs.clear()
        self._grow(token)
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", names[i]) for i in longer)
        run = "".join(map(re.escape, sorted(joined - {SPACE})))
        inner = f"[{SPACE}{run}]+" if crossing else f"{SPACE}*[{run}]+|{SPACE}+"
        self.cut = re.compile(f"{inner}|." if joined else ".", re.S).findall

    def _grow(self, token: dict[str, int]) -> None:
        """Aho-Corasick automaton: steps by character, the longest suffix that is a state too, tokens that end there (longest first, the one of one character apart)."""
        self.width = [len(self.texts[i]) for i in range(self.size)]
        self.step: list[dict[str, int]] = [{}]
        self.fail, ending = [0], [()]
        for text, i in token.items():
            state = 0
            for c in text:
                state = self.step[state].setdefault(c, len(self.step))
                if state == len(self.step):
                    self.step.append({})
                    self.fail.append(0)
                    ending.append(())
            ending[state] = (i,)
        queue = list(self.step[0].values())
        for state in queue:
            for c, child in self.step[state].items():
                back = self.fail[state]
                while back and c not in self.step[back]:
                    back = self.fail[back]
                self.fail[child] = self.step[back].get(c, 0)
                queue.append(child)
            ending[state] += ending[self.fail[state]]
        # every text ends in a token of one character, the shortest of all
        self.longer, self.single = [e[:-1] for e in ending], [e[-1] if e else -1 for e in ending]
        self.heads: dict[str, tuple[tuple[int, ...], int]] = {}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the border between two tokens survives when their joined text is encoded."""
        rank, made = self.rank, self.made
        earlier_than = len(self.texts)
        while True:
            across = made.get(a * self.size + b)
            if across is not None and rank[across] < earlier_than:
                return False
            if rank[b] >= rank[a]:
                if rank[b] < 0:
                    return True
                earlier_than, b = rank[b] + 1, self.left[b]  # of equal ranks the pair across, further left, comes first
            else:
                earlier_than, a = rank[a], self.right[a]

    def _tokens(self, piece: str) -> list[int]:
        """Tokens of a text whose characters are all known; tables of beginnings are shared by all texts that begin so."""
        step, fail, longer, single, width, pairs, size = self.step, self.fail, self.longer, self.single, self.width, self.pairs, self.size
        head = piece[:HEAD]
        known = self.heads.get(head)
        last, state = ([], 0) if known is None else (list(known[0]), known[1])
        for end in range(len(last), len(piece)):
            if end == HEAD and known is None:
                if len(self.heads) >= KEPT_HEADS:
                    self.heads.clear()
                self.heads[head] = (tuple(last), state)
            c = piece[end]
            after = step[state].get(c)
            while after is None:
                state = fail[state]
                after = step[state].get(c)
            state = after
            for token in longer[state]:
                before = end - width[token]
                if before < 0:
                    break
                key = last[before] * size + token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= KEPT_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self._compatible(last[before], token)
                if fits:
                    break
            else:
                token = single[state]  # some token always fits, and no other did
            last.append(token)
        out, at = [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= width[last[at]]
        return out[::-1]

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            if len(piece) == 1 and piece not in self.step[0]:
                ids = self.bytes_of(piece)
            else:
                ids = self._tokens(piece)
                if self.nameless and max(ids) >= len(self.surface):
                    ids = [j for i in ids for j in (self.bytes_of(self.texts[i]) if i >= len(self.surface) else (i,))]
            packed = array("i", ids).tobytes()
            if len(piece) > KEPT_CHARS:
                return packed
        if len(self) >= KEPT_PIECES:  # what was not met again since the last time goes
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit integers."""
        return b"".join(map(self.__getitem__, self.cut(self.normalize(text))))

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that make no character become U+FFFD one by one."""
        text = "".join(map(self.surface.__getitem__, ids))
        if self.leading:
            text = LEADING.sub(r"\1", text)
        text = text.replace(SPACE, " ")
        if NO_TEXT_BYTES.search(text):
            parts = (part.encode("utf-8", "surrogateescape") for part in text.split(CONTROL))
            return "".join(part.decode("utf-8", "flowarden_each_byte") for part in parts)
        return text.replace(CONTROL, "")


@lru_cache(1)
def piece_table(path: str | None) -> PieceTable:
    """One table for all tasks of a worker process."""
    import public_tokenizers

    return PieceTable(path or public_tokenizers.path(MODEL))


def encode(text: Column | str, model: str | None = None, end: bool = True) -> Column:
    """Ids (array of int) of a text column, closed by the model's end id if asked for. A null text is an empty one."""

    @F.arrow_udf("array<int>")
    def compute(texts: pa.Array) -> pa.Array:
        table = piece_table(model)
        closing = array("i", [table.end_id]).tobytes() if end else b""
        rows = [(table.encode(t.as_py()) if t.is_valid else b"") + closing for t in texts.cast(pa.large_string())]
        offsets = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    return compute(F.col(text) if isinstance(text, str) else text)


def decode(ids: Column | str, model: str | None = None) -> Column:
    """Text of an array of ids; null ids are passed over, a null array gives null. An id outside the vocabulary is an error."""

    @F.arrow_udf("string")
    def compute(rows: pa.Array) -> pa.Array:
        table = piece_table(model)
        texts = []
        for row in rows:
            known = row.values.drop_null().to_numpy(zero_copy_only=False).tolist() if row.is_valid else None
            if known and min(known) < 0:
                raise IndexError(f"no piece has the id {min(known)}")
            texts.append(None if known is None else table.decode(known))
        return pa.array(texts, pa.string())

    return compute(F.col(ids) if isinstance(ids, str) else ids)
