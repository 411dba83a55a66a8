"""Encoding texts with a public byte-level BPE vocabulary, in linear time.

Every byte is mapped to the Latin-1 character of the same number, so that an Aho-Corasick
automaton over strings finds the longest vocabulary entry at any place. A piece is encoded by
taking longest matches and backtracking where a token may not follow its neighbour: whether
two tokens may stand side by side is decided from the order of merges alone and remembered.
The first token sequence whose neighbours are all compatible is the one that merging in rank
order yields, so ids equal those of the reference encoders. Places known to lead nowhere are
marked, which bounds the work by the length of the piece times the longest prefix chain.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Place of the vocabulary file (a parameter everywhere).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts of ASCII characters alone, which have no other letters, numbers and spaces.
ASCII_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)

#: Remembered pieces and token pairs per Python worker; beyond it they are computed again.
MEMO = 1 << 18


class Encoder:
    """Encoder of one vocabulary, given as the bytes of its rank file."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.tokens = {base64.b64decode(t).decode("latin-1"): int(r) for t, r in pairs}
        self.text = {r: t for t, r in self.tokens.items()}
        self.widest = max(map(len, self.tokens))
        self.find = regex.compile(pattern).findall
        self.find_ascii = re.compile(ASCII_PATTERN).findall if pattern == PATTERN else self.find
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.tokens.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.shorter = {r: self._prefix(t) for r, t in self.text.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.part_memo: dict[str, list[int]] = {}
        for rank in sorted(self.text):
            self.halves[rank] = self._halves(rank)

    def _prefix(self, token: str) -> int | None:
        """The longest other vocabulary entry that the token starts with."""
        for end in range(len(token) - 1, 0, -1):
            rank = self.tokens.get(token[:end])
            if rank is not None:
                return rank
        return None

    def _halves(self, rank: int) -> tuple[int, int]:
        """The two tokens whose merge gives this one; a single byte is its own half."""
        token, left = self.text[rank], self.shorter[rank]
        while left is not None:
            right = self.tokens.get(token[len(self.text[left]) :])
            if right is not None and left < rank and right < rank and self._decide(left, right):
                self.merged[(left, right)] = rank
                return left, right
            left = self.shorter[left]
        return rank, rank

    def _decide(self, left: int, right: int) -> bool:
        """Whether merging in rank order can leave these two tokens side by side.

        Undoes the later of the merges on either side of the border, one by one; if at any
        time the tokens at the border would have merged before that merge, they may not.
        """
        limit = len(self.text) + 1
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < limit:
                return False
            if left > right:
                limit, inner = left, self.halves[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, self.halves[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, self.halves[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, self.halves[left][1]
                if inner == left:
                    return True
                left = inner

    def compatible(self, left: int, right: int) -> bool:
        """:meth:`_decide`, remembered."""
        key = (left, right)
        known = self.pair_memo.get(key)
        if known is None:
            if len(self.pair_memo) >= MEMO:
                self.pair_memo.clear()
            known = self.pair_memo[key] = self._decide(left, right)
        return known

    def longest(self, piece: str, at: int) -> int:
        """The longest vocabulary entry starting at ``at``."""
        for _, rank in self.automaton.iter_long(piece[at : at + self.widest]):
            return rank
        raise ValueError("the vocabulary lacks a byte")

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1 text."""
        whole = self.tokens.get(piece)
        return [whole] if whole is not None else self._backtrack(piece)

    def part(self, part: str) -> list[int]:
        """Ids of one part of a text, remembered."""
        known = self.part_memo.get(part)
        if known is None:
            known = self.piece(part if part.isascii() else part.encode("utf-8", "surrogatepass").decode("latin-1"))
            if len(part) <= 64:
                if len(self.part_memo) >= MEMO:
                    self.part_memo.clear()
                self.part_memo[part] = known
        return known

    def parts(self, text: str) -> list[str]:
        """A text cut by the pre-tokenisation pattern."""
        return self.find_ascii(text) if text.isascii() else self.find(text)

    def _backtrack(self, piece: str) -> list[int]:
        size = len(piece)
        dead = bytearray(size + 1)
        ids: list[int] = []
        at, token = 0, self.longest(piece, 0)
        while True:
            end = at + len(self.text[token])
            if not dead[end] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                at = end
                if at == size:
                    return ids
                token = self.longest(piece, at)
                continue
            shorter = self.shorter[token]
            while shorter is None:
                dead[at] = 1
                token = ids.pop()
                at -= len(self.text[token])
                shorter = self.shorter[token]
            token = shorter

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; a null or empty text gives none."""
        if not text:
            return []
        ids: list[int] = []
        part = self.part
        for one in self.parts(text):
            ids += part(one)
        return ids

    def count(self, text: str | None) -> int:
        """Number of ids of a text, without listing them."""
        if not text:
            return 0
        return sum(n * len(self.part(one)) for one, n in Counter(self.parts(text)).items())

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        return "".join(self.text[i] for i in ids).encode("latin-1").decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(ranks: bytes, pattern: str = PATTERN) -> Encoder:
    """The encoder of a rank file, built once per process."""
    return Encoder(ranks, pattern)


def _ranks(spark: SparkSession, path: str):
    """The rank file, read on the driver and broadcast: a vocabulary is below 2 MB whatever
    the corpus, and executors need no copy of the file."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 16 << 20:
        raise ValueError("this is no vocabulary file")
    return spark.sparkContext.broadcast(data)


def token_ids(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without ``text`` and with ``ids``, the token ids of each row's text.

    One row out for each row in, whatever repeats; null and empty texts give an empty list;
    text that looks like a special token is ordinary text. Other columns pass through, but for
    one named ``ids``, which the result replaces. A narrow, per-row operator: no shuffle at
    any size; whole texts, in Arrow batches that the engine bounds in bytes.
    """
    ranks = _ranks(docs.sparkSession, vocabulary)

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(ranks.value)
        for part in parts:
            yield pd.Series([enc.encode(t) for t in part], dtype=object)

    return docs.withColumn("ids", encode(F.col(text))).drop(text)


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without ``text`` and with ``n_tokens``, 0 for null and empty texts; a column of
    that name is replaced."""
    ranks = _ranks(docs.sparkSession, vocabulary)

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(ranks.value)
        for part in parts:
            yield part.map(enc.count).astype("int64")

    return docs.withColumn("n_tokens", count(F.col(text))).drop(text)
