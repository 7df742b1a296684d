"""Operator 1. Token counts by rank-synchronous array merging.

A batch's distinct pre-tokens are held as one ragged numpy array of symbols. In each step
every sequence finds its lowest-ranked pair, all sequences merge theirs at once, and the
loop ends when no sequence has a pair left. The count of a pre-token is the number of
symbols that survive. Pre-tokens recur, so each worker keeps the counts it has made.

Results: null and empty texts have 0 bytes and 0 tokens; ids may repeat or be null (one row
out for each row in); other columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values of the tokenizer format: its split pattern and its byte alphabet.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
#: Counts that a worker keeps; beyond it starts anew, so its memory is bounded.
CACHE = 400_000
#: Characters of distinct pre-tokens that are merged at once.
MERGE_CHARS = 1_000_000


class MergeTable:
    """Byte-level BPE merges as sorted arrays: pair code -> rank, rank -> new symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        vocab = model["vocab"]
        plain = {b for r in PRINTABLE for b in r}
        spare = iter(range(256, 512))
        self.byte_symbol = np.array([vocab[chr(b if b in plain else next(spare))] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        codes = np.array([vocab[x] * self.size + vocab[y] for x, y in pairs], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order.astype(np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], len(self.made))

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbol = self.byte_symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        result = lengths.copy()
        none = len(self.made)
        while len(symbol) > 1:
            rank = np.where(owner[:-1] == owner[1:], self.rank_of(symbol[:-1], symbol[1:]), none)
            least = np.full(len(pieces), none, np.int64)
            starts = np.flatnonzero(np.r_[True, owner[1:-1] != owner[:-2]]) if len(owner) > 2 else np.array([0])
            least[owner[:-1][starts]] = np.minimum.reduceat(rank, starts)
            hit = (rank < none) & (rank == least[owner[:-1]])
            at = np.flatnonzero(hit)
            if len(at) == 0:
                break
            # of pairs that overlap (a run of one symbol) every second one merges, from the left
            run = np.r_[True, np.diff(at) != 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            np.subtract.at(result, owner[at], 1)
            symbol, owner = symbol[keep], owner[keep]
            live = least[owner] < none  # a sequence without a pair is done
            symbol, owner = symbol[live], owner[live]
        return result


class Counter:
    """Counts the tokens of texts, keeping the counts of pre-tokens it has met."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, self.table.specials))) if self.table.specials else None
        self.kept: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special tokens stand between them."""
        if self.special is None or not self.special.search(text):
            return self.find(text), 0
        parts = self.special.split(text)
        return [x for p in parts for x in self.find(p)], len(parts) - 1

    def learn(self, new: list[str]) -> None:
        if len(self.kept) + len(new) > CACHE:
            self.kept.clear()
        begin = size = 0
        for i, x in enumerate(new):
            size += len(x)
            if size >= MERGE_CHARS or i == len(new) - 1:
                part = new[begin : i + 1]
                self.kept.update(zip(part, self.table.count([p.encode() for p in part]).tolist(), strict=True))
                begin, size = i + 1, 0

    def __call__(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        held: list[tuple[list[str], int]] = []
        chars = 0
        for i, text in enumerate(texts):
            held.append(self.pieces(text))
            chars += len(text)
            if chars > 2_000_000 or i == len(texts) - 1:
                met = set().union(*(p for p, _ in held))
                if len(self.kept) > CACHE:
                    self.kept.clear()
                new = [x for x in met if x not in self.kept]
                if len(self.kept) + len(new) > CACHE:
                    self.kept.clear()
                    new = list(met)
                self.learn(new)
                get = self.kept.__getitem__
                out += [sum(map(get, p)) + n for p, n in held]
                held, chars = [], 0
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; whole texts, no added tokens.

    ``tokenizer_path`` is read on the driver's machine and on each worker's; it is a file of
    the installed tokenizer package, not an input table.
    """
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            tokens = np.array(counter(texts), np.int64)
            size = np.array([len(x.encode()) for x in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])
    return docs.select(doc_id, text).mapInArrow(run, schema)
