"""Operator 8. Language-model scoring by deleted interpolation.

P(w | v) = a2 c(v w) / c(v) + a1 c(w) / N + a0 / (V + 1); the weights a depend on the bucket
(power of two) of the context's count c(v). They are learned by expectation-maximisation: a
part of the training documents is held out, and the weights maximise the likelihood of the
held-out counts under estimates from the rest. Scores then use the counts of all training
documents. A text's first context is its begin; its last token is the end.

How counts meet texts: documents are dealt into blocks of bounded size. A block sends its
distinct unigrams and bigrams, sorted, with its counts, cut by ranges of the key. A range adds
up its blocks' counts and answers each block in the order of its keys. The block looks up its
tokens in the answer. So a frequent word is one entry of a block and never a hot key; what is
moved is at most one entry a distinct n-gram and block, and no task holds the whole model.
Counts per token are stored packed; EM and scoring read them, not the texts.

Ranges add up ``GROUP`` blocks at most. Of more blocks, the ranges of a group do as blocks do: they
send what they added up to ranges of ``GROUP`` groups, and so on, and answers go back the same way.
So a block or range sends at most ``GROUP`` pieces, and pieces grow in line with the corpus.

Results: null and empty texts have one token, the end; a null id is in the training part;
repeated rows are each scored, and count each time; without training documents all words are
unknown; an empty table gives an empty result; ids are whole numbers (text ids that are not
raise an error); only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, forget, stored

#: Text of a block, and blocks for each range of keys: a range holds as many entries as two
#: blocks do, so both fit a worker, and there are half as many ranges as blocks.
BLOCK_BYTES = 10_000_000
RANGE_BLOCKS = 2
#: Blocks, or groups of them, whose counts one set of ranges adds up; rows of partial totals.
GROUP, TOTALS = 4096, 256
WORDS_KEPT = 300_000
#: A key is 56 bits of a hash; the byte below tells its kind.
UNIGRAM, BIGRAM, BEGIN = 0, 1, 2
HIGH = np.uint64(0xFFFFFFFFFFFFFF00)
END_KEY = np.uint64(xxhash.xxh64_intdigest(b"\x00end")) & HIGH
BEGIN_KEY = np.uint64(xxhash.xxh64_intdigest(b"\x00begin")) & HIGH | np.uint64(BEGIN)
#: Held-out counts are gathered on a grid: buckets x STEPS steps an octave of both ratios.
STEPS, BUCKETS = 8, 40
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class WordKeys(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) & int(HIGH)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    v = np.ascontiguousarray(values, "<u8")
    return pa.compress(v.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def expand(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, n * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


class Block:
    """Tokens of a block of texts as keys: unigrams, and bigrams with the context before."""

    def __init__(self, texts: list[str | None]):
        keys = WordKeys()
        words = [(t or "").encode().translate(_FOLD).split() for t in texts]
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64)
        flat = np.fromiter((k for w in words for k in (*map(keys.__getitem__, w), int(END_KEY))), np.uint64, int(self.lengths.sum()))
        context = np.r_[BEGIN_KEY, flat[:-1]].astype(np.uint64)
        context[self.starts] = BEGIN_KEY
        pair = _mixed(_mixed(context) + flat) & HIGH | np.uint64(BIGRAM)
        every = np.concatenate([flat, pair, np.full(len(texts), BEGIN_KEY, np.uint64)])
        self.keys, at = np.unique(every, return_inverse=True)
        n = len(flat)
        self.word, self.pair, self.begin = at[:n], at[n : 2 * n], at[2 * n :]

    def counts(self, documents: np.ndarray) -> np.ndarray:
        """How often each key occurs in the documents of the mask."""
        token = np.repeat(documents, self.lengths)
        out = np.bincount(self.word[token], minlength=len(self.keys)) + np.bincount(self.pair[token], minlength=len(self.keys))
        return out + np.bincount(self.begin[documents], minlength=len(self.keys))


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def level_ranges(blocks: int) -> list[int]:
    """Ranges of a group on each level, until one group holds all blocks."""
    out, held = [], 1
    while not out or held < blocks:
        held *= GROUP
        out.append(max(4, -(-min(blocks, held) // RANGE_BLOCKS)))
    return out


PIECE = "part long, block long, n long, keys binary, counts binary"


def _pieces(keys: np.ndarray, counts: np.ndarray, ranges: int, group: int, sender: int) -> pa.Table:
    """Sorted keys and their two counts, cut by the ranges of a group."""
    cuts = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
    out = []
    for p in np.flatnonzero(np.diff(cuts)):
        i, j = int(cuts[p]), int(cuts[p + 1])
        k = keys[i:j]
        out.append((group * ranges + int(p), sender, j - i, squeeze(np.diff(k, prepend=np.uint64(0))), squeeze(counts[:, i:j].ravel())))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    cols = list(zip(*out, strict=True)) or [()] * 5
    return pa.table([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["part", "block", "n", "keys", "counts"])


def _merged_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a range's pieces, and where each piece's keys are among them."""
    n = table.column("n").to_pylist()
    keys = np.concatenate([np.cumsum(expand(k, m)) for k, m in zip(table.column("keys").to_pylist(), n, strict=True)])
    return np.unique(keys, return_inverse=True)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_merged_keys``, and both counts added up."""
    distinct, at = _merged_keys(table)
    n = table.column("n").to_pylist()
    counts = np.concatenate([expand(c, 2 * m).reshape(2, m) for c, m in zip(table.column("counts").to_pylist(), n, strict=True)], axis=1)
    return distinct, at, np.stack([np.bincount(at, weights=c, minlength=len(distinct)).astype(np.int64) for c in counts])


def _answers(table: pa.Table, at: np.ndarray, total: np.ndarray) -> pa.Table:
    """The totals for each piece's sender, in the order of its keys."""
    n = table.column("n").to_pylist()
    ends = np.cumsum(n)[:-1]
    out = [squeeze(np.concatenate(x)) for x in zip(*(np.split(t[at], ends) for t in total), strict=True)]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "n": table.column("n"), "total": pa.array(out, pa.binary())})


def _in_order(answers: pa.Table) -> np.ndarray:
    """Totals for one sender from all its ranges: (2 x keys)."""
    order = np.argsort(answers.column("part").to_numpy())
    n, data = answers.column("n").to_pylist(), answers.column("total").to_pylist()
    return np.concatenate([expand(data[i], 2 * n[i]).reshape(2, n[i]) for i in order], axis=1)


def token_counts(docs: DataFrame, modulus: int, held: int, doc_id: str, text: str) -> tuple[DataFrame, dict]:
    """Stored (doc_id, held_out, em, n, counts), and the totals.

    ``counts``: c(w) of the n tokens, c(v w), and for documents of the EM part the same
    without that part. Totals: tokens, types and documents of all training and without it.
    """
    kind = docs.schema[doc_id].dataType
    mod = F.coalesce(crc_mod(doc_id, modulus), F.lit(0))
    size = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    blocks = max(1, -(-(size[0] or 0) // BLOCK_BYTES), -(-size[1] // 100_000))
    levels = level_ranges(blocks)
    # ids decide the block; the text does where ids are few or missing
    block = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(blocks))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), mod.cast("int").alias("mod"), block.alias("block"))

    def masks(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        m = table.column("mod").to_numpy()
        return m != 2, (m != 2) & (m != held)

    def ask(table: pa.Table) -> pa.Table:
        b = Block(table.column("text").to_pylist())
        train, rest = masks(table)
        of_all = b.counts(train)
        number = table.column("block")[0].as_py()
        return _pieces(b.keys, np.stack([of_all, of_all - b.counts(rest)]), levels[0], number // GROUP, number)

    def send_on(level: int):
        def send(table: pa.Table) -> pa.Table:
            keys, _, total = _merged(table)
            part = table.column("part")[0].as_py()
            return _pieces(keys, total, levels[level], part // levels[level - 1] // GROUP, part)

        return send

    def answer(table: pa.Table) -> pa.Table:
        distinct, at, total = _merged(table)
        word, begin = distinct & np.uint64(255) == UNIGRAM, distinct == BEGIN_KEY
        without = [total[0], total[0] - total[1]]
        stats = np.array([x for t in without for x in (t[word].sum(), (t[word] > 0).sum(), t[begin].sum())])
        part = table.column("part")[0].as_py()
        row = pa.table({"block": [-1 - part % TOTALS], "part": [part], "n": [3], "total": pa.array([squeeze(stats)], pa.binary())})
        return pa.concat_tables([_answers(table, at, total), row])

    def hand_down(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        if pieces.num_rows == 0:  # totals pass
            return answers.select(["block", "part", "n", "total"])
        return _answers(pieces, _merged_keys(pieces)[1], _in_order(answers))

    def look_up(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if texts.num_rows == 0:  # totals of some of the ranges
            sums = sum(expand(x, 6).astype(np.int64) for x in answers.column("total").to_pylist())
            return pa.table([pa.nulls(1, pa.int64()), pa.array([-1]), pa.array([6]), pa.array([squeeze(sums)], pa.binary())], ["doc_id", "mod", "n", "counts"])
        b = Block(texts.column("text").to_pylist())
        total = _in_order(answers)
        total[1] = total[0] - total[1]
        mod_ = texts.column("mod").to_numpy()
        out = []
        for m, i, k in zip(mod_, b.starts, b.lengths, strict=True):
            rows = [total[0][b.word[i : i + k]], total[0][b.pair[i : i + k]]]
            if m == held:
                rows += [total[1][b.word[i : i + k]], total[1][b.pair[i : i + k]]]
            out.append(squeeze(np.concatenate(rows)))
        return pa.table([texts.column("doc_id").cast(pa.int64()), pa.array(mod_, pa.int64()), pa.array(b.lengths), pa.array(out, pa.binary())], ["doc_id", "mod", "n", "counts"])

    by_block = d.groupBy("block")
    asked = [by_block.applyInArrow(ask, PIECE)]
    for level in range(1, len(levels)):
        asked[-1] = stored(asked[-1], "pieces")  # sent on now, and read again by the answers
        asked.append(asked[-1].groupBy("part").applyInArrow(send_on(level), PIECE))
    reply = "block long, part long, n long, total binary"
    answers = asked.pop().groupBy("part").applyInArrow(answer, reply)
    for pieces in reversed(asked):
        answers = pieces.groupBy("part").cogroup(answers.groupBy("block")).applyInArrow(hand_down, reply)
    found = by_block.cogroup(answers.groupBy("block")).applyInArrow(look_up, "doc_id long, mod long, n long, counts binary")
    table = stored(found, "counts")
    for pieces in asked:
        forget(pieces)
    got = table.where("mod = -1").select("counts").collect()  # TOTALS rows at most
    sums = [sum(x) for x in zip(*(expand(r[0], 6).astype(np.int64).tolist() for r in got), strict=True)] or [0] * 6
    names = ("tokens", "types", "documents")
    totals = {"all": dict(zip(names, sums[:3], strict=True)), "rest": dict(zip(names, sums[3:], strict=True))}
    return table.where("mod >= 0").withColumn("doc_id", F.col("doc_id").cast(kind)), totals


def ratios(word: np.ndarray, pair: np.ndarray, totals: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each token's context, and its bigram and unigram estimates in units of 1 / (V + 1)."""
    context = np.r_[totals["documents"], word[:-1]].astype(float)
    bucket = np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)
    scale = totals["types"] + 1
    return bucket, pair / np.maximum(context, 1) * scale, word / max(totals["tokens"], 1) * scale


def held_out_grid(table: DataFrame, totals: dict, held: int) -> DataFrame:
    """(bucket, r2, r1, n): held-out tokens by bucket and rounded logarithms of both ratios."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, _, word, pair = expand(data, 4 * n).reshape(4, n)
                b, *r = ratios(word.astype(float), pair.astype(float), totals)
                q = [np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-30)) * STEPS), -32768).astype(np.int64) for x in r]
                cells.append(np.stack([b, *q], axis=1))
            if cells:
                cell, count = np.unique(np.concatenate(cells), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell[:, 0]), pa.array(cell[:, 1]), pa.array(cell[:, 2]), pa.array(count)], ["bucket", "r2", "r1", "n"])

    return table.where(F.col("mod") == held).select("n", "counts").mapInArrow(gather, "bucket long, r2 long, r1 long, n long").groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n"))


def learn_weights(grid: list[tuple[int, int, int, int]], rounds: int = 200) -> np.ndarray:
    """EM: (BUCKETS x 3) weights of bigram, unigram and uniform estimate for each bucket."""
    weights = np.tile(np.array([0.4, 0.4, 0.2]), (BUCKETS, 1))
    if not grid:
        return weights
    g = np.array(grid, float)
    ratio = np.where(g[:, 1:3] <= -32768, 0.0, 2.0 ** (g[:, 1:3] / STEPS))
    part = np.concatenate([ratio, np.ones((len(g), 1))], axis=1)
    bucket, n = g[:, 0].astype(np.int64), g[:, 3]

    def em(part: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            share = part * w
            new = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        return w

    overall = em(part, n)
    # a little of the weights of all buckets, so that none is exactly 0 or without data
    for b in range(BUCKETS):
        own = bucket == b
        m = n[own].sum()
        w = em(part[own], n[own]) if own.any() else overall
        weights[b] = (m * w + 5 * overall + 1 / 3) / (m + 6)
    # after a context never seen the bigram estimate is 0: its weight goes to the others
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Documents whose crc32(id) mod ``modulus`` is 2 are never learned from; those where it is
    ``held`` are the held-out part of EM.
    """
    kind = docs.schema[doc_id].dataType
    table, totals = token_counts(docs, modulus, held, doc_id, text)
    grid = [tuple(r) for r in held_out_grid(table, totals["rest"], held).collect()]  # bounded by the grid
    weights = learn_weights(grid)
    every = totals["all"]
    floor = math.log10(every["types"] + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m, n, data in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                word, pair = expand(data, (4 if m == held else 2) * n).reshape(-1, n)[:2].astype(float)
                base = np.log10((word + 1) / (every["tokens"] + every["types"] + 1)).sum()
                b, r2, r1 = ratios(word, pair, every)
                w = weights[np.minimum(b, BUCKETS - 1)]
                p = np.log10(w[:, 0] * r2 + w[:, 1] * r1 + w[:, 2]).sum() - n * floor
                out.append((m == 2, n, int((word > 0).sum()), every["tokens"], float(base), float(p)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], [f.name for f in schema])

    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    return table.select("doc_id", "mod", "n", "counts").mapInArrow(score, schema)
