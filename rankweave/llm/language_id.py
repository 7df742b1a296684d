"""Operator 10. Language identification by multilingual mixture inference.

Each language is a byte n-gram model (orders 1 to 4 of a word with its ends, hashed). A document's
words are drawn from a mixture of languages; expectation-maximisation estimates each
document's language proportions from the words' n-gram likelihoods. Then a set of languages
is selected: starting from the likeliest one, a language joins as long as the likelihood
gains more than the penalty. The prediction is the set's language of largest proportion.

The models are fitted on a bounded sample: about ``per_language`` documents of each language,
chosen by a hash of the id. Workers count the sample's n-grams; the driver gets the counts,
whose size depends on the number of languages only. All documents are predicted, on their
whole texts.

Results: null texts, empty ones and those without a letter are ``und`` with score 0; null
languages are not learned; without learned languages all are ``und``; a null id is neither
held out nor learned from; repeated rows are each predicted; an empty table gives an empty
result; only doc_id, text and lang are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, held_out

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Rounds of expectation-maximisation, and characters of text looked at at once.
ROUNDS = 12
SLICE = 1_000_000
#: A letter is of Unicode's category L; numerals such as U+00BD or U+2167 are none.
LETTER = regex.compile(r"\p{L}")
#: Bytes that are part of words: a-z and all of UTF-8 beyond ASCII; others become a space.
_WORDS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def grams(data: np.ndarray) -> np.ndarray:
    """Hashed n-grams that end at each byte, an order in each row; 0 stands before a word."""
    out = np.empty((len(ORDERS), len(data)), np.int64)
    space = data == 0x20
    acc = np.zeros(len(data), np.uint32)
    gone = np.zeros(len(data), bool)
    for k, order in enumerate(ORDERS):
        shifted = np.zeros(len(data), np.uint32)
        if order == 1:
            shifted[:] = data
        else:
            shifted[order - 1 :] = data[: len(data) - order + 1]
            shifted[gone] = 0
        acc = acc * np.uint32(0x01000193) + shifted + np.uint32(order)
        out[k] = (acc * np.uint32(0x9E3779B1)) >> np.uint32(16)
        # beyond the space before a word there is nothing
        before = np.zeros(len(data), bool)
        if order > 1:
            before[order - 1 :] = space[: len(data) - order + 1]
            before[: order - 1] = True
        gone = gone | before
    return out


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts' words, and where each text ends."""
    parts = [b" " + (t or "").lower().encode().translate(_WORDS) + b" " for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


class Languages:
    """Log-probabilities of n-grams in each language."""

    def __init__(self, names: list[str], counts: np.ndarray, documents: np.ndarray):
        self.names = names
        total = counts.sum(axis=1, keepdims=True)
        self.table = np.ascontiguousarray(np.log((counts + 0.05) / (total + 0.05 * BUCKETS)).T.astype(np.float32))  # BUCKETS x languages
        self.prior = (documents + 1) / (documents.sum() + len(names)) if len(names) else documents

    def word_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (words x languages), and each text's number of words."""
        data, ends = joined(texts)
        space = data == 0x20
        g = grams(data)
        first = np.flatnonzero(~space & np.r_[True, space[:-1]])
        n_words = np.diff(np.searchsorted(first, np.r_[0, ends]))
        if len(first) == 0:
            return np.zeros((0, len(self.names))), n_words
        out = np.zeros((len(first), len(self.names)))
        inside = ~space | np.r_[False, ~space[:-1]]  # a word's bytes and the space that ends it
        at = np.flatnonzero(inside)
        starts = np.searchsorted(at, first)
        for k in range(len(ORDERS)):
            out += np.add.reduceat(self.table[g[k][at]], starts, axis=0)
        return out / len(ORDERS), n_words

    def mixtures(self, scores: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EM proportions (texts x languages), and the chosen language's number (-1: no words)."""
        n, size = len(n_words), len(self.names)
        share = np.tile(self.prior, (n, 1))
        best = np.full(n, -1)
        some = np.flatnonzero(n_words)
        if len(some) == 0 or size == 0:
            return share, best
        starts = np.r_[0, np.cumsum(n_words[some])[:-1]].astype(np.int64)
        owner = np.repeat(np.arange(len(some)), n_words[some])
        top = scores.max(axis=1)
        like = np.exp(np.maximum(scores - top[:, None], -60))
        theta = np.tile(self.prior, (len(some), 1))
        for _ in range(ROUNDS):
            got = like * theta[owner]
            got /= got.sum(axis=1, keepdims=True)
            theta = np.add.reduceat(got, starts, axis=0) + 0.5 * self.prior
            theta /= theta.sum(axis=1, keepdims=True)
        share[some] = theta
        # penalised likelihood: log L of a set, less half log(words) for each language in it
        penalty = 0.5 * np.log(n_words[some] + 1.0)
        chosen = np.zeros((len(some), size), bool)
        alone = np.add.reduceat(scores, starts, axis=0) + np.log(self.prior)
        chosen[np.arange(len(some)), alone.argmax(axis=1)] = True
        now = alone.max(axis=1)
        for _ in range(size - 1):
            value = np.full((len(some), size), -np.inf)
            for j in range(size):
                sets = chosen.copy()
                sets[:, j] = True
                weight = theta * sets
                weight /= weight.sum(axis=1, keepdims=True)
                value[:, j] = np.add.reduceat(np.log((like * weight[owner]).sum(axis=1) + 1e-30) + top, starts)
            value[chosen] = -np.inf
            j, gain = value.argmax(axis=1), value.max(axis=1) - now
            joins = gain > penalty
            if not joins.any():
                break
            chosen[np.flatnonzero(joins), j[joins]] = True
            now = np.where(joins, value.max(axis=1), now)
        best[some] = np.where(chosen, theta, -1).argmax(axis=1)
        return share, best


def gram_counts(texts: list[str]) -> np.ndarray:
    data, _ = joined(texts)
    inside = (data != 0x20) | np.r_[False, data[:-1] != 0x20]
    return sum((np.bincount(g[inside], minlength=BUCKETS) for g in grams(data)), np.zeros(BUCKETS, np.int64))


def learn(docs: DataFrame, per_language: int, doc_id: str, text: str, lang: str) -> Languages:
    labelled = docs.where(F.coalesce(crc_mod(doc_id, 4) != 2, F.lit(False)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n"))
    # of a language with n documents each is taken with chance per_language / n
    chance = F.pmod(F.xxhash64("_id", F.lit(10)), F.lit(1 << 30)) < F.lit(float(per_language) * (1 << 30)) / F.col("_n")
    taken = labelled.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    sample = taken.join(F.broadcast(sizes), "_lang").where(chance).select("_lang", "_text")  # a row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, t in enumerate(batch.column(1)):
                one = found.setdefault(names[i], np.zeros(BUCKETS + 1, np.int64))
                one[:BUCKETS] += gram_counts([t.as_py()])
                one[BUCKETS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([c.tobytes() for c in found.values()], pa.binary())], ["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    counted = sample.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary")
    rows = sorted((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in counted.collect())
    counts = np.array([c for _, c in rows], float).reshape(-1, BUCKETS + 1)
    return Languages([name for name, _ in rows], counts[:, :BUCKETS], counts[:, BUCKETS])


def identify(docs: DataFrame, per_language: int = 400, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, langs) for each row; ``langs``: proportions by language."""
    spark = docs.sparkSession
    model = learn(docs, per_language, doc_id, text, lang)
    kind = docs.schema[doc_id].dataType
    names = model.names
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(2)
            pred, score, props = [], [], []
            at = 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and size < SLICE:
                    part.append(texts[at].as_py())
                    size += len(part[-1] or "")
                    at += 1
                share, best = m.mixtures(*m.word_scores(part))
                for t, s, b in zip(part, share, best, strict=True):
                    known = b >= 0 and LETTER.search(t) is not None
                    pred.append(names[b] if known else "und")
                    score.append(float(min(1.0, max(0.0, s[b]))) if known else 0.0)
                    props.append(s.tolist() if known else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(props, pa.list_(pa.float64()))],
                ["doc_id", "held_out", "lang_pred", "score", "langs"],
            )

    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("langs", T.ArrayType(T.DoubleType())),
    ])
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, 4).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, schema)
