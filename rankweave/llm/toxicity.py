"""Operator 3. Toxicity: a subsequence string-kernel support vector machine.

The kernel of two strings is the weighted count of subsequences they share: three letters
within five places, and four within six, decaying with the span, so gapped and inserted
characters cost little. It is approximated by Nystrom landmarks. The machine is trained on
labelled sentences as bags: a clean document's sentences hold no toxic string, a toxic one's
hold one at least: any string far more frequent in toxic documents than chance allows, else
the best-scoring one, chosen anew in each round. Near copies are learned from once. Clean
strings that score high in the first round become landmarks of the later ones. A sentence's score is that of its best string, a document's that of its best sentences, mapped
to a probability by a logistic curve.

A Nystrom machine is a weighted sum of landmark kernels, hence one weight for each hashed
subsequence. That vector is what workers use, so a string costs its own length only.

The machine is fitted on a bounded sample of labelled rows (``per_label`` documents of each
label, by a hash of the id) and, of those, on at most ``CLEAN_STRINGS`` strings of clean
documents and ``LANDMARKS`` + ``HARD`` landmarks; every document is scored on its whole text.
One task fits it, as the sample is bounded; the driver gets the weights only.

Results: null and empty texts have a score, the curve's value without any string, and
``without_toxic`` always keeps them; a null id is not held out and not learned from; labels
other than 0 and 1, and null ones, are not learned; without both labels all scores are below
1e-8; repeated rows are each scored; an empty table gives an empty result; only doc_id and
text (and doc_id and toxic of the labels) are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, held_out, in_pieces
from .near_dedup import WordHashes, bands, shingles, signature

BITS = 18
DECAY = 0.7
PATTERNS = [(0, *p) for n, span in ((3, 5), (4, 6)) for p in combinations(range(1, span), n - 1)]
#: Longer strings are looked at in pieces of so many letters, half of which overlap.
PIECE = 14
LANDMARKS, HARD = 192, 96
CLEAN_STRINGS = 12_000
KEPT = 300_000
SLICE = 1_000_000
#: Strings that are mapped, and rows that are solved for, at once; and numbers that are gathered for it.
TEXTS, CELLS = 2_048, 1_000_000
#: Margin from which a string counts as evidence of its own.
SURELY = 0.5
#: Log-odds from which on a string counts as toxic without a choice, if less than one string
#: of all would be so lopsided by chance.
PURE = 2.0
#: Log-odds that a document's best string must have at least.
LEAN = 1.0
SPACED = re.compile(r"(?:(?<=\s)|^)(?:\w\s){2,}\w(?=\s|$)")
SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")


def strings(token: str) -> list[str]:
    """What the kernel sees of a token: outer punctuation off, ends marked, cut in pieces."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    core = f"^{token[a:b]}$"
    if len(core) <= PIECE + 2:
        return [core]
    return [core[i : i + PIECE] for i in range(0, len(core) - PIECE // 2, PIECE // 2)]


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For texts of each length: their places, (texts x features) hashes, and the weights."""
    lengths = np.array([len(t) for t in texts])
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        if n < 3:
            yield places, np.zeros((len(places), 1), np.int64), np.zeros(1)
            continue
        code = np.array([texts[i] for i in places], dtype=f"U{n}").view(np.uint32).reshape(len(places), n)
        hashed, weight = [], []
        for p in PATTERNS:
            m = int(n) - p[-1]
            if m <= 0:
                continue
            h = np.full((len(places), m), len(p), np.uint32)
            for o in p:
                h = (h ^ code[:, o : o + m]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            hashed.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
            weight.append(np.full(m, DECAY ** (p[-1] + 1 - len(p))))
        yield places, np.concatenate(hashed, axis=1).astype(np.int64), np.concatenate(weight)


def lengths_of(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Length of each row's feature vector; equal features of a row (repeated letters) add up."""
    order = np.argsort(h, axis=1)
    ordered = np.take_along_axis(h, order, axis=1)
    first = np.ones(h.shape, bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    starts = np.flatnonzero(first)
    sums = np.add.reduceat(w[order].ravel(), starts)
    length = np.sqrt(np.bincount(starts // h.shape[1], sums * sums, len(h)))
    return np.where(length > 0, length, 1.0)


def kernel_sums(texts: list[str], vectors: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Normalised products of each text's feature vector with the columns of ``vectors``.

    ``place``: the row of ``vectors`` for each hashed feature (row 0: none); without it
    features are the rows.
    """
    out = np.zeros((len(texts), vectors.shape[1]))
    for begin in range(0, len(texts), TEXTS):
        for places, h, w in features(texts[begin : begin + TEXTS]):
            step = min(128, max(1, CELLS // (h.shape[1] * vectors.shape[1])))
            for at in range(0, len(places), step):
                rows = h[at : at + step]
                sums = w @ vectors[rows if place is None else place[rows]]  # (f) x (t, f, v)
                out[begin + places[at : at + step]] = sums / lengths_of(rows, w)[:, None]
    return out


def squared_hinge(x: np.ndarray | list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Linear SVM (L2 regularised, squared hinge) by Newton steps on the active rows; ``x``: rows, or parts of them."""
    parts = [p[at : at + TEXTS] for p in (x if isinstance(x, list) else [x]) for at in range(0, len(p), TEXTS)]
    ends = np.cumsum([len(p) for p in parts])[:-1]
    y, cost = np.split(y, ends), np.split(cost, ends)
    w = np.zeros(parts[0].shape[1])
    for _ in range(rounds):
        left, right = np.eye(len(w)), np.zeros(len(w))
        for p, label, each in zip(parts, y, cost, strict=True):
            active = label * (p @ w) < 1
            a = p[active]
            b = (a * each[active, None]).T
            left += b @ a
            right += b @ label[active]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


class Landmarks:
    """Nystrom map of strings by their kernels with the landmarks."""

    def __init__(self, texts: list[str]):
        texts = list(dict.fromkeys(texts))
        # only features of landmarks matter here: a row for each, and row 0 for all others
        parts = list(features(texts))
        self.used = np.unique(np.concatenate([h.ravel() for _, h, _ in parts]))
        self.place = np.zeros(1 << BITS, np.int32)
        self.place[self.used] = np.arange(1, len(self.used) + 1)
        self.vectors = np.zeros((len(self.used) + 1, len(texts)), np.float32)
        for places, h, w in parts:
            for i, row, length in zip(places, h, lengths_of(h, w), strict=True):
                np.add.at(self.vectors[:, i], self.place[row], w / length)
        self.vectors[0] = 0
        gram = kernel_sums(texts, self.vectors, self.place)
        value, base = np.linalg.eigh((gram + gram.T) / 2)
        good = value > 1e-6 * value.max()
        self.nystrom = base[:, good] / np.sqrt(value[good])

    def mapped(self, texts: list[str]) -> np.ndarray:
        out = np.ones((len(texts), self.nystrom.shape[1] + 1))
        for at in range(0, len(texts), TEXTS):
            out[at : at + TEXTS, :-1] = kernel_sums(texts[at : at + TEXTS], self.vectors, self.place) @ self.nystrom
        return out

    def weights(self, solved: np.ndarray) -> tuple[np.ndarray, float]:
        """A solution in the map as weights of hashed subsequences, and its bias."""
        out = np.zeros(1 << BITS)
        out[self.used] = (self.vectors @ (self.nystrom @ solved[:-1]).astype(np.float32))[1:]
        return out, float(solved[-1])


class Machine:
    """Trained weights of hashed subsequences, and the curve from margins to probabilities."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.weights, self.bias, self.curve = np.zeros(1 << BITS), -1.0, np.array([-20.0, 0.0, 0.0])
        if {y for _, y in rows} != {0, 1}:
            return
        rows = once(rows)
        seen, number = {1: Counter(), 0: Counter()}, Counter(y for _, y in rows)
        bags: list[list[str]] = []  # of toxic documents; of clean ones only counts are kept
        name: dict[str, str] = {}
        for text, y in rows:
            held = {name.setdefault(s, s) for x in self.tokens(text) for t in x for s in strings(t)}
            seen[y].update(held)
            if y == 1 and held:
                bags.append(sorted(held))
        toxic, clean = seen[1], seen[0]
        rate = {s: np.log((n + 0.3) / (number[1] + 1)) - np.log((clean[s] + 0.3) / (number[0] + 1)) for s, n in toxic.items()}
        telling = sorted(toxic, key=lambda s: (-rate[s] * np.sqrt(toxic[s]), s))
        usual = [s for s, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))]
        negatives = usual[: CLEAN_STRINGS // 2] + sorted(usual[CLEAN_STRINGS // 2 :], key=lambda s: hash_of(s))[: CLEAN_STRINGS // 2]
        # a mistake costs more on strings of many documents; 1 on average
        common = np.sqrt([clean[s] for s in negatives])
        common *= len(common) / max(common.sum(), 1.0)
        every = sorted({s for b in bags for s in b})
        number_of = {s: i for i, s in enumerate(every)}
        # strings far more frequent in toxic documents than chance allows are taken as they are
        pure = {s for s in every if rate[s] >= PURE and surprise(toxic[s], clean[s], number[1] / (number[0] + number[1])) > np.log(len(every))}
        space = Landmarks(telling[: LANDMARKS * 3 // 4] + usual[: LANDMARKS // 4])
        x0 = space.mapped(negatives)
        score, least = rate, -np.inf if not pure else np.inf
        for turn in range(4):
            # a document without such a string gives its best one, if that is on the toxic side
            witness: Counter = Counter()
            for b in bags:
                best = pure.intersection(b) or [max(b, key=lambda s: (score[s], s))]
                witness.update(s for s in best if s in pure or (score[s] > least and rate[s] >= LEAN))
            chosen = sorted(witness)
            many = np.array([witness[s] for s in chosen], float)
            y = np.r_[-np.ones(len(negatives)), np.ones(len(chosen))]
            cost = np.r_[common, many / max(many.sum(), 1.0) * len(negatives) / 2]
            self.weights, self.bias = space.weights(squared_hinge([x0, space.mapped(chosen)], y, cost))
            if turn == 0:
                # clean strings that look toxic become landmarks, so that they can be told apart
                look = np.maximum(self.margins(negatives) + 1, 0) * common
                hard = [negatives[i] for i in np.argsort(-look, kind="stable")[:HARD]]
                del space, x0  # one map at a time
                space = Landmarks(telling[: LANDMARKS * 3 // 4] + usual[: LANDMARKS // 4] + hard)
                x0 = space.mapped(negatives)
                continue
            margin = self.margins(every)
            # a string that clean documents hold as well tells less, whatever its letters
            score = {s: margin[i] + min(0.0, rate[s]) for s, i in number_of.items()}
            least = 0.0 if pure else -np.inf
        del space, x0, seen, toxic, clean, rate, score, name, bags, usual, telling
        evidence = self.evidence([t for t, _ in rows], {})
        label = np.array([y for _, y in rows], float)
        self.curve = logistic(evidence, label)

    @staticmethod
    def tokens(text: str) -> list[list[str]]:
        """Sentences as lists of tokens; letters set apart by single spaces are one token more."""
        low = text.lower()
        spaced = [m.group(0).replace(" ", "") for m in SPACED.finditer(low)]
        return [s.split() for s in SENTENCE.split(low)] + ([spaced] if spaced else [])

    def margins(self, texts: list[str]) -> np.ndarray:
        return kernel_sums(texts, self.weights[:, None])[:, 0] + self.bias if texts else np.zeros(0)

    def token_margins(self, tokens: list[str], kept: dict[str, float]) -> None:
        """Puts the margin of each token into ``kept``: the largest of its pieces."""
        pieces = [strings(t) for t in tokens]
        flat = [s for p in pieces for s in p]
        margin = self.margins(flat)
        starts = np.r_[0, np.cumsum([len(p) for p in pieces])[:-1]].astype(np.int64)
        kept.update(zip(tokens, np.maximum.reduceat(margin, starts).tolist(), strict=True))

    def evidence(self, texts: list[str], kept: dict[str, float]) -> np.ndarray:
        """Per text the largest margin, and how many strings are well on the toxic side (log).

        Sentences only part strings, so a text's best string is its best sentence's.
        """
        out = np.empty((len(texts), 2))
        begin = size = 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size < SLICE and end < len(texts):
                continue
            tokens = []
            for t in texts[begin:end]:
                low = t.lower()
                tokens.append(low.split())
                if SPACED.search(low):
                    tokens[-1] += [re.sub(r"\s", "", m.group(0)) for m in SPACED.finditer(low)]
            met = set().union(*tokens)
            if len(kept) > KEPT:
                kept.clear()
            if new := sorted(met - kept.keys()):
                self.token_margins(new, kept)
            get = kept.__getitem__
            for i, own in enumerate(tokens, begin):
                values = np.fromiter(map(get, own), float, len(own))
                out[i] = (values.max(), np.log1p((values > SURELY).sum())) if own else (-2.0, 0.0)
            begin, size = end, 0
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + evidence @ self.curve[1:], -30, 30)))


def once(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Rows less near copies of an earlier row with the same label, whose every word would look telling."""
    hashes, met, out = WordHashes(), {}, []
    for text, y in rows:
        held = shingles(text, 5, hashes)
        own = bands(signature(held)[None])[0].tolist() if len(held) else []
        places = [met.setdefault((y, k), set()) for k in (range(len(own)) if own else [-1])]
        if not any(v in place for v, place in zip(own or [0], places, strict=True)):
            out.append((text, y))
        for v, place in zip(own or [0], places, strict=True):
            place.add(v)
    return out


def surprise(toxic: int, clean: int, share: float) -> float:
    """Bound on -log of the chance that so many of a string's documents are toxic, ``share`` of all being so."""
    n = toxic + clean
    p = toxic / n
    if p <= share:
        return 0.0
    return n * (p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if clean else 0.0))


def hash_of(s: str) -> int:
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h * 2654435769 & 0xFFFFFFFF


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, per_label: int, doc_id: str, text: str, label: str) -> Machine:
    known = labels.where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False)) & F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    size = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    chance = F.lit(0.0)
    for y, n in size.items():
        chance = F.when(F.col("_y") == y, F.lit(per_label * float(1 << 30) / n)).otherwise(chance)
    # about 2 * per_label ids: bounded, so broadcast
    taken = F.broadcast(known.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 30)) < chance))
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(taken, "_id").where("_text is not null").select("_text", "_y")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(sorted(row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        weights = m.weights.astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([weights], pa.binary()), pa.array([m.bias]), pa.array([m.curve.tolist()])], ["weights", "bias", "curve"])

    machine = Machine([])
    for r in sample.repartition(1).mapInArrow(in_pieces(fit), "weights binary, bias double, curve array<double>").collect():
        machine.weights, machine.bias, machine.curve = np.frombuffer(r["weights"], np.float32), r["bias"], np.array(r["curve"])
    return machine


def scored(docs: DataFrame, machine: Machine, doc_id: str, text: str, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((machine.weights.astype(np.float32), machine.bias, machine.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine([])
        m.weights, m.bias, m.curve = shared.value
        kept: dict[str, float] = {}
        for batch in batches:
            texts = batch.column(2)
            p = m.probability(m.evidence([texts[i].as_py() or "" for i in range(len(texts))], kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
    ])
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, 4).alias("held_out"), F.col(text).alias("text")).mapInArrow(in_pieces(run), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, per_label: int = 1500, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    ``train_docs`` (default: ``docs``) are joined with ``labels`` by id for training.
    """
    machine = train(docs if train_docs is None else train_docs, labels, per_label, doc_id, text, label)
    return scored(docs, machine, doc_id, text, threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, per_label: int = 1500, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` with all its columns, less the rows whose score reaches ``threshold``."""
    machine = train(docs, labels, per_label, doc_id, text, label)
    shared = docs.sparkSession.sparkContext.broadcast((machine.weights.astype(np.float32), machine.bias, machine.curve))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine([])
        m.weights, m.bias, m.curve = shared.value
        kept: dict[str, float] = {}
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(at)]
            p = m.probability(m.evidence(texts, kept))
            yield batch.filter(pa.array((p < threshold) | np.array([not t.strip() for t in texts], bool)))

    return docs.mapInArrow(in_pieces(run), docs.schema)
