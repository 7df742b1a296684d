"""The pipeline's stages against brute force on each stage's own input."""

import collections
import re

import pytest

import corpus_pipeline
from rankweave.llm.common import read, stored
from rankweave.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def near_heads(texts):
    sets = {}
    for i, t in texts.items():
        w = [x.translate(FOLD) for x in words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def clean_ids(texts, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    joined = lambda t: " " + " ".join(find.findall((t or "").translate(FOLD))) + " "
    wins = set()
    for t in items:
        w = joined(t).split()
        wins |= {" " + " ".join(w[k : k + 10]) + " " for k in range(max(1, len(w) - 9) if w else 0)}
    return {i for i, t in texts.items() if not any(x in joined(t) for x in wins)}


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    (_, toxic), (_, near), (_, leaks), (_, mixing), (_, shards) = corpus_pipeline.STAGES
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    one = stored(toxic(spark, docs, SF))
    fine = {r["doc_id"] for r in score_toxicity(docs, read(spark, SF, "labels")).collect() if r["score"] < 0.5}
    assert one.columns == columns and set(texts(one)) == fine
    two = stored(near(spark, one, SF))
    assert two.columns == columns and set(texts(two)) == near_heads(texts(one))
    three = stored(leaks(spark, two, SF))
    items = [r["text"] for r in read(spark, SF, "benchmark").collect()]
    assert three.columns == columns and set(texts(three)) == clean_ids(texts(two), items)
    four = stored(mixing(spark, three, SF))
    assert four.columns == columns
    before, after = texts(three), collections.Counter()
    for r in four.collect():
        assert r["n_chars"] == len(r["text"]) and " ".join(words(r["text"])) in " ".join(words(before[r["doc_id"]]))
        after[r["doc_id"]] += len(words(r["text"]))
    assert all(n <= 3 * len(words(before[i])) for i, n in after.items())
    assert sum(after.values()) == pytest.approx(sum(len(words(t)) for t in before.values()), rel=0.01)
    five = shards(spark, four, SF).collect()
    assert len(five) == four.count() and {r["shard"] for r in five} <= set(range(24))


def test_an_empty_table_passes(spark):
    docs = read(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
    assert docs.isEmpty()
