"""Corpus operators: laws, brute-force versions of their inner steps, and rows that are hard to place."""

import collections
import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rankweave.llm import language_id, sharding, toxicity
from rankweave.llm.common import PIECE_ROWS, KeyFilter, components, in_pieces, stored, without_ids
from rankweave.llm.decontamination import decontaminate
from rankweave.llm.exact_dedup import exact_dedup
from rankweave.llm.language_id import identify
from rankweave.llm.line_dedup import dedup_page_lines
from rankweave.llm.lm_scoring import score_documents
from rankweave.llm.mixing import mix, mixed_documents, to_shards
from rankweave.llm.near_dedup import near_dedup
from rankweave.llm.sharding import shard_documents
from rankweave.llm.toxicity import score_toxicity, without_toxic
from pyspark.sql import functions as F


def docs_of(spark, rows, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, schema)


# --- sharding -----------------------------------------------------------------------------
def test_bytes_stay_near_equal_with_groups_of_many_small_rows(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(500))) for i in range(3000)] + [(10_000 + i, "") for i in range(2000)]
    got = shard_documents(docs_of(spark, rows, "doc_id long, text string"), 24).collect()
    size, count = collections.Counter(), collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
        count[r["shard"]] += 1
    assert len(size) == 24 and max(size.values()) <= 1.05 * min(size.values()) and max(count.values()) <= 1.25 * min(count.values())


def test_packing_is_the_greedy_rule():
    rng = np.random.default_rng(0)
    units = rng.integers(1, 50, (200, 3)).astype(float)
    residual = np.tile(units.sum(axis=0) / 5, (5, 1))
    total = residual.sum(axis=0)
    left, want = [list(r) for r in residual], []
    for u in units:
        room = [s for s in range(5) if left[s][0] >= u[0]]
        if room:
            best = max(room, key=lambda s: (sum(u[d] * left[s][d] / total[d] ** 2 for d in range(3)), -s))
        else:
            best = max(range(5), key=lambda s: (left[s][0], -s))
        want.append(best)
        for d in range(3):
            left[best][d] -= u[d]
    assert sharding.pack(units, residual.copy()).tolist() == want


# --- language -----------------------------------------------------------------------------
def test_texts_without_letters_have_no_language(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr", "s") for i in range(40)]
    odd = [(100, "½", None, "s"), (101, "² ①", None, "s"), (102, "Ⅷ", None, "s"), (103, "7 + 8", None, "s"), (104, "é", None, "s")]
    got = {r["doc_id"]: r for r in identify(docs_of(spark, rows + odd)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102, 103)) and got[104]["lang_pred"] in ("en", "fr")


def test_mixture_by_plain_loops():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 5, (3, language_id.BUCKETS)).astype(float)
    model = language_id.Languages(["a", "b", "c"], counts, np.array([5.0, 3, 2]))
    scores = rng.normal(-6, 2, (9, 3))
    share, best = model.mixtures(scores.copy(), np.array([4, 0, 5]))
    assert best[1] == -1
    for text, words in ((0, scores[:4]), (2, scores[4:])):
        like = [[np.exp(x - max(w)) for x in w] for w in words]
        theta = list(model.prior)
        for _ in range(language_id.ROUNDS):
            total = [0.5 * p for p in model.prior]
            for w in like:
                z = sum(p * x for p, x in zip(theta, w))
                total = [t + p * x / z for t, p, x in zip(total, theta, w)]
            theta = [t / sum(total) for t in total]
        assert share[text] == pytest.approx(theta)
        value = lambda s: sum(np.log(sum(theta[k] * x[k] for k in s) / sum(theta[k] for k in s) + 1e-30) + max(w) for x, w in zip(like, words))
        alone = [sum(w[k] for w in words) + np.log(model.prior[k]) for k in range(3)]
        chosen, now = {int(np.argmax(alone))}, max(alone)
        while len(chosen) < 3:
            gain, k = max((value(sorted({*chosen, k})) - now, -k) for k in range(3) if k not in chosen)
            if gain <= 0.5 * np.log(len(words) + 1.0):
                break
            chosen, now = {*chosen, -k}, now + gain
        assert best[text] == max(chosen, key=lambda k: theta[k])


# --- toxicity -----------------------------------------------------------------------------
def test_kernel_by_listing_subsequences():
    def listed(s):
        out = collections.Counter()
        for n, span in ((3, 5), (4, 6)):
            for at in itertools.combinations(range(len(s)), n):
                if at[-1] - at[0] < span:
                    out["".join(s[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1 - n)
        return out

    def cosine(a, b):
        x, y = listed(a), listed(b)
        return sum(v * y[k] for k, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    words = ["^dumbfool$", "^dumb-fool$", "^dxumbfool$", "^house$", "^aaaa$"]
    marks = toxicity.Landmarks(words)
    got = toxicity.kernel_sums(words, marks.vectors, marks.place)
    assert got == pytest.approx(np.array([[cosine(a, b) for b in words] for a in words]), abs=5e-3)  # features share hash places
    assert got[0, 2] > 0.5 > got[0, 3]


def test_machine_by_plain_gradient_descent():
    rng = np.random.default_rng(4)
    x = np.c_[rng.normal(size=(60, 4)), np.ones(60)]
    y, cost = np.where(x[:, 0] + rng.normal(size=60) * 0.3 > 0, 1.0, -1.0), rng.uniform(0.5, 2, 60)
    w = np.zeros(5)
    for _ in range(20_000):
        w -= 1e-3 * (w - x.T @ (cost * y * np.maximum(1 - y * (x @ w), 0)))
    assert toxicity.squared_hinge(x, y, cost) == pytest.approx(w, abs=1e-3)


def test_machine_is_solved_in_small_parts():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    y, cost = np.sign(x[:, 0] + rng.normal(size=len(x))), rng.random(len(x))
    words = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(3000)]
    marks = toxicity.Landmarks(words[:150])
    tracemalloc.start()
    w = toxicity.squared_hinge([x[:7000], x[7000:]], y, cost)
    solved = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    mapped = marks.mapped(words)
    made = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert solved < x.nbytes / 2 and made < mapped.nbytes + 25_000_000
    slack = np.maximum(1 - y * (x @ w), 0)
    assert np.abs(w - (cost * slack * y) @ x).max() < 1e-5 * np.abs((cost * y) @ x).max()
    assert mapped[:5] == pytest.approx(marks.mapped(words[:5]))


def test_shards_start_no_workers_for_placed_groups(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a list of rows goes through Python workers")

    d = docs_of(spark, [(i, "a b c" if i < 50 else f"w{i} x", "en", "s") for i in range(100)])
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert shard_documents(d, shards=4).count() == 100


def test_texts_without_words_are_never_dropped(spark):
    rows = [(i, "wretch wretch" if i % 2 else "good day") for i in range(8)] + [(90, None), (91, ""), (92, " \n")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    left = {r["doc_id"] for r in without_toxic(docs_of(spark, rows, "doc_id long, text string"), labels, threshold=0.0).collect()}
    assert left == {90, 91, 92}


# --- shared -------------------------------------------------------------------------------
def test_filter_lets_all_keys_pass_and_few_others(spark):
    keys = spark.range(0, 50_000, 5).select("id")
    f = KeyFilter(keys, F.col("id"))
    asked = spark.range(50_000).withColumn("yes", f.may_have(F.col("id")))
    assert asked.where("yes and id % 5 = 0").count() == 10_000 and asked.where("yes and id % 5 <> 0").count() < 400
    assert spark.range(1).select(f.may_have(F.lit(None).cast("long")).alias("n")).first()["n"] is False
    nothing = KeyFilter(keys.limit(0), F.col("id"))
    assert spark.range(100).where(nothing.may_have(F.col("id"))).isEmpty()


def test_without_ids(spark):
    d = docs_of(spark, [(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    gone = spark.createDataFrame([(2,), (2,), (None,), (7,)], "doc_id long")
    assert sorted(r["text"] for r in without_ids(d, gone).collect()) == ["a", "d"]


def test_components_of_random_graphs_and_a_hub(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500, 600 + k) for k in range(200)] + [(499, 700)]
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {v: find(v) for v in root}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {v for v in want if all(a == b for a, b in edges if v in (a, b))}
    assert got == {v: c for v, c in want.items() if v not in alone}


def test_blocks_go_down_the_tree(spark, monkeypatch):
    monkeypatch.setattr("rankweave.llm.mixing.FAN", 4)
    rng = random.Random(2)
    size = {(k, s): rng.randrange(1, 400) for k in ("0a", "0b") for s in range(50)}
    cells = spark.createDataFrame([(k, s, n) for (k, s), n in size.items()], "key string, shard long, cell_size long")
    plan = spark.createDataFrame([("0a", 700), ("0b", 90)], "key string, blocks long")
    quota = {(r["key"], r["shard"]): r["quota"] for r in to_shards(cells, plan, 50).collect()}
    for key, blocks in (("0a", 700), ("0b", 90)):
        total = sum(n for (k, _), n in size.items() if k == key)
        assert sum(q for (k, _), q in quota.items() if k == key) == blocks
        assert all(abs(q - blocks * size[k, s] / total) < 4 for (k, s), q in quota.items() if k == key)


# --- rows that are hard to place ----------------------------------------------------------
HARD = [(None, "some words here and there", "en", "s"), (None, "some words here and there", "en", "s"), (5, "a b c d e f g", "en", None), (5, "a b c d e f g", "en", None), (5, "other words", "de", "t"),
        (6, None, None, None), (7, "", "en", "s"), (8, "long " * 40_000, "en", "s")]
LABELS = "doc_id long, toxic int"


def operators(spark):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1), (7, 0)], LABELS)
    return {
        "mix": mix, "near": near_dedup, "exact": exact_dedup, "shard": shard_documents, "lm": score_documents, "language": identify,
        "leaks": lambda d: decontaminate(d, items), "toxic": lambda d: score_toxicity(d, labels),
    }


@pytest.mark.parametrize("name", ["mix", "near", "exact", "shard", "lm", "language", "leaks", "toxic"])
def test_null_and_repeated_ids_long_texts_and_empty_tables(spark, name):
    run = operators(spark)[name]
    d = docs_of(spark, HARD)
    clash = d.select("*", *[F.lit("x").alias(c) for c in ("size", "shard", "row", "word", "w", "h", "component", "_mix_id", "_mix", "_text", "part", "digest")])
    got = run(clash).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in HARD)
    assert run(d.limit(0)).isEmpty()


def test_mixed_documents_take_any_column_names(spark):
    d = docs_of(spark, [(1, "a b c", "en", "s"), (2, "d e", "en", "t")]).select("*", *[F.lit(1).alias(c) for c in ("_mix_id", "_mix", "_text", "_doc", "_copy")])
    out = mixed_documents(d)
    assert out.columns == d.columns and out.count() >= 2


def test_html_lines_of_nulls_empty_tables_and_long_pages(spark):
    page = "<html><body><!-- x --><p>menu</p><div>own {n}</div><script>var a;</script></body></html>"
    rows = [(n, f"https://Host.example:80/{n}", page.format(n=n), "x") for n in range(5)] + [(9, None, None, "x"), (10, "http://solo/", "<p>" + "w " * 50_000 + "</p>", "x")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, lines string")
    got = {r["page_id"]: r for r in dedup_page_lines(p).collect()}
    assert got[2]["host"] == "host.example" and got[2]["text"] == "own 2" and got[2]["n_dropped"] == 1
    assert (got[9]["host"], got[9]["n_lines"], got[9]["text"]) == ("", 0, "") and got[10]["n_lines"] == 1
    assert dedup_page_lines(p.limit(0)).isEmpty()


def test_stored_tables_are_read_back(spark):
    d = stored(spark.range(3).toDF("n"), "three")
    assert d.count() == 3 and d.schema["n"].dataType.simpleString() == "bigint"


def test_pieces_hold_all_rows_in_order():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["n"]) for n in (0, 1, PIECE_ROWS, 3 * PIECE_ROWS + 1)]
    got = list(in_pieces(lambda pieces: pieces)(iter(batches)))
    assert max(p.num_rows for p in got) == PIECE_ROWS
    assert [x for p in got for x in p.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]
    assert list(in_pieces(lambda pieces: pieces)(iter([]))) == []


def test_machine_without_sample_scores_nothing_as_toxic(spark):
    d = docs_of(spark, [(1, "good day"), (2, None)], "doc_id long, text string")
    got = score_toxicity(d, spark.createDataFrame([], LABELS)).collect()
    assert len(got) == 2 and all(r["score"] < 1e-8 and r["predicted"] == 0 for r in got)
