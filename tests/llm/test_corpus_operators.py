"""Corpus operators against brute force, and on nulls, empty and long texts, repeats and clashes."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankweave.llm import line_dedup, lm_scoring, near_dedup, toxicity
from rankweave.llm.common import components
from rankweave.llm.decontamination import decontaminate
from rankweave.llm.exact_dedup import exact_dedup
from rankweave.llm.language_id import identify
from rankweave.llm.mixing import apportion, mix, mixed_documents
from rankweave.llm.sharding import shard_documents
from rankweave.llm.token_counts import count_tokens
from rankweave.llm.toxicity import score_toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, w string, component string"


def frame(spark, rows, lang="en"):
    """Rows of (id, text, source); with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", "y", "z") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    out = []
    for i in range(120):
        out.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))), f"s{i % 3}" if i % 3 else "hot"))
    for i in range(120, 170):  # near copies of one text
        w = out[7][1].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((i, " ".join(w), "hot"))
    out += [(200, None, None), (201, "", "s1"), (202, "   \n", None), (203, "A", "s1"), (204, "a", "s2"), (205, out[3][1].replace(" ", " \t "), "s1"), (206, "long " * 30000, "s2"), (207, "Ünïcode É <|endoftext|> x", "s2")]
    return out


@pytest.fixture
def session_setting(spark):
    """Sets a session setting for one test."""
    before = {}

    def put(key, value):
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_token_counts(spark, rows):
    got = {r["doc_id"]: r for r in count_tokens(frame(spark, rows), BPE).collect()}
    reference = Tokenizer.from_file(BPE)
    for i, t, _ in rows:
        n = len(reference.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert count_tokens(frame(spark, []), BPE).isEmpty()


def highest_quotients(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda k: (weights[k] / (2 * won[k] + 1), -k))
        won[best] += 1
    return won


@pytest.mark.parametrize("weights,seats", [([53.0, 24, 23], 7), ([1.0] * 9, 4), ([1000.0, 1, 1, 1, 1], 11), ([5.0, 0, 5], 3)])
def test_apportionment_is_by_highest_quotients(spark, weights, seats):
    p = spark.createDataFrame([("g", k, float(w), seats) for k, w in enumerate(weights)], "g string, k long, w double, n long")
    assert [r["quota"] for r in apportion(p, "g", "k", "w", "n").orderBy("k").collect()] == highest_quotients(weights, seats)


def test_mix(spark, rows):
    out = mix(frame(spark, rows)).collect()
    again = mix(frame(spark, rows)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows if s is not None}) + [None]
    totals = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight, want, left, open_ = {s: k % 3 + 1 for k, s in enumerate(sources)}, {}, float(sum(totals.values())), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * totals[s]}
        for s in full or open_:
            want[s] = 3.0 * totals[s] if full else weight[s] * level
        left -= sum(want[s] for s in full)
        open_ = open_ - full if full else set()
    taken = collections.Counter()
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sources:
        assert abs(taken[s] - want[s]) <= max(4, 0.01 * want[s])
    texts = mixed_documents(frame(spark, rows))
    assert texts.columns == frame(spark, rows).columns
    assert sum(len((r["text"] or "").split()) for r in texts.collect()) == sum(taken.values())
    assert mix(frame(spark, [])).isEmpty() and mix(frame(spark, [(1, None, None)])).first()["target"] == 0


def test_near_dedup_is_brute_force(spark, rows):
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(frame(spark, rows), 4, 80).collect()}
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = ({tuple(w)} if len(w) < 4 else {tuple(w[k : k + 4]) for k in range(len(w) - 3)}) if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), find(i), find(i) == i)


@pytest.mark.parametrize(("star", "chunk"), [(10**6, 7), (5, 7), (2, 3)])
def test_near_dedup_in_chunks(spark, rows, monkeypatch, star, chunk):
    # a chain: each text is close to the next, but not to those further on; and a group around one text
    words = [f"w{k}" for k in range(400)]
    chain = [(10**6 + k, " ".join(words[4 * k : 4 * k + 100]), "chain") for k in range(30)]
    group = [(2 * 10**6 + k, " ".join(words[:k] + ["x"] + words[k : 120]), "group") for k in range(30)]
    rows = rows + chain + group
    whole = sorted(map(tuple, near_dedup.near_dedup(frame(spark, rows), 4, 80).collect()))
    monkeypatch.setattr(near_dedup, "STAR", star)
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    assert sorted(map(tuple, near_dedup.near_dedup(frame(spark, rows), 4, 80).collect())) == whole


def test_verified_sets_start_from_known_groups():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 0, 50, 52, 500)]
    alone = near_dedup.verify(sets, 80)
    assert alone[0] == alone[1] and alone[2] == alone[3] and len(set(alone)) == 3
    told = near_dedup.verify(sets, 80, known=np.array([7, 8, 9, 10, 7]))
    assert told[0] == told[1] == told[4] and told[2] == told[3] and len(set(told)) == 2


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(edges.limit(0)).isEmpty()


@pytest.mark.parametrize("digits", [16, 1])
def test_exact_dedup(spark, rows, digits):
    more = [*rows, (3, rows[3][1], "again")]
    got = exact_dedup(frame(spark, more), digest_digits=digits).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, _ in more:
        groups[norm(t)].append(i)
    want = sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in more)
    assert sorted(tuple(r) for r in got) == want
    assert exact_dedup(frame(spark, [])).isEmpty()


@pytest.mark.parametrize("most", ["10m", "-1"])
def test_line_dedup(spark, session_setting, most):
    session_setting("spark.sql.autoBroadcastJoinThreshold", most)
    pages = [(k, "h", ["menu", f"own {k}", "menu"] + (["some"] if k < 2 else [])) for k in range(6)] + [(9, "solo", ["menu"]), (10, "h", []), (None, "", [])]
    p = spark.createDataFrame(pages, "page_id long, host string, lines array<string>")
    got = {r["page_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.drop_boilerplate(p, F.col("lines"), F.col("host")).collect()}
    assert got[0] == (4, 2, "own 0\nsome") and got[5] == (3, 2, "own 5") and got[9] == (1, 0, "menu") and got[10] == (0, 0, "") and got[None] == (0, 0, "")


def test_sharding(spark, rows):
    copies = [(1000 + k, "the same text again " * 5, "hot") for k in range(80)]
    got = shard_documents(frame(spark, rows + copies), 4).collect()
    assert len(got) == len(rows) + 80 and {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    slots, size, text = collections.defaultdict(list), collections.Counter(), {i: t or "" for i, t, _ in rows + copies}
    for r in got:
        t = text[r["doc_id"]].encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and 0 <= r["shard"] < 4
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"] if r["doc_id"] != 206 else 0
    light = [(i, t, s) for i, t, s in rows if i != 206]
    even = collections.Counter()
    for r in shard_documents(frame(spark, light + copies), 4).collect():
        even[r["shard"]] += r["size"]
    assert max(even.values()) <= 1.1 * min(even.values())
    assert shard_documents(frame(spark, [])).isEmpty()


def test_lm_scores(spark, rows):
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(frame(spark, rows)).collect()}
    tokens = {i: (t or "").translate(FOLD).encode().split() + [None] for i, t, _ in rows}
    mod = {i: zlib.crc32(str(i).encode()) % 7 for i in tokens}

    def counts(ids):
        one, two = collections.Counter(), collections.Counter()
        for i in ids:
            one.update(tokens[i])
            two.update(zip(["begin", *tokens[i]], tokens[i]))
        return one, two, len(ids)

    def parts(i, one, two, docs):
        n, v = sum(one.values()), len(one)
        for before, w in zip(["begin", *tokens[i]], tokens[i]):
            c = docs if before == "begin" else one[before]
            yield (1 + int(math.log2(c)) if c else 0), np.array([two[before, w] / max(c, 1), one[w] / n, 1 / (v + 1)])

    every = counts([i for i in tokens if mod[i] != 2])
    n, v = sum(every[0].values()), len(every[0])
    rest = counts([i for i in tokens if mod[i] not in (2, 5)])
    held = [x for i in tokens if mod[i] == 5 for x in parts(i, *rest)]

    def em(rows_):
        p, w = np.array([x for _, x in rows_]), np.array([0.4, 0.4, 0.2])
        for _ in range(300):
            s = p * w
            w = (s / s.sum(axis=1, keepdims=True)).mean(axis=0)
        return w

    overall = em(held)
    weights = {}
    for b in range(40):
        own = [x for x in held if x[0] == b]
        weights[b] = ((len(own) * em(own) if own else 0) + 5 * overall + 1 / 3) / (len(own) + 6)
    weights[0] = np.r_[0, weights[0][1:]] / weights[0][1:].sum()  # no bigram after a context never seen
    for i in tokens:
        base = sum(math.log10((every[0][w] + 1) / (n + v + 1)) for w in tokens[i])
        score = sum(math.log10(weights[b] @ p) for b, p in parts(i, *every))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (mod[i] == 2, len(tokens[i]), n)
        assert r["n_known"] == sum(every[0][w] > 0 for w in tokens[i])
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score, rel=2e-2, abs=0.1)
    assert lm_scoring.score_documents(frame(spark, [])).isEmpty()


@pytest.mark.parametrize("group", [2, 3])
def test_lm_scores_over_groups_of_blocks(spark, rows, monkeypatch, group):
    whole = {tuple(r)[:5]: tuple(r)[5:] for r in lm_scoring.score_documents(frame(spark, rows)).collect()}
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", sum(len((t or "").encode()) for _, t, _ in rows) // 7)
    monkeypatch.setattr(lm_scoring, "GROUP", group)
    assert len(lm_scoring.level_ranges(7)) == {2: 3, 3: 2}[group]
    parts = {tuple(r)[:5]: tuple(r)[5:] for r in lm_scoring.score_documents(frame(spark, rows)).collect()}
    assert whole.keys() == parts.keys()
    for k, scores in whole.items():
        assert parts[k] == pytest.approx(scores)


def test_pieces_grow_in_line_with_blocks():
    sent = {n: n * lm_scoring.level_ranges(n)[0] for n in (10**4, 10**5, 10**6)}
    assert sent[10**6] == 10 * sent[10**5] == 100 * sent[10**4]
    for n in sent:
        ranges = lm_scoring.level_ranges(n)
        assert all(b / a <= lm_scoring.GROUP for a, b in zip(ranges, ranges[1:]))


def test_decontamination(spark, rows):
    w = rows[7][1].split()
    items = [(1, " ".join(w[2:16])), (22, "  ".join(w[5:9]).upper()), (3, None), (4, "--"), (5, rows[0][1] + " zzz"), (6, "Ünïcode É")]
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, word string")
    got = {r["doc_id"]: r for r in decontaminate(frame(spark, rows), b).collect()}
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = collections.defaultdict(set)
    for i, t in items:
        x = find.findall((t or "").translate(FOLD))
        for k in range(max(1, len(x) - 9) if x else 0):
            wins[tuple(x[k : k + 10])].add(str(i))
    for i, t, _ in rows:
        x = find.findall((t or "").translate(FOLD))
        hit, own = set(), set()
        for win, ids in wins.items():
            for k in range(len(x) - len(win) + 1):
                if tuple(x[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    own |= ids
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(x), len(hit), len(own), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
    none = decontaminate(frame(spark, rows), b.limit(0))
    assert none.count() == len(rows) and none.where("contaminated").isEmpty()


def test_language_of_held_out_documents(spark):
    rng = random.Random(3)
    words = {"en": ["the", "and", "house", "with", "thing"], "fr": ["le", "eau", "été", "que", "très"], "de": ["der", "und", "schön", "nicht", "auch"]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(12)), g) for i in range(150) for g in [("en", "fr", "de")[i % 3]]]
    d = spark.createDataFrame([*rows, (900, None, None), (901, "12 -- ...", "en"), (902, "", "fr")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify(d).collect()}
    assert all(got[i]["lang_pred"] == g for i, _, g in rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert got[4]["held_out"] == (zlib.crc32(b"4") % 4 == 2)
    mixed = identify(spark.createDataFrame([*rows, (905, " ".join(words["en"] * 3 + words["de"] * 9), None)], "doc_id long, text string, lang string")).where("doc_id = 905").first()
    assert mixed["lang_pred"] == "de" and mixed["langs"][0] > mixed["langs"][1] > 0.1  # de, en, fr
    assert identify(d.limit(0)).isEmpty()


def test_toxicity_of_held_out_documents(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(vocabulary) for _ in range(40)]
        if i % 3 == 0:
            w[5] = rng.choice(["dumbfool", "wretch"])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(i % 3 == 0)))
    lab = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    extra = [(800, None, "s"), (801, "", "s"), (802, " ".join(vocabulary[:9]) + " dumb-fool", "s"), (803, " ".join(vocabulary[:9]) + " d u m b f o o l", "s")]
    got = {r["doc_id"]: r for r in score_toxicity(frame(spark, rows + extra), lab).collect()}
    test = [(i, y) for i, y in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == y for i, y in test) >= 0.95 * len(test)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert got[803]["predicted"] == 1 and got[802]["score"] > got[801]["score"]
    assert score_toxicity(frame(spark, rows), lab.limit(0)).where("score > 0.01").isEmpty()


def test_kernel_weights_equal_the_landmark_sum():
    texts = ["^alpha$", "^beta$", "^gamma$"]
    vectors = np.zeros((1 << toxicity.BITS, 2))
    for places, h, w in toxicity.features(texts[:2]):
        for p, row in zip(places, h):
            np.add.at(vectors[:, p], row, w)
    beta = np.array([0.3, -0.7])
    assert toxicity.kernel_sums(texts, vectors) @ beta == pytest.approx(toxicity.kernel_sums(texts, (vectors @ beta)[:, None])[:, 0])
