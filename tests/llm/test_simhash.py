import random
import re

import numpy as np
import pytest
import xxhash

from skirmish.llm import simhash
from skirmish.llm.components import connected_components
from skirmish.llm.queries import op6_simhash_near_dedup


def fingerprint(text, each=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + each]) for i in range(len(words) - each + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(values, radius):
    v = np.array(values, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
    label = np.arange(len(v))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def _texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(300)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            t = (out[r.randrange(len(out))] or "").split(" ")
            if len(t) > 3:
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.randint(0, 120))))
    return [*out, None, "", "One", "one", "A\u00a0b c"]


def test_query_against_brute_force(spark, docs, tiny):
    rows = [(3 * i + 1, t, "en", "s") for i, t in enumerate(_texts(120, 3))]
    got = {r["doc_id"]: r for r in op6_simhash_near_dedup(spark, tiny(documents=docs(rows, extra=True))).collect()}
    prints = [fingerprint(t) for _, t, _, _ in rows]
    label = components(prints, 4)
    for k, (doc, *_) in enumerate(rows):
        assert got[doc]["fingerprint"] == f"{prints[k]:016x}"
        assert got[doc]["component_id"] == rows[label[k]][0]


@pytest.mark.parametrize(("radius", "unit"), [(4, 8192), (10, 8192), (4, 20)])
def test_links_connect_what_all_pairs_connect(spark, radius, unit):
    """Also where a bucket is dealt over several tasks."""
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 12, dtype=np.int64).astype(np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, int(r.integers(1, 6))).astype(np.uint64)) for _ in range(150)]
    values = np.unique(np.concatenate([base, base[r.integers(0, 12, 150)] ^ np.array(flips, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fingerprint long")
    found = simhash.links(df, radius, unit).collect()
    place = {int(x): i for i, x in enumerate(values.view(np.int64))}
    label = np.arange(len(values))
    for _ in range(len(values)):
        for a, b in found:
            label[place[a]] = label[place[b]] = min(label[place[a]], label[place[b]])
    assert all(np.bitwise_count(np.uint64(a & (2**64 - 1)) ^ np.uint64(b & (2**64 - 1))) <= radius for a, b in found)
    assert (label == components(values, radius)).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (7, None)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if b is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(edges)):
        for a, b in edges:
            if b is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark, docs):
    words = [f"word{i}" for i in range(200)]
    text = " ".join(words)
    near = " ".join([*words[:100], "other", *words[101:]])
    half = " ".join([*words[:100], *(f"x{i}" for i in range(100))])
    rows = [(5, text, "en", "a"), (3, near, "en", "a"), (9, half, "en", "b"), (8, text, "en", "c"), (8, text, "en", "c"), (None, "alone here", None, None), (11, None, None, None)]
    kept = simhash.one_of_each(docs(rows, extra=True)).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 3, 9, 11]
    assert simhash.one_of_each(docs(rows).where("doc_id < 0")).count() == 0


def _shingles(text, each=5):
    words = text.split()
    return {tuple(words[i : i + each]) for i in range(max(1, len(words) - each + 1))}


def _groups(texts, radius, similarity=0.8):
    """Least index reachable over all pairs within the radius and alike."""
    v = np.array([fingerprint(t, 5) for t in texts], np.uint64)
    s = [_shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if int(v[i] ^ v[j]).bit_count() <= radius and len(s[i] & s[j]) >= similarity * len(s[i] | s[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize(("seed", "radius"), [(1, 10), (2, 10), (3, 14)])
def test_families_of_edited_texts_against_all_pairs(spark, docs, seed, radius):
    """Links within the radius that fail the similarity must not hide others of the same bucket."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        words = list(base)
        for at in r.sample(range(120), r.randint(1, 3)):
            words[at] = f"v{r.randrange(5000)}"
        texts.append(" ".join(words))
    want = _groups(texts, radius)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs([(i, t, "en", "s") for i, t in enumerate(texts)]), radius=radius).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("unit", [1 << 16, 20])
def test_candidates_are_all_pairs_once(spark, unit):
    """Also where a bucket is dealt over several tasks; labels leave out what is joined."""
    r = np.random.default_rng(6)
    v = np.unique(r.integers(0, 2**63, 3, dtype=np.int64).astype(np.uint64)[r.integers(0, 3, 120)] ^ np.array([np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, 6).astype(np.uint64)) for _ in range(120)], np.uint64))
    rows = [(int(x), i % 4) for i, x in enumerate(v.view(np.int64))]
    df = spark.createDataFrame(rows, "fingerprint long, label long")
    label = dict(rows)
    got = sorted(tuple(sorted((x["a"], x["b"]))) for x in simhash.candidates(df, 10, unit, label="label").collect())
    far = np.bitwise_count(v[:, None] ^ v[None, :])
    want = sorted(tuple(sorted((rows[i][0], rows[j][0]))) for i in range(len(v)) for j in range(i) if far[i, j] <= 10 and label[rows[i][0]] != label[rows[j][0]])
    assert got == want


def test_all_texts_of_a_fingerprint_are_compared(spark, docs):
    """Repeated lines decide the fingerprint, while the distinct shingles differ: the first text stands for none of the others."""
    r = random.Random(8)
    line = "alpha beta gamma delta eps " * 400
    texts = []
    for _ in range(5):
        tail = [f"w{r.randrange(5000)}" for _ in range(150)]
        edited = [*tail[:70], "other", *tail[71:]]
        texts += [line + " ".join(tail), line + " ".join(edited), line + "zz " * 600 + " ".join(tail)]
    assert len({fingerprint(t, 5) for t in texts}) == 2
    want = [i - i % 3 for i in range(len(texts))]
    assert _groups(texts, 40) == want
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs([(i, t, "en", "s") for i, t in enumerate(texts)]), radius=40).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_alike_texts_beyond_ten_bits_are_one_group(spark, docs):
    r = random.Random(4)
    while True:
        words = [f"w{r.randrange(5000)}" for _ in range(60)]
        edited = [*words[:30], "other", *words[31:]]
        texts = [" ".join(words), " ".join(edited)]
        if 10 < (fingerprint(texts[0], 5) ^ fingerprint(texts[1], 5)).bit_count() <= 14 and _groups(texts, 14) == [0, 0]:
            break
    assert [x["doc_id"] for x in simhash.one_of_each(docs([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()] == [0]


def test_repeated_lines_do_not_part_near_duplicates(spark):
    """Texts that share four fifths of their distinct shingles are one group, though one line of each comes very often."""
    r = random.Random(5)
    rows = []
    for k in range(20):
        text = " ".join(f"w{r.randrange(5000)}" for _ in range(200))
        for side in "ab":
            line = " ".join(f"{side}{r.randrange(5000)}" for _ in range(8))
            rows.append((2 * k + (side == "b"), text + (" " + line) * 60))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.one_of_each(df).collect()) == list(range(0, 40, 2))


@pytest.mark.parametrize("held", [4, 1 << 18])
def test_counts_follow_keys_not_parts(spark, held):
    """Bucket sizes come as a row a key and task, however many parts the rows are dealt over."""
    values = spark.range(0, 4096, 1, 64).selectExpr("id AS v")
    rows = simhash._counts(values, lambda v: (v % np.uint64(16)).astype(np.int64), held).collect()
    found = {}
    for r in rows:
        found[r["k"]] = found.get(r["k"], 0) + r["n"]
    assert found == {k: 256 for k in range(16)}
    assert held == 4 or len(rows) <= 16 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("n_parts", [3, 96])
def test_a_crowd_is_dealt_over_few_jobs(spark, monkeypatch, n_parts):
    """Members of a large group move as a row a pair of parts and task, not a row a bucket each; its forests connect it."""
    r = np.random.default_rng(7)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, 5).astype(np.uint64)) for _ in range(3000)], np.uint64)
    v = np.unique(np.uint64(r.integers(0, 2**63)) ^ flips).view(np.int64)
    df = spark.createDataFrame([(int(x), int(x)) for x in v], "fingerprint long, label long").repartition(n_parts)
    dealt = []
    plain = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *by: (dealt.append(self) if by == ("job",) else None) or plain(self, *by))
    found = simhash.candidates(df, 14, label="label", forest=True).select("a", "b").collect()
    assert dealt[0].count() <= 36 * n_parts
    place = {int(x): i for i, x in enumerate(v)}
    label = np.arange(len(v))
    for _ in range(len(v)):
        was = label.copy()
        for a, b in found:
            label[place[a]] = label[place[b]] = min(label[place[a]], label[place[b]])
        if (label == was).all():
            break
    assert (label == 0).all() and all(bin((a ^ b) & (2**64 - 1)).count("1") <= 14 for a, b in found)
