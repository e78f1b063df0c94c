"""Whitening, product codes and block naming against brute force."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.llm import codes, naming, queries, vectors, whitening

EMBEDDINGS = "vec_id long, embedding array<double>, label int"


def _vectors(seed, n, width, labels=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)) * np.linspace(1, 0.2, width) * 0.3
    return [(i, [float(x) for x in v], int(rng.integers(labels))) for i, v in enumerate(base)]


ODD = [(900, None, 0), (901, [0.1, None], 0), (902, [float("nan")] * 2, 0), (903, [float("inf")] * 2, 1)]


def _plain_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(x * scale) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(cut(v, p), book)[1]].append(cut(v, p))
            for j, g in groups.items():
                book[j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = []
    for i, v, lab in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        found.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), lab))
    by_label = defaultdict(int)
    for _, _, e, lab in found:
        by_label[lab] += e
    return [(i, c, e, by_label[lab], digest) for i, c, e, lab in found]


def _same(found, plain):
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain))


def _split(spark, rows, parts=3):
    return spark.createDataFrame(rows, EMBEDDINGS).repartition(parts, "vec_id")


def test_codes_match_brute_force(spark):
    clustered = [(i, [float(round(x * 4) + (i % 5)) / 8 for x in v], None if i % 7 == 0 else lab) for i, v, lab in _vectors(1, 700, 16)]  # many ties
    for rows in (_vectors(2, 900, 32), clustered, _vectors(3, 9, 8)):
        wide = [(r[0], None if r[1] is None else (r[1] * 40)[: len(rows[0][1])], r[2]) for r in ODD]
        _same(codes.compress(_split(spark, rows + wide)).collect(), _plain_codes(rows))


def test_codes_of_repeats_hot_vectors_and_null_ids(spark):
    rows = _vectors(4, 120, 8) + [(5, [0.25] * 8, 1)] * 300 + [(5, [0.5] * 8, 1), (None, [0.75] * 8, None)]
    _same(codes.compress(_split(spark, rows)).collect(), _plain_codes(rows))


def test_codes_of_large_numbers_and_other_columns(spark):
    rows = [(i, [x * 1e9 for x in v], lab) for i, v, lab in _vectors(5, 60, 8)]
    df = _split(spark, rows).withColumns({c: F.lit(1) for c in ("v", "code", "n", "ids", "_of")})
    plain = [(i, c, e if e < 1 << 63 else None, s if s < 1 << 63 else None, d) for i, c, e, s, d in _plain_codes(rows)]
    _same(codes.compress(df).collect(), plain)
    huge = [(i, [x * 1e12 for x in v], lab) for i, v, lab in _vectors(6, 30, 8, 1)]
    found = codes.compress(_split(spark, huge)).collect()
    plain = {i: (c, e) for i, c, e, *_ in _plain_codes(huge)}
    assert all(r["code"] == plain[r["vec_id"]][0] and r["error"] == (plain[r["vec_id"]][1] if plain[r["vec_id"]][1] < 1 << 63 else None) for r in found)


def test_blocks_prune_and_lose_nothing():
    rng = np.random.default_rng(7)
    for spread in (3, 200):
        points = np.sort(rng.integers(-500, 500, (400, 1)), axis=0) + rng.integers(-spread, spread, (400, 4))
        points = points[np.argsort(codes.hilbert_keys(points), kind="stable")]
        entries = rng.integers(-500, 500, (16, 4))
        firsts = np.arange(0, 400, 16)
        low, high = np.minimum.reduceat(points, firsts), np.maximum.reduceat(points, firsts)
        listed = codes.shortlist(low, high, np.add.reduceat(points, firsts) // 16, entries)
        apart = ((points[:, None] - entries) ** 2).sum(axis=2)
        ties = apart == apart.min(axis=1)[:, None]
        assert (~ties | listed[np.arange(400) // 16]).all()
        assert listed.mean() < 0.7


def test_hilbert_curve_steps_by_one():
    side = np.arange(16)
    points = np.stack(np.meshgrid(side, side, indexing="ij"), axis=-1).reshape(-1, 2)
    along = points[np.argsort(codes.hilbert_keys(points), kind="stable")]
    assert (abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_decode_is_near(spark):
    rows = _vectors(8, 200, 16)
    vs = vectors.whole(_split(spark, rows), 4096, label="label")
    chunks = codes.blocks(vs, 16, 64)
    books = codes.fit(vs, chunks, 16)
    for r in codes.encode(chunks, books, 16).collect():
        whole = [math.floor(x * 4096) for x in rows[r["vec_id"]][1]]
        assert sum((a - b) ** 2 for a, b in zip(whole, codes.decode(r["code"], books), strict=True)) == r["error"]


def _plain_whitening(rows, wanted=8):
    kept = [(i, [math.floor(x * 1024) + 100_000 for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n = len(kept)
    x = np.array([v for _, v in kept], object)
    total = x.sum(axis=0)
    z = x * n - total
    cov = np.array([[float(Fraction(int((z[:, a] * z[:, b]).sum()), n**3)) for b in range(x.shape[1])] for a in range(x.shape[1])])
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions[:, ::-1]
    w = (z.astype(float) / n) @ directions
    return kept, n, (z * z).sum(axis=1), values, np.trace(cov), w


def _check_whitening(df, rows, ranks):
    found = whitening.whiten(df).collect()
    kept, n, far, values, trace, w = _plain_whitening(rows)
    assert len(found) == len(kept) * ranks
    by = defaultdict(list)
    for r in found:
        by[r["component"]].append(r)
    assert sorted(by) == list(range(1, ranks + 1))
    for c, rs in by.items():
        assert sorted((r["vec_id"], r["deviation"]) for r in rs) == sorted((i, int(d)) for (i, _), d in zip(kept, far, strict=True))
        assert all(r["n"] == n and abs(r["explained"] * trace / values[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in rs)
    return by, kept, values, w


def test_whitening_matches_brute_force(spark):
    rows = _vectors(11, 300, 12)
    odd = [(r[0], None if r[1] is None else (r[1] * 12)[:12], r[2]) for r in ODD]
    by, kept, values, w = _check_whitening(_split(spark, rows + odd), rows, 8)
    at = {i: k for k, (i, _) in enumerate(kept)}
    for c, rs in by.items():
        plain = w[:, c - 1] / np.sqrt(values[c - 1])
        got = np.array([r["whitened"] for r in rs])
        want = plain[[at[r["vec_id"]] for r in rs]]
        assert min(abs(got - want).max(), abs(got + want).max()) < 1e-8


def test_whitening_of_low_rank_and_equal_eigenvalues(spark):
    # four corners of a square: two equal eigenvalues, and a place without variance
    square = [(i, [float(a), float(b), 0.5], 0) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)] * 25)]
    _check_whitening(_split(spark, square), square, 2)
    line = [(i, [i / 7, i / 3.5, -i / 7], 0) for i in range(0, 70, 7)]
    _check_whitening(_split(spark, line), line, 1)
    assert whitening.whiten(_split(spark, [(1, [0.5, 0.25], 0)] * 3)).count() == 0
    assert whitening.whiten(_split(spark, [(1, [0.5, 0.25], 0)])).count() == 0
    repeats = _vectors(12, 5, 3) * 4 + [(None, [0.1, 0.2, 0.3], 0)]
    found = whitening.whiten(_split(spark, repeats).withColumn("w", F.lit(1)).withColumn("n", F.lit(2))).collect()
    assert len(found) == 21 * 3 and found[0]["identity_error"] < 1e-9


def test_whitening_of_large_numbers(spark):
    rows = [(i, [x * 1e8 for x in v], 0) for i, v, _ in _vectors(13, 40, 3)]
    found = whitening.whiten(_split(spark, rows)).collect()
    _, _, far, *_ = _plain_whitening(rows)
    assert len(found) == 120 and found[0]["identity_error"] < 1e-9
    assert {r["vec_id"]: r["deviation"] for r in found} == {i: int(d) if d < 1 << 63 else None for i, d in enumerate(far)}


def _polynomial(m):
    """Coefficients by Faddeev and LeVerrier."""
    d, out = len(m), [Fraction(1)]
    a = [[Fraction(x) for x in r] for r in m]
    b = [[Fraction(i == j) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        b = [[sum(a[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(b[i][i] for i in range(d)) / k)
        for i in range(d):
            b[i][i] += out[-1]
    return [int(x) for x in out]


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(14)
    for d, rank, size in ((1, 1, 9), (5, 5, 50), (7, 4, 1000), (6, 6, 10**6), (4, 1, 3)):
        a = rng.integers(-size, size + 1, (rank, d)).astype(object)
        m = [[int(x) for x in r] for r in a.T @ a]
        if any(m[i][i] for i in range(d)):
            assert whitening.characteristic_polynomial(spark, m) == _polynomial(m)
    # a zero where the first pivot would be
    m = [[2, 0, 1], [0, 3, 0], [1, 0, 2]]
    assert whitening.characteristic_polynomial(spark, m) == _polynomial(m)


def test_roots_are_told_apart_and_counted():
    # (x - 5)^2 (x - 3) x, and two roots 10^-12 apart relative to their size
    assert [(r / 2**b, n) for r, b, n in whitening.largest_roots([1, -13, 55, -75, 0], 8)] == [(5.0, 2), (3.0, 1)]
    big = 10**12
    found = whitening.largest_roots([1, -(2 * big + 1), big * (big + 1)], 8)
    assert [(round(r / 2**b), n) for r, b, n in found] == [(big + 1, 1), (big, 1)]


def _plain_groups(rows):
    clean = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for i, t in rows:
        groups[clean(t)].append((-len(t or ""), i is None, i))
    out = []
    for t, g in groups.items():
        best = min(g)
        for k, x in enumerate(sorted(g)):
            out.append((x[2], best[2], len(g), k == 0, hashlib.sha256(t.encode()).hexdigest()))
    return out


def _texts():
    r = random.Random(21)
    made = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(40))) for _ in range(60)]
    long = "".join(chr(97 + r.randrange(26)) for _ in range(3000))
    rows = list(enumerate(made + made[:20] + [m.replace(" ", "\n\t") for m in made[10:30]]))
    rows += [(200, long), (201, long[:1500] + "  " + long[1500:]), (202, long[:-1]), (203, long[:-1] + "?"), (204, long * 2), (205, long), (206, "x" + long)]
    rows += [(300, None), (301, ""), (302, " \r\n"), (303, " "), (304, "é" * 70), (305, "é" * 70), (306, "e" * 140), (None, "w1"), (307, "w 1"), (308, "w1"), (308, "w1")]
    return rows + [(400 + k, "hot hot") for k in range(150)]


@pytest.mark.parametrize("block", [16, 64, naming.BLOCK])
def test_naming_matches_brute_force(spark, block):
    rows = _texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = naming.exact_groups(df, block=block)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, _plain_groups(rows)))


def test_distinct_documents_carry_columns(spark):
    rows = _texts()
    clash = ["row", "kept", "keep", "identity", "n_chars", "clean", "digests", "a", "b", "name", "_"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clash})
    found = naming.distinct_documents(df, block=64)
    assert found.columns == df.columns
    got = found.collect()
    assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in got for c in clash)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(x[0]) for x in _plain_groups(rows) if x[3])


def test_colliding_digests_are_made_anew(spark):
    """A digest that takes all blocks of one size for equal is found out, and the next seed is used."""

    def weak(x, seed):
        return F.struct(F.octet_length(x).cast("long").alias("a"), F.lit(0).cast("long").alias("b")) if seed == 0 else naming._digest(x, seed)

    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "a b")], "doc_id long, text string")
    assert not naming.digests_hold(df, 8, weak, 0)
    found = {r["doc_id"]: r["identity"] for r in naming.identities(df, [], block=8, digest=weak).collect()}
    assert found[1] == found[3] != found[2]


def test_empty_vector_tables(spark, tiny):
    folder = tiny(embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    for name in ("op11_whitening", "op12_vector_codes"):
        assert queries.QUERIES[name](spark, folder).count() == 0
