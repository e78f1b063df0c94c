import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from skirmish.llm import queries
from skirmish.llm import suffix_dedup as sd


def brute(rows, size):
    seen = Counter(b[i : i + size] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - size + 1))
    out = []
    for doc, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        runs = sum(1 for i, y in enumerate(gone) if y and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), sum(x & 0xC0 != 0x80 for x in kept)))
    return sorted(out, key=str)


def texts(size, letters, seed, n=50):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(50)]
    passage = " ".join(r.choice(words) for _ in range(size))
    rows = []
    for i in range(n):
        kind = r.random()
        t = " ".join(r.choice(words) for _ in range(r.randint(0, size)))
        if kind < 0.4:
            at = r.randint(0, len(t))
            t = t[:at] + passage[r.randint(0, 20) : len(passage) - r.randint(0, 20)] + t[at:]
        elif kind < 0.6 and rows:
            t = rows[r.randrange(len(rows))][1] or ""
            at = r.randint(0, len(t))
            t = t[:at] + "é" + t[at + 1 :]
        elif kind < 0.65:
            t = "a" * r.randint(0, 3 * size)
        elif kind < 0.7:
            t = None
        rows.append((i, t))
    return rows + rows[:2] + [(None, passage)]


@pytest.mark.parametrize(("shard", "hot"), [(sd.SHARD, sd.HOT), (500, 900)])
@pytest.mark.parametrize(("size", "letters", "seed"), [(40, "abcdefgh", 1), (30, "ab", 2)])
def test_against_brute_force(spark, monkeypatch, size, letters, seed, shard, hot):
    """Also with anchors dealt over several shards, so that merging by binary search decides."""
    rows = texts(size, letters, seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = sd.repeated_spans
    monkeypatch.setattr(sd, "repeated_spans", lambda d, n: plain(d, n, shard, hot))
    assert sorted(map(tuple, sd.removal_report(df, size).collect()), key=str) == brute(rows, size)


@pytest.mark.parametrize(("shard", "hot"), [(sd.SHARD, sd.HOT), (500, 900)])
@pytest.mark.parametrize(("size", "short", "letters", "seed"), [(40, 25, "abcdefgh", 1), (30, 20, "ab", 2), (60, 20, "ab", 3)])
def test_shorter_passages_are_counted_but_stay(spark, monkeypatch, size, short, letters, seed, shard, hot):
    """What is removed is the same; the bytes of passages below min_bytes are seen too."""
    rows = texts(size, letters, seed)
    passage = texts(short, "mnopqrst", seed)[-1][1][: short + 5]
    rows = [(i, None if t is None else t + passage if i is not None and i % 7 == 0 else t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = sd.repeated_spans
    monkeypatch.setattr(sd, "repeated_spans", lambda d, n: plain(d, n, shard, hot))
    expected = sorted(((*a, b[2]) for a, b in zip(brute(rows, size), brute(rows, short), strict=True)), key=str)
    assert sorted(map(tuple, sd.removal_report(df, size, short).collect()), key=str) == expected
    assert any(r[6] > 0 == r[2] for r in expected)


def test_query_sees_passages_of_51_words(spark, tmp_path):
    """51 words in fewer than 400 bytes, shared by two documents: nothing is removed, but the passage is counted."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    own = [" ".join(word() for _ in range(80)) for _ in range(3)]
    passage = " ".join(word() for _ in range(51))
    rows = [(0, f"{own[0]} {passage} x"), (1, f"{passage} {own[1]}"), (2, own[2])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(passage) < sd.MIN_BYTES and all(x["n_removed"] == 0 for x in got.values())
    assert got[0]["n_passage_bytes"] >= len(passage) and got[1]["n_passage_bytes"] >= len(passage) and got[2]["n_passage_bytes"] == 0


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(1)
    for t in range(60):
        n = int(r.integers(1, 200))
        d = r.integers(97, 97 + int(r.integers(1, 4)), n).astype(np.uint8)
        if t % 3 == 0:
            d = np.tile(d[: max(1, n // 5)], 6)[:n]
        b = d.tobytes()
        sa, rank = sd.suffix_array(d)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        assert (rank[sa] == np.arange(1, len(b) + 1)).all()
        shared = sd.common_prefixes(d, sa, 40)
        for k in range(1, len(b)):
            x, y = b[sa[k - 1] :], b[sa[k] :]
            assert shared[k] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_long_texts_are_cut_without_loss():
    ends = np.array([70, 300])
    pieces = list(sd._cut_long(ends, 40, 100))
    assert pieces == [(0, 139), (100, 239), (200, 300)]


def test_remove_repeats(spark, docs):
    passage = "ö" * 220 + " and so on "
    rows = [(1, "one " + passage + " end", "en", "a"), (2, "two " + passage + "x", "en", "a"), (3, "clean", "en", None), (4, None, None, None), (5, "", "en", "a")]
    got = {r["doc_id"]: r for r in sd.remove_repeats(docs(rows, extra=True)).collect()}
    assert got[3]["text"] == "clean" and got[4]["text"] is None and got[5]["text"] == ""
    assert passage[:200] not in got[1]["text"] and got[1]["text"].startswith("one") and got[1]["n_chars"] == len(got[1]["text"])
    assert sd.remove_repeats(docs(rows).where("doc_id < 0")).count() == 0
