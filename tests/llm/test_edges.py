"""Empty tables, columns with clashing names, repeats and ties; and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from skirmish.llm import fingerprint, langid, mixing, queries, simhash, suffix_dedup, topk

CLASH = ("_id", "_key", "_n", "_i", "_hash", "_text_hash", "_spans", "_runs", "_nth", "_times", "_copy", "_o", "_b", "_r", "copies", "component_id", "fingerprint", "_of", "score", "lang_pred")


def _clashing(df):
    return df.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASH})


def _prose(seed, n=120, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in ("op3_exact_top_k", "op7_chat_format", "op11_whitening", "op12_vector_codes")])
def test_empty_documents(spark, docs, tiny, name):
    folder = tiny(documents=docs([(1, "x", "en", "s")]).where("doc_id < 0"))
    assert queries.QUERIES[name](spark, folder).count() == 0


def test_other_empty_tables(spark, tiny):
    folder = tiny(embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"), conversations=spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert queries.op3_exact_top_k(spark, folder).count() == 0
    # the conversation that the query adds
    assert [r["conv_id"] for r in queries.op7_chat_format(spark, folder).collect()] == [-1]


def test_clashing_columns_keep_their_values(spark, docs):
    passage = " ".join(f"shared{i}" for i in range(80))
    rows = [(i, _prose(i), "en", f"s{i % 2}") for i in range(12)] + [(20, _prose(1), "en", "s0"), (21, passage + " " + _prose(31), "en", "s0"), (22, _prose(32) + " " + passage, "en", "s1"), (22, _prose(32) + " " + passage, "en", "s1"), (30, None, "en", None)]
    df = _clashing(docs(rows))
    for out in (cp.language_id(spark, df, ""), mixing.mixed(df), suffix_dedup.remove_repeats(df), simhash.one_of_each(df)):
        found = out.collect()
        assert out.columns == df.columns and found
        assert all(r[c] == f"{c}-{r['doc_id']}" for r in found for c in CLASH)
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(df).collect())
    assert kept == [*range(12), 21, 22, 30]
    plain = Counter(r["doc_id"] for r in mixing.mixed(docs(rows)).collect())
    assert plain == Counter(r["doc_id"] for r in mixing.mixed(df).collect())


def test_repeated_rows_take_what_the_mix_gives_them(spark, docs):
    rows = [(1, "a b c", "en", "x")] * 9 + [(2, "d e", "en", "x"), (3, "f g h i", "en", "y"), (4, "j", "en", "y")]
    df = docs(rows)
    plan = Counter()
    for r in mixing.mix(df).collect():
        plan[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixing.mixed(df).collect()) == +plan


def test_top_k_with_repeated_ids_and_ties(spark):
    vectors = [(100, [1, 2]), (1, [3, 0]), (1, [3, 0]), (2, [1, 1]), (3, [1, 1]), (100, [9, 9])]
    rows = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    got = sorted(map(tuple, topk.top_k(rows.where("vec_id = 100"), rows, 3).collect()))
    best = []
    for q, v in vectors:
        if q == 100:
            best += [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != 100]
    assert [(r, i, s) for _, r, i, s in got] == [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(best)[:3])]


def test_naive_bayes_against_a_plain_one(spark, docs):
    r = random.Random(4)
    alphabets = {"aa": "abcde fg", "bb": "acegi kö", "cc": "xyzab  -"}
    rows = [(i, "".join(r.choice(alphabets[k]) for _ in range(r.randint(1, 60))), k, "s") for i, k in enumerate(r.choice(list(alphabets)) for _ in range(120))]
    df = docs(rows)
    got = {x["doc_id"]: x["lang_pred"] for x in langid.predict(spark, df, langid.train(df)).collect()}

    def buckets(text):
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        out = Counter()
        for codes, owners in [(codes, np.zeros(len(codes), np.int32))] if len(codes) else []:
            for found, _ in langid._grams(codes, owners):
                out.update(found.tolist())
        return out

    counts = {k: Counter() for k in alphabets}
    for _, t, k, _ in rows:
        counts[k] += buckets(t)
    total = {k: sum(c.values()) + langid.ALPHA * langid.BUCKETS for k, c in counts.items()}
    close = 0
    for i, t, _, _ in rows:
        own = buckets(t)
        score = sorted(((sum(n * math.log((counts[k][b] + langid.ALPHA) / total[k]) for b, n in own.items()), k) for k in alphabets), key=lambda x: (-x[0], x[1]))
        if not own:
            assert got[i] == langid.UNKNOWN
        elif score[0][0] - score[1][0] > 1e-3:
            assert got[i] == score[0][1]
        else:
            close += 1
    assert close < 5


def test_a_tie_goes_to_the_first_language(spark, docs):
    df = docs([(1, "abc", "zz", "s"), (2, "abc", "aa", "s"), (3, "abc", None, "s")])
    assert {r["lang_pred"] for r in langid.predict(spark, df, langid.train(df)).collect()} == {"aa"}


def test_sketches_against_plain_ones(spark, docs, tiny):
    rows = [(i, t, "en", "s") for i, t in enumerate([None, "", "one two", _prose(1, 900), _prose(1, 900)[1500:], _prose(2, 30), "a " * 40])]
    got = {r["doc_id"]: r for r in queries.op5_fingerprint(spark, tiny(documents=docs(rows))).collect()}
    hashes = spark.createDataFrame([(i, " ".join(w[k : k + 5])) for i, t, _, _ in rows for w in [(t or "").split()] for k in range(max(1, len(w) - 4)) if w], "doc_id long, s string")
    words = F.transform(F.split("s", " "), lambda w: F.xxhash64(w))
    # a shingle of fewer than five words has nulls for the rest, which a hash passes over
    shingles = hashes.select("doc_id", F.xxhash64(*[F.get(words, F.lit(k)) for k in range(5)]).alias("h")).distinct().collect()
    sets = {i: {x["h"] & (1 << 64) - 1 for x in shingles if x["doc_id"] == i} for i, *_ in rows}
    plain = {i: sorted((h for h in s if h >> 61 == 0), key=lambda h: h) or sorted(s)[:1] for i, s in sets.items()}
    for i, *_ in rows:
        assert got[i]["fingerprint"] == "".join(f"{h:016x}" for h in plain[i])
        after = set(plain[(i - 1) % len(rows)])
        every = set(plain[i]) | after
        assert got[i]["near_next"] == pytest.approx(len(set(plain[i]) & after) / len(every) if every else 1.0)


def _jaccard_groups(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in ids}


def _without_repeats(texts, size=cp.PASSAGE):
    seen = Counter(b[k : k + size] for t in texts.values() for b in [t.encode()] for k in range(len(b) - size + 1))
    out = {}
    for i, t in texts.items():
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        out[i] = bytes(x for x, y in zip(b, gone, strict=True) if not y).decode()
        if any(gone) and not out[i].strip():
            del out[i]
    return out


def test_pipeline_against_brute_force(spark, docs, tiny):
    """Every stage on what the one before it gave; texts are plain ASCII, so no character is cut."""
    r = random.Random(6)
    passage = " ".join(f"share{i}" for i in range(51))
    texts = {i: _prose(i, r.randint(60, 200), 3000) for i in range(40)}
    for i in range(40, 70):
        words = texts[r.randrange(40)].split()
        for _ in range(r.choice([0, 1, 1, 2, 9])):
            words[r.randrange(len(words))] = "edit"
        texts[i] = " ".join(words)
    for i in (70, 71, 72):
        texts[i] = _prose(i) + " " + passage + " " + _prose(i + 100, 20)
    texts |= {80: "12 34", 81: None, 82: "", 83: passage}
    folder = tiny(documents=docs([(i, t, "en", f"s{i % 4}") for i, t in texts.items()]))
    kept, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        found = stage(spark, kept, folder)
        seen[name] = found.collect()
        kept = spark.createDataFrame(seen[name], found.schema)
    first = {x["doc_id"]: x["text"] for x in seen["language_id"]}
    assert first == {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    second = {x["doc_id"]: x["text"] for x in seen["near_dedup"]}
    assert set(second) == _jaccard_groups(first)
    third = {x["doc_id"]: x["text"] for x in seen["suffix_array_dedup"]}
    assert third == _without_repeats(second)
    taken = Counter(x["doc_id"] for x in seen["mixing"])
    assert set(taken) <= set(third) and max(taken.values()) <= 3
    sizes = Counter()
    for i, t in third.items():
        sizes[f"s{i % 4}"] += len(t.split())
    weights, level = dict(zip(sorted(sizes), (5, 2, 1, 5), strict=True)), {}
    free, left = set(sizes), float(sum(sizes.values()))
    while free:
        share = {k: left * weights[k] / sum(weights[x] for x in free) for k in free}
        over = {k for k in free if share[k] > 3 * sizes[k]}
        level |= {k: 3.0 * sizes[k] for k in over} if over else share
        left -= sum(3.0 * sizes[k] for k in over)
        free = free - over if over else set()
    mixed = Counter()
    for i, n in taken.items():
        mixed[f"s{i % 4}"] += n * len(third[i].split())
    assert all(abs(mixed[k] - level[k]) <= 60 for k in sizes)
    pieces = Counter()
    for x in seen["packing"]:
        pieces[x["doc_id"]] += x["length"]
    tokens = {x["doc_id"]: x["doc_tokens"] for x in seen["packing"]}
    assert pieces == {i: n * tokens[i] for i, n in taken.items()}


def test_crc_of_ids_is_that_of_their_bytes():
    ids = np.array([1, 70000, 3], np.uint32)
    from skirmish.llm.tokens import crc32

    assert crc32(ids) == zlib.crc32(b"\x01\0\0\0" + (70000).to_bytes(4, "little") + b"\x03\0\0\0")


def test_neighbours_over_ranges(spark):
    """Next rows by descending id, with as many ranges as there are cuts."""
    df = spark.createDataFrame([(i * 3 % 101, f"t{i}") for i in range(101)], "doc_id long, text string").withColumn("tie", F.lit(0)).repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(df, "doc_id", ["text"], "tie").collect()}
    by = {r["doc_id"]: r["text"] for r in df.collect()}
    assert got == {i: by[(i - 1) % 101] for i in by}
