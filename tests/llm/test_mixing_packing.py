import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from skirmish.llm import binary_output, mixing, packing, topk
from skirmish.llm.queries import op3_exact_top_k, op4_mixing, op9_binary_output, op10_packing
from skirmish.llm.tokens import TextEncoder, tokenizer_path

ODD = [None, "", " ", "  a  b ", "a \n b", "\n\nx", " lead", "trail ", "a\x01b c", "it's <|endoftext|> ok", "ΑΣ ΣΑ Σ İx", "x\t y", "é e\u0301 ́a", "a\x1c b", "tail\n", "word " * 900]


def _ids(name, special_as_text=False):
    t = Tokenizer.from_file(tokenizer_path(name))
    if special_as_text:
        t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_library_ids(name):
    r = random.Random(1)
    texts = ODD + [" ".join(r.choice(["the", "Über", "x.y", "it's", "12,5", "\n", "", "—", "日本"]) for _ in range(30)) for _ in range(50)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|startoftext|>y " * 3, "<|ENDOFTEXT|>", "end <|endoftext|>"]
    for special_as_text in (False, True):
        ids, sizes = TextEncoder(tokenizer_path(name), special_as_text).encode(texts)
        expected = _ids(name, special_as_text)(texts)
        assert sizes.tolist() == [len(x) for x in expected]
        assert ids.tolist() == [i for x in expected for i in x]


def test_the_plain_call_gives_special_ids():
    for name, ids in (("word_bpe_49k.json", [320, 49407, 321]), ("byte_bpe_50k.json", [64, 220, 50256, 275])):
        assert TextEncoder(tokenizer_path(name)).encode(["a <|endoftext|> b"])[0].tolist() == ids


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr("skirmish.llm.tokens.CACHE", 2000)
    encoder, texts = TextEncoder(tokenizer_path("byte_bpe_50k.json")), [f"word{i} and word{i + 1}" for i in range(60)]
    for at in range(0, 60, 10):
        ids, _ = encoder.encode(texts[at : at + 10])
        assert ids.tolist() == [i for x in _ids("byte_bpe_50k.json")(texts[at : at + 10]) for i in x]
        assert encoder.words.held < 2000 + 10 * 3 * 110


def test_packing(spark, docs, tiny):
    rows = [(i, t, "en", "s") for i, t in enumerate([*ODD, "long text " * 3000, "long text " * 3000])]
    got = op10_packing(spark, tiny(documents=docs([*rows, (4, "a \n b", "en", "s")], extra=True))).toPandas()
    every = {i: [*x, 1] for (i, *_), x in zip(rows, _ids("byte_bpe_50k.json")([t for _, t, _, _ in rows]), strict=True)}
    for p in got.itertuples():
        ids = every[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert got.length.sum() == sum(map(len, every.values())) + len(every[4])
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    empty = docs(rows).where("doc_id < 0")
    assert packing.pack(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_patterns_hold_the_histogram():
    r = np.random.default_rng(3)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(np.minimum(64, r.integers(1, 70, 4000)), return_counts=True), strict=True)}
    patterns = packing.pack_histogram(histogram, 64)
    found = {}
    for p in patterns:
        assert sum(k * n for k, n in p.runs) <= 64
        for k, n in p.runs:
            found[k] = found.get(k, 0) + n * p.count
    assert found == histogram
    assert sum(p.count for p in patterns) <= 1.02 * sum(k * n for k, n in histogram.items()) / 64 + 1


def test_binary_output(spark, docs, tiny):
    rows = [(7 * i % 41, t, "en", "s") for i, t in enumerate([*ODD, "many words here " * 4000])]
    got = sorted(op9_binary_output(spark, tiny(documents=docs(rows, extra=True))).collect(), key=lambda r: r["doc_id"])
    rows.sort(key=lambda r: r[0])
    start = 0
    for row, (doc, *_), ids in zip(got, rows, _ids("word_bpe_49k.json")([t for _, t, _, _ in rows]), strict=True):
        ids = [*ids, 1]
        assert tuple(row)[:4] == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_sequences_by_row(spark, docs, tmp_path):
    manifest = binary_output.write(docs([(1, "some words", "en", "s"), (2, None, "en", "s")]), tokenizer_path("word_bpe_49k.json"), f"file://{tmp_path}/out", length=4)
    file = manifest.where("n_docs > 0").first()
    ids, mask = binary_output.Sequences(file["ids_file"]).sequence(0)
    assert len(ids) == 4 and mask.sum() == min(4, file["n_ids"])


def _fill(sizes, weights):
    cap, target, free, left = [3.0 * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        for i in free:
            target[i] = left * weights[i] / total
        over = {i for i in free if target[i] > cap[i] + 1e-9}
        if not over:
            break
        for i in over:
            target[i] = cap[i]
        free -= over
        left = sum(sizes) - sum(cap[i] for i in range(len(sizes)) if i not in free)
    return target


def test_mixing(spark, docs, tiny):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 60) if i % 17 else None, "en", [None, "a", "é", "Z", "b"][min(4, int(r.random() ** 2 * 5))]) for i in range(400)]
    rows += [(400, "w " * 30, "en", "tiny"), (None, "x y", "en", "a"), (3, rows[3][1], "en", rows[3][3])]
    got = op4_mixing(spark, tiny(documents=docs(rows, extra=True))).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    sources = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, _, s in rows if s == x) for x in sources]
    expected = dict(zip(sources, _fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))]), strict=True))
    by_size = dict(zip(sizes, sources, strict=True))
    for whole, part in got.groupby("source_size"):
        target = expected[by_size[whole]]
        assert abs(part.target.iloc[0] - target) < 1e-6 and abs(part.taken.sum() - target) <= 2
    again = mixing.mixed(docs(rows, extra=True))
    assert again.columns == docs(rows, extra=True).columns
    assert sum(len((x["text"] or "").split()) for x in again.collect()) == got.taken.sum()
    assert mixing.mix(docs(rows).where("doc_id < -1")).count() == 0


def test_fit_is_exact_where_it_can_be():
    sizes, counts = np.array([3, 7, 500]), np.array([4, 2, 10])
    for budget in range(0, int((sizes * counts).sum()) + 5):
        take = mixing.fit(sizes, counts, budget)
        assert (take <= counts).all() and (take * sizes).sum() <= budget
    assert (mixing.fit(np.array([2, 5]), np.array([10, 10]), 31) * [2, 5]).sum() == 31
    assert (mixing.fit(np.arange(1, 2000), np.full(1999, 50), 60_000_001) * np.arange(1, 2000)).sum() == 60_000_001


def test_top_k(spark, tiny):
    r = np.random.default_rng(6)
    vectors = r.integers(-3, 4, (350, 6)) / 8
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(400, None, 0), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (402, [float("nan")] * 6, 0), (403, [float("inf")] + [0.0] * 5, 0), (404, [], 0), (None, [1.0] * 6, 0), (500, [0.0] * 6, 0)]
    got = op3_exact_top_k(spark, tiny(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))).toPandas()
    ids = np.array([*range(350), 500])
    whole = np.floor(1024 * np.vstack([vectors, np.zeros(6)])).astype(np.int64)
    for query, found in got.groupby("query_id"):
        scores = whole @ whole[list(ids).index(query)]
        best = [k for k in np.lexsort((ids, -scores)) if ids[k] != query][:10]
        found = found.sort_values("rank")
        assert found.vec_id.tolist() == ids[best].tolist() and found.score.tolist() == scores[best].tolist() and found["rank"].tolist() == list(range(1, 11))
    assert set(got.query_id) == {0, 100, 200, 300, 500}


def test_top_k_over_blocks_and_large_numbers(spark):
    r = np.random.default_rng(7)
    v = r.integers(-(2**45), 2**45, (60, 3)).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, v array<long>")
    small = spark.createDataFrame([(i, [x // 2**30 for x in y]) for i, y in enumerate(v)], "vec_id long, v array<long>")
    for given in (small, df.selectExpr("vec_id", "transform(v, x -> x div 16384) AS v")):
        rows = {x["vec_id"]: x["v"] for x in given.collect()}
        got = topk.top_k(given.where("vec_id < 7"), given, 4, block=9, group=3).collect()
        for q in range(7):
            expected = sorted(((-sum(a * b for a, b in zip(rows[q], w, strict=True)), i) for i, w in rows.items() if i != q))[:4]
            assert [(-x["score"], x["vec_id"]) for x in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == expected
