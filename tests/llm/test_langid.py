import zlib

import numpy as np

from skirmish.llm import langid
from skirmish.llm.queries import op1_language_id

EN = "the quick brown fox jumps over the lazy dog and then goes home "
DE = "der schnelle braune fuchs springt über den faulen hund und geht heim "


def _rows(n=40):
    return [(i, (EN if i % 2 else DE) * (1 + i % 3), "en" if i % 2 else "de", "s") for i in range(n)]


def test_held_out_accuracy(spark, docs, tiny):
    got = {r["doc_id"]: r for r in op1_language_id(spark, tiny(documents=docs(_rows()))).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and {i for i, r in got.items() if r["held_out"]} == set(held)
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") and 0 <= got[i]["score"] <= 1 for i in held)


def test_edges(spark, docs):
    rows = [*_rows(8), (90, None, "en", None), (91, "", "de", "s"), (92, "12 !? 34", "en", "s"), (None, EN, None, None), (93, EN * 40_000, "en", "s"), (93, EN * 40_000, "en", "s")]
    df = docs(rows, extra=True)
    model = langid.train(df)
    got = langid.predict(spark, df, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert {i: (by[i]["lang_pred"], by[i]["score"]) for i in (90, 91, 92)} == dict.fromkeys((90, 91, 92), ("und", 0.0))
    assert by[93]["lang_pred"] == "en" and by[None]["lang_pred"] == "en" and by[93]["rank"] == 2


def test_empty_table(spark, docs):
    df = docs([(1, EN, "en", "s")]).where("doc_id < 0")
    model = langid.train(df)
    assert model.langs == [] and langid.predict(spark, df, model).count() == 0
    one = langid.predict(spark, docs([(1, EN, "en", "s")]), model).first()
    assert (one["lang_pred"], one["score"]) == ("und", 0.0)


def test_blocks_count_every_gram(monkeypatch):
    text = EN * 50
    whole = np.concatenate([b for block in langid._blocks([text]) for b, _ in langid._grams(*block)])
    monkeypatch.setattr(langid, "_BLOCK", 37)
    cut = np.concatenate([b for block in langid._blocks([text]) for b, _ in langid._grams(*block)])
    assert sorted(whole.tolist()) == sorted(cut.tolist())
