"""The stages on planted cases, against what each must keep and drop."""

import corpus_pipeline as cp
from skirmish.llm.common import DOCUMENT_COLUMNS


def _prose(start, n=300):
    return " ".join(f"word{(start * 7919 + i * i * 31 + i) % 4001}" for i in range(n))


def test_run(spark, docs, tiny):
    passage = " ".join(f"shared{i}" for i in range(90))
    rows = [(i, _prose(i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, _prose(1), "en", "s0"), (101, _prose(2) + " tail", "en", "s1"), (102, "12 34", "en", "s0"), (103, None, "en", "s0")]
    rows += [(200, _prose(50) + " " + passage, "en", "s0"), (201, passage + " " + _prose(51), "en", "s1")]
    folder = tiny(documents=docs(rows))
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        kept = stage(spark, kept, folder)
        seen[name] = kept.collect()
        if name != "packing":
            assert kept.columns == list(DOCUMENT_COLUMNS)
            kept = spark.createDataFrame(seen[name], kept.schema)
    clean = set(range(30)) | {200, 201}
    assert {r["doc_id"] for r in seen["language_id"]} == clean | {100, 101}
    assert {r["doc_id"] for r in seen["near_dedup"]} == clean
    after = {r["doc_id"]: r for r in seen["suffix_array_dedup"]}
    assert set(after) == clean and all("shared40" not in after[i]["text"] and after[i]["n_chars"] == len(after[i]["text"]) for i in (200, 201))
    assert all(after[i]["text"] == _prose(i) for i in range(30))
    assert [name for name, _ in cp.STAGES] == ["language_id", "near_dedup", "suffix_array_dedup", "mixing", "packing"]
    packed = cp.run(spark, folder)
    assert sorted(map(tuple, packed.select("doc_id", "start", "ids_crc32").collect())) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in seen["packing"])
