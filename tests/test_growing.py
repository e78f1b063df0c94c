"""Logs that grow: offsets as bytes, ranges that cut lines, streams over appended files and restarts."""

import gzip
import random

import pytest

from skirmish.sources import growing, logs


def _text(seed, n):
    r = random.Random(seed)
    return b"".join(b"[x] " + bytes(97 + r.randrange(26) for _ in range(r.randrange(30))) + r.choice([b"\n", b"\r\n"]) for _ in range(n))


def _plain(data, start=0):
    at, out = start, []
    for piece in data[start:].split(b"\n"):
        out.append((at, piece.removesuffix(b"\r").decode()))
        at += len(piece) + 1
    return out[:-1] if not data or data.endswith(b"\n") else out


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
@pytest.mark.parametrize("start", [0, 100, -50, 5, -100_000, 100_000])
def test_ranges_give_each_line_once(tmp_path, size, start):
    data = _text(1, 60) + b"no line break"
    path = str(tmp_path / "eqlog_Larry_test.txt")
    (tmp_path / "eqlog_Larry_test.txt").write_bytes(data)
    first = growing.start_at(len(data), start)
    assert first == (100 if start == 100 else 5 if start == 5 else len(data) - 50 if start == -50 else 0)
    found = []
    for part in growing.ranges(path, first, len(data), size):
        for batch in growing.read_range(part):
            found += list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
    assert found == _plain(data, first)


def test_long_lines_reach_over_many_reads(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "_READ", 10)
    data = b"a" * 95 + b"\n" + b"\n" + b"b" * 33 + b"\r\nend"
    (tmp_path / "x").write_bytes(data)
    for size in (3, 20, 1000):
        found = [r for p in growing.ranges(str(tmp_path / "x"), 0, len(data), size) for b in growing.read_range(p) for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        assert found == _plain(data)


def test_batches(spark, tmp_path):
    data = _text(2, 500)
    (tmp_path / "eqlog_Larry_test.txt").write_bytes(data)
    with gzip.open(tmp_path / "eqlog_Moe_erollisi.txt.gz", "wb") as f:
        f.write(data)
    rows = growing.read_bytes(spark, str(tmp_path), size=1000)
    assert rows.rdd.getNumPartitions() > 5
    found = rows.collect()
    for log, owner, server in (("eqlog_Larry_test.txt", "Larry", "test"), ("eqlog_Moe_erollisi.txt", "Moe", "erollisi")):
        mine = sorted((r["seq"], r["line"]) for r in found if r["log_id"] == log)
        assert mine == _plain(data) and {(r["owner"], r["server"]) for r in found if r["log_id"] == log} == {(owner, server)}
    late = growing.read_bytes(spark, f"file://{tmp_path}/eqlog_Larry_test.txt", start=-200).collect()
    assert sorted((r["seq"], r["line"]) for r in late) == _plain(data, len(data) - 200)
    assert sorted(r["line"] for r in logs.read_logs(spark, str(tmp_path / "eqlog_Larry_test.txt")).collect()) == sorted(x for _, x in _plain(data))
    (tmp_path / "none").mkdir()
    assert growing.read_bytes(spark, str(tmp_path / "none")).count() == 0


def test_stream_takes_what_was_added_once(spark, tmp_path):
    data, log = _text(3, 300), tmp_path / "in" / "eqlog_Larry_test.txt"
    log.parent.mkdir()

    def run():
        q = growing.stream_growing(spark, str(log.parent), size=500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r["log_id"], r["seq"], r["line"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    plain = lambda upto: [(log.name, *x) for x in _plain(data[:upto])]
    cut = data.index(b"\n", 2000) + 1
    log.write_bytes(data[: cut + 3])  # three bytes of a line that is still being written
    assert run() == plain(cut)
    assert run() == plain(cut)
    log.write_bytes(data[: cut + 3] + data[cut + 3 :])  # a restarted query goes on where it was
    other = log.parent / "eqlog_Moe_test.txt"
    other.write_bytes(b"hello\nyou\n")
    assert run() == sorted([*plain(len(data)), (other.name, 0, "hello"), (other.name, 6, "you")])
