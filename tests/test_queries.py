"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from skirmish.sources import store

DATA = Path("/root/testdata/sf0.001")
QUICK = ("rule_counts", "bad_lines", "fight_sessions", "participants", "tick_series", "merged_timeline", "merged_fights", "player_board", "raids", "known_entities", "side_events", "unmatched_lines", "resolved_foes", "heals_in_fights", "healers_and_classes", "buffs_on_players", "fight_list", "published_fights", "merged_crowds", "fitted_series", "quick_sessions", "roster_people", "folded_tail", "user_sessions", "order_attacks", "spell_dimension", "short_numbers", "fixed_names", "duel_foes", "duel_entities", "name_tests", "gated_lines", "cohorts", "tail_attacks", "anonymous_heals")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def rows(df, columns):
    plain = lambda v: None if not isinstance(v, (list, tuple)) and pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(([str(plain(v)) for v in r] for r in df[columns].astype(object).to_numpy().tolist()))


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, expected = entry.queries()[name](spark, str(DATA)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got, sorted(got.columns)) == rows(expected, sorted(got.columns))


@pytest.mark.parametrize("name", ["fight_report", "merged_crowds", "tail_attacks", "tail_series"])
def test_query_without_broadcasts(spark, name):
    """Joins of large tables are by shuffles on both sides, whose parts are put together by size."""
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for limit in limits:
        spark.conf.set(limit, "-1")
    try:
        test_query(spark, name)
    finally:
        for limit in limits:
            spark.conf.unset(limit)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    """Only a local session may do without a folder that all share."""

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_folder(Session)


def test_stored_once_follows_its_files(spark, tmp_path):
    made = []
    for k in (0, 0, 1):
        if not (tmp_path / f"t{k}").exists():
            spark.range(k + 1).write.parquet(str(tmp_path / f"t{k}"))
        source = spark.read.parquet(str(tmp_path / f"t{k}"))
        found = store.stored_once(source, "t", lambda s=source: made.append(1) or s.selectExpr("id * 2 AS id"))
        assert found.count() == k + 1
    assert len(made) == 2


def test_stored_once_sees_a_file_rewritten_under_its_name(spark, tmp_path):
    at = tmp_path / "events with blank.parquet"
    con = duckdb.connect()
    for n in (5, 3):
        con.execute(f"COPY (SELECT range AS id FROM range({n})) TO '{at}' (FORMAT parquet)")
        source = spark.read.parquet(str(at))
        assert store.stored_once(source, "r", lambda s=source: s.selectExpr("id + 1 AS id")).count() == n
