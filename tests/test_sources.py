"""Readers, writers, reports and streams on small files."""

import datetime
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from skirmish.functions import text as names
from skirmish.operators import merge
from skirmish.operators.fights import assign_fights, fight_table
from skirmish.operators.lines import split_lines
from skirmish.operators.rules import extract_events
from skirmish.plans import reports
from skirmish.sources import logs, rosters, sinks, spells, store
from skirmish.streaming import live

LINE = "[Sun Jul 05 20:31:{:02d} 2020] {}"


def test_read_logs(spark, tmp_path):
    path = tmp_path / "eqlog_pELL_vox-2020-07-05.txt"
    path.write_text("\n".join(LINE.format(i, f"You slash a rat for {i} points of damage.") for i in range(5)))
    rows = logs.read_logs(spark, str(path)).orderBy("seq").collect()
    assert [(r["owner"], r["server"]) for r in rows][:1] == [("Pell", "vox")]
    assert [r["line"][-20:] for r in rows] == [LINE.format(i, f"You slash a rat for {i} points of damage.")[-20:] for i in range(5)]
    events = extract_events(split_lines(logs.read_logs(spark, str(path)), "America/New_York")).orderBy("seq").collect()
    assert events[0]["source"] == "Pell" and events[0]["ts"].hour == 0
    assert [r["seq"] for r in logs.numbered(logs.read_logs(spark, str(path))).orderBy("seq").collect()] == [1, 2, 3, 4, 5]


def test_spells(spark, tmp_path):
    def row(number, name, target, formula, cap, levels):
        f = ["0"] * spells.FIELDS
        f[0], f[1], f[11], f[12], f[30] = str(number), name, str(formula), str(cap), str(target)
        f[36:52] = [str(levels.get(k, 255)) for k in range(16)]
        return "^".join(f)

    (tmp_path / "s.txt").write_text("\n".join([row(1, "Fire", 5, 1, 0, {11: 10}), row(2, "Fire", 5, 3, 100, {3: 20}), row(3, "Mend Pet", 14, 50, 10, {12: 5}), "too^short"]))
    (tmp_path / "str.txt").write_text("#id\n1^a^b^You burn.^ burns.^Fire fades.^\n3^a^b^^ is mended.^^\n")
    got = {r["name"]: r for r in spells.read_spells(spark, str(tmp_path / "s.txt"), str(tmp_path / "str.txt")).collect()}
    assert (got["Fire"]["classes"], got["Fire"]["class_count"], got["Fire"]["duration_ticks"], got["Fire"]["land_others"]) == ("RNG,WIZ", 2, 127, " burns.")
    assert (got["Mend Pet"]["duration_ticks"], got["Mend Pet"]["land_pet"]) == (10, " is mended.") and got["Fire"]["land_pet"] is None


def test_rosters_registry_and_templates(spark, tmp_path):
    (tmp_path / "RaidRoster_erollisi-20200101-120000.txt").write_text("0\tHollin\t115\tRanger\tRaid Leader\n")
    (tmp_path / "Guild_erollisi-20200102-120000.txt").write_text("Larry\t60\tShadow Knight\tMember\nbad line\n")
    got = {r["name"]: (r["level"], r["class"], str(r["ts"])) for r in rosters.read_rosters(spark, str(tmp_path), "erollisi").collect()}
    assert got == {"Hollin": (115, "RNG", "2020-01-01 12:00:00"), "Larry": (60, "SHD", "2020-01-02 12:00:00")}
    day = F.lit("2024-02-01").cast("date")
    text = spark.createDataFrame([("Bob:RNG::2024-01-30;Jabober::Bob:2024-01-20;Kebartik::Bob:2024-01-31;Old:WAR::2023-01-01;bad;A:B;",)], "data string")
    assert {r["name"]: (r["class"], r["owner"], r["is_player"]) for r in rosters.import_registry(text, day).collect()} == {"Bob": ("RNG", None, True), "Kebartik": (None, "Bob", False)}
    told = spark.createDataFrame([("B", "RNG", None, True, datetime.date(2024, 1, 2)), ("P", None, "B", False, datetime.date(2024, 1, 3)), ("X", "WAR", "Y", False, datetime.date(2024, 1, 3))], "name string, class string, owner string, is_player boolean, updated_on date")
    assert rosters.registry_text(rosters.export_registry(told)).first()["data"] == "B:RNG::2024-01-02;P::B:2024-01-03;"
    (tmp_path / "raids.xml").write_text('<Raids><Raid><Name>R</Name><Zone>Z</Zone><Mob>A</Mob><Mob EndsOnDeath="true">B</Mob></Raid><Raid><Name>S</Name><Zone>Z</Zone></Raid><Raid><Name>T</Name></Raid></Raids>')
    assert sorted(map(tuple, rosters.read_raid_templates(spark, str(tmp_path / "raids.xml")).collect())) == [("R", "Z", "A", False), ("R", "Z", "B", True), ("S", "Z", "S", False)]


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "fight_id string, x int")
    for df in (one, one, spark.createDataFrame([("c", 3)], one.schema)):
        sinks.write_once(df, path)
    assert sorted(r["fight_id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_write_once_reads_the_parts_of_its_keys_alone(spark, tmp_path, capsys):
    path = str(tmp_path / "out")
    ids = spark.range(2000).selectExpr("concat('f', id) AS fight_id", "id AS x")
    sinks.write_once(ids, path)
    batch = ids.where("x in (7, 8)").unionByName(spark.createDataFrame([("new", 1)], "fight_id string, x long"))
    fresh = sinks.unwritten(batch, path, "fight_id")
    assert [r["fight_id"] for r in fresh.collect()] == ["new"]
    fresh.explain("formatted")
    parts = {r[0] for r in batch.select(sinks.part_of("fight_id")).collect()}
    told = capsys.readouterr().out
    filters = [x for x in told.splitlines() if "PartitionFilters" in x and "key_part" in x]
    assert filters and all(str(k) in filters[0] for k in parts)
    for _ in range(2):
        sinks.write_once(batch, path)
    assert spark.read.parquet(path).count() == 2001


def test_functions(spark):
    df = spark.createDataFrame([(999, "Long name here"), (1250, "x"), (78_400, "y"), (4_560_000, "z"), (1_234_000_000, "w")], "n long, s string")
    assert [r[0] for r in df.orderBy("n").select(names.fmt_num(F.col("n"))).collect()] == ["999", "1.3K", "78K", "4.56M", "1.23B"]
    row = spark.range(1).select(names.clip(F.lit("Long name here"), 8), names.pet_owner(F.lit("Bob`s warder")), names.pet_owner(F.lit("Eye of Al")), names.strip_rank(F.lit("Rime Lance Rk. II")), names.is_pet_name(F.lit("Jabober")), names.fix_name(F.lit("YOUR"), F.lit("Me"))).first()
    assert tuple(row) == ("Long n..", "Bob", "Al", "Rime Lance", True, "Me")


def _chunks(folder, chunks):
    folder.mkdir()
    for k, chunk in enumerate(chunks):
        path = folder / f"eqlog_Me_test-{k}.txt"
        path.write_text("\n".join(chunk))
        os.utime(path, (1600000000 + k, 1600000000 + k))  # chunks are taken in the order of their times
    return str(folder)


def _with_mobs(rows):
    mob = F.when(F.col("source").startswith("Mob"), F.col("source")).when(F.col("target").startswith("Mob"), F.col("target"))
    return rows.withColumn("foe", F.when(F.col("kind") == "death", F.col("name")).when(F.col("kind").isin("hit", "miss"), mob))


def _ran(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_stream_of_fights(spark, tmp_path):
    lines = ["A slashes Mob0 for 10 points of damage.", "Mob0 bites A for 5 points of damage.", "A slashes Mob1 for 7 points of damage.", "Mob0 has been slain by A!"]
    # a new fight opens in the second in which the old one ended, after the death
    again = [LINE.format(3, "A slashes Mob0 for 1 point of damage.")]
    late = ["[Sun Jul 05 20:01:00 2020] A slashes Mob2 for 9 points of damage."]
    chunks = [[LINE.format(i, x) for i, x in enumerate(lines)] + again, [LINE.format(40, "A slashes Mob1 for 3 points of damage.")], ["[Sun Jul 05 21:31:00 2020] A slashes Mob3 for 1 points of damage."], late]
    lines = logs.stream_logs(spark, _chunks(tmp_path / "in", chunks), 1).withColumn("log_id", F.lit("log"))
    found = live.stream_fights(_with_mobs(live.live_events(lines)), opened=True)
    query = _ran(live.publish(found, str(tmp_path / "out"), str(tmp_path / "state"), ["log_id", "foe", "started_on", "status"]))
    got = sorted((r["foe"], r["started_on"].second, r["status"], r["hp"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("Mob0", 0, "Killed", 10), ("Mob0", 0, "Open", 0), ("Mob0", 3, "Open", 0), ("Mob0", 3, "Timeout", 1), ("Mob1", 2, "Open", 0), ("Mob1", 2, "Timeout", 7), ("Mob1", 40, "Open", 0), ("Mob1", 40, "Timeout", 3), ("Mob3", 0, "Open", 0)]
    assert live.late_rows(query) == 1


def test_stream_of_drops(spark, tmp_path):
    first = ["--A has looted a Nail from Rat's corpse.--", "You have entered Orr.", "--A has looted a Nail from Rat's corpse.--"]
    second = ["--2 Cup were left on Rat's corpse.--", "--A has looted a Rag from Rat's corpse.--", "--A has looted a Bag.--"]
    lines = logs.stream_logs(spark, _chunks(tmp_path / "in", [[LINE.format(5, x) for x in first], [LINE.format(9, x) for x in second]]), 1).withColumn("log_id", F.lit("log"))
    _ran(live.append_json(live.stream_drops(live.live_events(lines), spark.sql("SELECT 'Rag' AS item")), str(tmp_path / "out"), str(tmp_path / "state")))
    assert sorted((r["zone"], r["mob"], r["item"]) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("Orr", "Rat", "Cup"), ("Orr", "Rat", "Nail")]


def test_buffs_move_with_their_fights(spark):
    fights = spark.sql("SELECT 'a' AS fight_id, timestamp_seconds(0) AS started_on, timestamp_seconds(11) AS updated_on UNION ALL SELECT 'b', timestamp_seconds(600), timestamp_seconds(611)")
    buffs = spark.sql("SELECT explode(array('a', 'b')) AS fight_id, 'N' AS name, 'S' AS spell, 3L AS time")
    assert sorted(r["time"] for r in merge.shifted_buffs(fights.selectExpr("'m' AS merge_id", "fight_id"), fights, buffs).collect()) == [3, 15]


def test_write_once_needs_its_key(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(AnalysisException):
        sinks.write_once(spark.createDataFrame([("a", 1)], "fight_id string, x int"), str(tmp_path / "other"))
    sinks.write_json(spark.range(3), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_dates_and_sessions(spark):
    day = F.lit("2024-06-01").cast("timestamp")
    row = spark.range(1).select(names.fmt_date(F.lit("2024-02-03 04:05:06").cast("timestamp"), day), names.fmt_date(F.lit("2023-02-03 04:05:06").cast("timestamp"), day), logs.is_standard_server(F.lit("teek")), logs.is_standard_server(F.lit("vox")), logs.is_standard_server(F.lit(None).cast("string")), names.unlikely_click(F.lit("Zap IV"), F.lit(3)), names.unlikely_click(F.lit("Zap"), F.lit(3))).first()
    assert tuple(row) == ("Feb 03 04:05", "Feb 03  2023", False, True, False, True, False)
    # 23:30 and 00:30 in New York are two days, in UTC one
    fights = spark.sql("SELECT 'a' AS log_id, id AS fight_id, 'Solo' AS party, CAST(t AS TIMESTAMP) AS started_on, 'Z' AS zone, m AS mob_count FROM VALUES ('x', '2024-01-02 04:30:00', 0), ('y', '2024-01-02 05:30:00', 0), ('z', '2024-01-02 04:40:00', 3) AS v(id, t, m)")
    chosen = spark.sql("SELECT 'x' AS fight_id")
    assert [sorted(r["fight_id"] for r in reports.same_session(fights, chosen, log_tz=tz).collect()) for tz in ("UTC", "America/New_York")] == [["x", "y"], ["x"]]


def test_quick_sessions_equal_windows(spark):
    rows = [("a", i, "Mob", "A", "hit", t, 1) for i, t in enumerate([0, 14, 29, 43, 58, 100])]
    df = spark.createDataFrame(rows, "log_id string, seq long, foe string, source string, kind string, t long, amount long").selectExpr("*", "timestamp_seconds(t) AS ts", "CAST(NULL AS STRING) AS party", "'Mob' AS target", "CAST(NULL AS STRING) AS name")
    quick = sorted((r["started_on"], r["damage"]) for r in live.quick_sessions(df).collect())
    exact = sorted((r["started_on"], r["hp"]) for r in fight_table(assign_fights(df)).collect())
    assert quick == exact and len(quick) == 4


def test_spread_follows_the_rows(spark):
    """Tasks that read by patterns get a number of rows, however many there are; few rows still meet all cores."""
    cores = spark.sparkContext.defaultParallelism
    assert store.spread(spark.range(0, 1000, 1, 2), 10).rdd.getNumPartitions() == 100
    assert store.spread(spark.range(0, 1000, 1, 2)).rdd.getNumPartitions() == cores
    assert store.spread(spark.range(0, 1000, 1, 200), 10).rdd.getNumPartitions() == 200
