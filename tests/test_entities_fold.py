"""The fold over who is what: chunks of a log folded apart give what one fold from the start gives."""

import random

import pytest
from pyspark.sql import functions as F

from skirmish.operators import entities, ordered

EVENTS = "log_id string, seq long, ts timestamp, owner string, kind string, source string, target string, name string, killshot string, type string, spell string, mods array<string>, channel string, message string, faction string, class string, level int, text string"


def _log(spark, log_id, seed, n):
    r = random.Random(seed)
    people, foes = [f"P{i}" for i in range(6)], [f"M{i}" for i in range(6)] + ["P1`s pet", "Gobaner"]
    rows, t = [], 1_700_000_000
    for i in range(n):
        t += r.choice([0, 1, 3])
        a, b = r.choice(people + foes), r.choice(people + foes)
        row = r.choice([
            {"kind": "hit", "source": a, "target": b, "type": r.choice(["slash", "backstab"])}, {"kind": "hit", "source": a, "target": b, "type": "slash"}, {"kind": "miss", "source": a, "target": b},
            {"kind": "hit", "source": b, "target": a, "type": "slash"}, {"kind": "heal", "source": a, "target": b}, {"kind": "death", "name": r.choice(foes + people), "killshot": a},
            {"kind": "casting", "source": a, "type": "Spell", "spell": r.choice(["Fire", "Frost", "Dew"])},
        ])
        if r.random() < 0.03:
            row = r.choice([{"kind": "who", "name": r.choice(people), "class": r.choice(["WAR", None]), "level": 60}, {"kind": "consider", "name": r.choice(foes), "faction": "scowls", "level": 40}, {"kind": "chat", "source": "Gobaner", "channel": "tell", "message": "My leader is P2."}, {"kind": "taunt", "source": a, "target": b}])
        rows.append({"log_id": log_id, "seq": i, "ts": t, "owner": "P0", **row})
    return rows


@pytest.fixture(scope="module")
def events(spark):
    rows = _log(spark, "long", 1, 900) + _log(spark, "short", 2, 60)
    names = [c.split()[0] for c in EVENTS.split(", ")]
    df = spark.createDataFrame([tuple(x.get(c) for c in names) for x in rows], EVENTS.replace("ts timestamp", "ts long"))
    return df.withColumn("ts", F.timestamp_seconds("ts"))


@pytest.fixture(scope="module")
def spells(spark):
    rows = [("Fire", "WIZ", 1, 0, None, None), ("Frost", "DRU", 1, 0, None, None), ("Dew", "DRU,SHM", 2, 0, None, None)]
    return spark.createDataFrame(rows, "name string, classes string, class_count int, duration_ticks int, target int, land_pet string")


@pytest.mark.parametrize("with_spells", [False, True])
def test_chunks_equal_one_fold(events, spells, with_spells):
    dim = spells if with_spells else None
    whole = entities.fold_entities(events, dim).collect()
    chunked = ordered.in_chunks(entities._rows(events, dim), 40)
    assert chunked.select("chunk").distinct().count() > 12
    parts = entities.fold_entities(events, dim, 40).collect()
    assert sorted(map(str, parts)) == sorted(map(str, whole))
    assert {r["type"] for r in parts} == {"Friend", "Foe", "Unknown"}
    if with_spells:
        assert {"WIZ", "DRU"} <= {r["class"] for r in parts}


def test_conflicts_pets_and_leaders(events):
    """What a single fold decides, row by row, from a plain replay of the same rules."""
    foes, changes = entities.resolve_foes(events)
    known, owner, player, aggro, want = {}, {}, set(), {}, {}
    logs = {r["log_id"] for r in events.select("log_id").distinct().collect()}
    for log in logs:
        known.clear(), owner.clear(), player.clear(), aggro.clear()
        known["P0"] = "Friend"
        player.add("P0")
        owner["P1`s pet"] = "P1"
        for r in events.where(F.col("log_id") == log).orderBy("seq").collect():
            a, b, k = r["source"], r["target"], r["kind"]
            if k == "who":
                known[r["name"]] = "Friend"
                player.add(r["name"])
                owner.pop(r["name"], None)
            elif k == "consider":
                known[r["name"]] = "Foe"
            elif k == "taunt":
                known[a] = "Friend"
                known[b] = "Foe"
            elif k == "chat":
                if a not in player:
                    known[a], owner[a] = "Friend", "P2"
            elif k == "heal":
                if b in player:
                    known[a] = "Friend"
            elif k == "death":
                aggro.pop(r["name"], None)
                if r["name"] not in player:
                    known[r["name"]] = "Unknown"
            elif k in ("hit", "miss"):
                if b in player:
                    aggro[a] = r["ts"].timestamp()
                if a == b or owner.get(a) == b or owner.get(b) == a or {a, b} <= player:
                    continue
                x, y = known.get(a, "Unknown"), known.get(b, "Unknown")
                pets = [n == "Gobaner" for n in (a, b)]
                foe = None
                if x == y != "Unknown":
                    late = aggro.get(a, 0) - aggro.get(b, 0)
                    foe = a if (b in player and a not in player) or late > 0 else b if (a in player and b not in player) or late < 0 else None
                elif x == "Friend" or y == "Foe":
                    foe = b
                elif x == "Foe" or y == "Friend":
                    foe = a
                elif pets[0] != pets[1]:
                    foe = b if pets[0] else a
                if foe:
                    known[foe], known[a if foe == b else b] = "Foe", "Friend"
                    want[(log, r["seq"])] = foe
    assert {(r["log_id"], r["seq"]): r["foe"] for r in foes.collect()} == want


def test_order_of_what_one_line_tells(spark):
    """A log's first line tells of its owner, too: rows may arrive in any order, that the owner is a player comes first."""
    names = [c.split()[0] for c in EVENTS.split(", ")]
    rows = [{"log_id": "taunted", "kind": "taunt", "source": "M1", "target": "P0"}, {"log_id": "bound", "kind": "heal", "source": "M1", "target": "P0", "spell": "Bond"}]
    df = spark.createDataFrame([tuple({"seq": 1, "ts": 1_700_000_000, "owner": "P0", **x}.get(c) for c in names) for x in rows], EVENTS.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    spells = spark.createDataFrame([("Bond", "MAG", 1, 0, 14, None)], "name string, classes string, class_count int, duration_ticks int, target int, land_pet string")
    told = entities._rows(df, spells).withColumn("chunk", F.lit(0)).coalesce(1)
    for arrived in (F.col("is_player").desc_nulls_last(), F.col("is_player").asc_nulls_first()):
        found = entities._fold(told.sortWithinPartitions(arrived), None).where("left is null AND name = 'P0'").collect()
        assert {(r["log_id"], r["type"], r["is_player"], r["owner"]) for r in found} == {("taunted", "Foe", True, None), ("bound", "Friend", True, None)}
