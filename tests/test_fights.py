"""Scenarios of small event tables through entities, fights, rollups, ticks and merges."""

import random

import pytest
from pyspark.sql import functions as F

from skirmish.operators import attribution, buffs, entities, fights, loot, merge, ordered, rollups, rules, ticks
from skirmish.plans import reports

SCHEMA = "log_id string, seq long, t long, kind string, source string, target string, amount long, full_amount long, type string, spell string, mods array<string>, name string, killshot string, channel string, message string, status string, foe string, owner string, text string, class string, level int, faction string, item string, server string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


@pytest.fixture(scope="session")
def table(spark):
    def make(*rows):
        """Rows are dicts; seq counts up, t is seconds."""
        data = [tuple({"log_id": "a", "seq": i, "owner": "Me", "t": 0, **r}.get(f) for f in FIELDS) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, SCHEMA).withColumn("ts", F.timestamp_seconds(F.lit(1600000000 - 1600000000 % 60) + F.col("t"))).drop("t")

    return make


def hit(t, source="A", target="Mob", amount=10, **more):
    foe = more.pop("foe", "Mob" if "Mob" in (source, target) else None)
    return {"t": t, "kind": "hit", "type": "slash", "source": source, "target": target, "amount": amount, "foe": foe, **more}


def miss(t, source="A", target="Mob", kind="miss", **more):
    return {"t": t, "kind": "miss", "type": kind, "source": source, "target": target, "foe": "Mob", **more}


def death(t, name="Mob", killshot="A"):
    return {"t": t, "kind": "death", "name": name, "killshot": killshot, "foe": name}


def sessions(df):
    rows = fights.assign_fights(fights.with_killshots(df))
    return rows, fights.fight_table(rows)


def found(df):
    return [(r["foe"], r["start_seq"], r["end_seq"], r["status"], r["hp"], r["duration"]) for r in sessions(df)[1].orderBy("start_seq").collect()]


def test_sessions(table):
    df = table(hit(0), miss(3), death(6), hit(7), hit(21), hit(36), miss(100), hit(200, source="Mob", target="A", foe="Mob"))
    # a death closes; 15 s of idle time close; fights without damage to the foe go
    assert found(df) == [("Mob", 0, 2, "Killed", 10, 7), ("Mob", 3, 4, "Timeout", 20, 15), ("Mob", 5, 5, "Timeout", 10, 1)]


def test_a_foes_kill_keeps_its_fight_open(table):
    df = table(hit(0), death(10, "A", "Mob"), hit(20, source="B"), death(50), hit(51))
    assert found(df) == [("Mob", 0, 2, "Timeout", 20, 21), ("Mob", 4, 4, "Timeout", 10, 1)]


def test_deaths_are_attributed(table):
    df = table(hit(0), death(2, "A", "Mob"), death(3, "B", None), death(5), death(6, "C", None))
    rows, table_ = sessions(df)
    died = attribution.attribute_deaths(df.where("kind = 'death'"), rows, table_)
    assert sorted(r["died"] for r in died.collect()) == ["A", "B"]


def test_party_and_zone(table):
    df = table(
        {"kind": "raw"}, {"kind": "party", "name": "Me", "status": "RaidJoined"}, {"kind": "party", "name": "Bob", "status": "RaidLeft"}, {"kind": "party", "name": "Me", "status": "RaidLeft"},
        {"kind": "party", "name": "Me", "status": "GroupLeft"}, {"kind": "chat", "channel": "group"}, {"kind": "zone", "name": "Z"}, {"kind": "xp", "type": "RaidXP"}, {"kind": "chat", "channel": "group"},
    )
    rows = fights.with_party(fights.with_zone(df)).orderBy("seq").collect()
    assert [r["party"] for r in rows] == [None, "Raid", "Raid", "Group", "Solo", "Group", "Group", "Raid", "Raid"]
    assert [r["zone"] for r in rows] == [None] * 6 + ["Z"] * 3


def test_pending_hits(table):
    df = table(hit(0, foe=None, amount=7), hit(1, source="X", target="Y", foe=None), hit(50), hit(55))
    rows, _ = sessions(df)
    joined = fights.pending_hits(df.where("kind = 'hit'"), rows)
    assert [(r["seq"], r["foe"]) for r in joined.collect()] == [(0, "Mob")]
    fight = fights.fight_table(rows.unionByName(joined)).first()
    # it counts for the hit points, in the first tick, but the fight starts with its own first hit
    assert (fight["hp"], fight["start_seq"], fight["duration"]) == (27, 2, 6)
    late = table(hit(0, foe=None), hit(61))
    assert fights.pending_hits(late, sessions(late)[0]).count() == 0


def test_hits_without_source_and_fights_without_anyone(table):
    df = table(hit(0, source=None, foe="Mob"), hit(1), miss(40), death(41), hit(60, source="Mob", target="Mob", foe="Mob"), death(61))
    # a hit by nobody opens nothing; a fight of misses and one of a mob against itself have no participant
    assert found(df) == [("Mob", 1, 1, "Timeout", 10, 1)]


def test_raids_wait_longer_and_a_boss_ends_its_mobs(table, spark):
    raid = {"party": "Raid", "zone": "Z"}
    df = table(hit(0), hit(100), hit(101, target="Boss", foe="Boss"), death(102, "Boss"), hit(104), hit(230)).withColumns({k: F.lit(v) for k, v in raid.items()})
    assert [x[:4] for x in found(df)] == [("Mob", 0, 4, "Timeout"), ("Boss", 2, 3, "Killed"), ("Mob", 5, 5, "Timeout")]
    templates = spark.createDataFrame([("R", "Z", "Mob", False), ("R", "Z", "Boss", True)], "raid string, zone string, mob string, ends_on_death boolean")
    forced = fights.fight_table(fights.assign_fights(fights.with_killshots(merge.boss_terminators(df, templates)))).orderBy("start_seq").collect()
    assert [(r["foe"], r["start_seq"], r["end_seq"], r["status"]) for r in forced] == [("Mob", 0, 1, "Timeout"), ("Boss", 2, 3, "Killed"), ("Mob", 4, 4, "Timeout"), ("Mob", 5, 5, "Timeout")]


def test_corpses_and_wards(table):
    df = table(hit(0, "A's corpse"), hit(1, "Mob's corpse", "A", foe="Mob's corpse"), hit(2, "B's corpse", "C", foe=None), {"kind": "heal", "source": "A`s ward"})
    assert [(r["seq"], r["source"]) for r in rules.normalize_sources(rules.without_corpses(df)).orderBy("seq").collect()] == [(0, "A"), (2, "B's corpse"), (3, "A")]


def test_what_a_log_last_told_over_its_ranges(table):
    r = random.Random(2)
    rows = [r.choice([{"kind": "zone", "name": f"Z{i}"}, {"kind": "raw"}, {"kind": "raw"}, {"kind": "xp", "type": "GroupXP"}, {"kind": "chat", "channel": "raid"}, {"kind": "party", "name": "Me", "status": "GroupLeft"}]) for i in range(60)]
    df = table(*rows)
    whole, cut = ({x["seq"]: (x["zone"], x["party"]) for x in fights.with_party(fights.with_zone(df, b), b).collect()} for b in (1000, 4))
    assert whole == cut and len(whole) == 60
    zone = None
    for i, row in enumerate(rows):
        zone = row["name"] if row["kind"] == "zone" else zone
        assert whole[i][0] == zone


def test_friends_are_no_fights_and_states_are_those_at_the_end(table):
    df = table(hit(0, "A", "Pal", foe="Pal"), hit(1), {"kind": "who", "name": "Pal", "class": "RNG"}, {"kind": "who", "name": "A", "class": "WAR"}, hit(3), death(4), {"kind": "who", "name": "A", "class": "CLR"}, {"t": 9, "kind": "raw"}, hit(10, "A", "Pal", foe="Pal"))
    rows, table_ = sessions(df)
    changes = entities.resolve_foes(df)[1]
    kept = fights.without_friends(table_, changes)
    assert sorted(r["foe"] for r in kept.collect()) == ["Mob"]
    people = fights.with_finish_state(rollups.participant_rollup(fights.in_fights(rows, kept)), kept, changes)
    assert {r["name"]: r["class"] for r in people.collect()} == {"A": "WAR", "Mob": None}


def test_last_fight_is_forgotten_when_any_fight_ends(table):
    df = table(hit(0, target="Rat", foe="Rat"), hit(12), {"t": 14, "kind": "heal", "source": "A", "target": "A"}, {"t": 16, "kind": "heal", "source": "A", "target": "A"}, death(20), {"t": 21, "kind": "heal", "source": "A", "target": "A"})
    rows, table_ = sessions(df)
    last = {r["seq"]: r["last_fight"] for r in attribution.last_fight(df.where("kind = 'heal'"), rows, fights.opened_fights(rows, table_)).collect()}
    mob = table_.where("foe = 'Mob'").first()["fight_id"]
    # at 15 s the rat's fight times out
    assert last == {2: mob, 3: None, 5: None}


def test_casters_join_the_last_fight(table):
    df = table(hit(0), {"t": 1, "kind": "casting", "source": "C"}, {"t": 1, "kind": "casting", "source": "X"}, {"t": 2, "kind": "casting", "source": "Mob"}, {"t": 3, "kind": "heal", "source": "C", "target": "D", "amount": 1, "full_amount": 1})
    rows, table_ = sessions(df)
    friends = df.where("seq = 1").selectExpr("log_id", "seq", "'C' AS name")
    casts = attribution.attribute_casts(df.where("kind = 'casting'"), rows, table_, friends)
    # the foe is the fight's target, no participant
    assert {(r["member"], r["since"]) for r in casts.collect()} == {("C", 1)}
    healed = df.where("kind = 'heal'").drop("foe")
    assert attribution.attribute_heals(healed, rows, table_).count() == 0
    assert attribution.attribute_heals(healed, rows, table_, joined_by=casts).count() == 1


def test_exact_replay_that_checks_at_every_event_equals_windows(table, spark):
    r = random.Random(5)
    rows, t = [], 0
    for _ in range(300):
        t += r.choice([1, 2, 3, 5, 40, 200])
        foe = r.choice(["Mob", "Rat"])
        rows.append(r.choice([hit(t, target=foe, foe=foe), miss(t, target=foe) | {"foe": foe}, death(t, foe), death(t, "A", foe), {"t": t, "kind": "raw"}]))
    df = table(*rows)
    strict = fights.assign_fights(fights.with_killshots(df.where("kind <> 'raw'"))).where("kind in ('hit', 'miss')").select("seq", "fight_id")
    exact = fights.assign_fights_exact(df, every=0).where("role in ('hit', 'miss')").select("seq", "fight_id")
    assert sorted(map(tuple, strict.collect())) == sorted(map(tuple, exact.collect()))


def test_exact_replay_against_a_plain_one(table):
    """Checks every five seconds at most, by a loop over all events of each log."""
    r = random.Random(8)
    rows, t = [], 0
    for i in range(400):
        t += r.choice([0, 1, 2, 3, 7, 14, 16, 40, 130])
        foe = r.choice(["Mob", "Rat", "Bat"])
        more = {"log_id": "ab"[i % 2], "party": r.choice(["Raid", None, None])}
        rows.append(r.choice([hit(t, target=foe, foe=foe), miss(t, target=foe) | {"foe": foe}, death(t, foe), death(t, "A", foe), {"t": t, "kind": "raw"}]) | more)
    df = table(*rows).join(table().sparkSession.createDataFrame([(i, x["party"]) for i, x in enumerate(rows)], "seq long, party string"), "seq")
    want = set()
    for log in "ab":
        open_at, seen, last = {}, {}, None
        for i, x in enumerate(rows):
            if x["log_id"] != log:
                continue
            if last is None or x["t"] - last >= 5:
                last = x["t"]
                for foe in list(seen):
                    if seen[foe] + (120 if x["party"] else 15) <= x["t"]:
                        del seen[foe], open_at[foe]
            if x["kind"] in ("hit", "miss"):
                open_at.setdefault(x["foe"], i)
                seen[x["foe"]] = x["t"]
                want.add((i, x["foe"], open_at[x["foe"]]))
            elif x["kind"] == "death":
                who = x["name"] if x["name"] in seen else x["killshot"] if x["killshot"] in seen else None
                if who:
                    want.add((i, who, open_at[who]))
                    seen[who] = x["t"]
                if x["name"] in seen:
                    del seen[x["name"]], open_at[x["name"]]
    # whole, and in many chunks that hand open fights over
    for size in (1000, 25):
        found = fights.assign_fights_exact(df, size=size).collect()
        assert {(x["seq"], x["foe"], x["start_seq"]) for x in found} == want and len(found) == len(want)


def test_exact_replay_revives_what_no_event_checked(table):
    df = table(hit(0), {"t": 14, "kind": "raw"}, hit(17))
    assert fights.assign_fights_exact(df).select("fight_id").distinct().count() == 1
    df = table(hit(0), {"t": 15, "kind": "raw"}, hit(17))
    assert fights.assign_fights_exact(df).select("fight_id").distinct().count() == 2


def _rows(df):
    rows, table_ = sessions(df)
    return fights.in_fights(rows, table_), table_


def test_rollups(table):
    df = table(
        hit(0, amount=100, mods=["Critical"]), hit(1, amount=200, spell="Fire"), hit(2, source="B", amount=350), hit(3, source="Mob", target="A", amount=40, mods=["Strikethrough"]),
        miss(4, "Mob", "A", "dodge"), miss(5, "Mob", "A", "miss"), miss(6), death(7),
    )
    rows, table_ = _rows(df)
    people = {r["name"]: r for r in rollups.participant_rollup(rows).collect()}
    mob, a = people["Mob"], people["A"]
    assert (mob["inbound_hit_sum"], mob["inbound_hit_count"], mob["inbound_melee_sum"], mob["is_target"], mob["duration"]) == (650, 3, 450, True, 8)
    assert (a["outbound_hit_sum"], a["outbound_miss_count"], a["inbound_miss_count"], a["inbound_strike_count"], a["rank_in_fight"]) == (300, 1, 3, 1, 2)
    defense = {r["type"]: (r["count"], r["attempts"]) for r in rollups.defense_rollup(rows, rollups.participant_rollup(rows)).where("name = 'A'").collect()}
    # 1 melee + 3 misses - 1 strike, less the misses whose turn was before
    assert defense == {"miss": (1, 3), "dodge": (1, 2), "unknown": (1, 1)}
    attack = {(r["name"], r["attack"]): (r["hit_count"], r["hit_sum"], r["crit_sum"]) for r in rollups.attack_rollup(rows).collect()}
    assert attack[("A", "slash")] == (2, 300, 100)
    summary = reports.short_summary(rollups.participant_rollup(rows), table_).orderBy("rank").collect()
    assert [(r["name"], r["damage"], r["dps"], r["pct_of_top"]) for r in summary] == [("B", 350, 43, 100), ("A", 300, 37, 85)]


def test_heals(table):
    df = table(hit(0), {"t": 1, "kind": "heal", "source": "A", "target": "A", "amount": 201, "full_amount": 300}, {"t": 2, "kind": "heal", "source": "C", "target": "Mob", "amount": 5, "full_amount": 5}, {"t": 3, "kind": "heal", "source": "D", "target": "E", "amount": 5, "full_amount": 5})
    rows, table_ = sessions(df)
    mine = attribution.attribute_heals(df.where("kind = 'heal'").drop("foe"), rows, table_)
    assert [r["seq"] for r in mine.collect()] == [1]
    sums = rollups.heals_by_name(mine).first()
    assert (sums["outbound_heal_sum"], sums["inbound_heal_sum"], sums["outbound_full_heal_sum"]) == (201, 201, 300)
    friends = df.selectExpr("log_id", "'D' AS name")
    assert sorted(r["seq"] for r in attribution.attribute_heals(df.where("kind = 'heal'").drop("foe"), rows, table_, friends).collect()) == [1, 3]


def test_healed_and_healers_are_members(table):
    heal = lambda t, a, b: {"t": t, "kind": "heal", "source": a, "target": b, "amount": t, "full_amount": t}
    df = table(hit(0), heal(1, "H", "A"), heal(2, "H", "Z"), heal(3, "Z", "Q"), heal(4, "V", "W"), heal(5, "Q", "Mob"), heal(6, "Mob", "W"))
    rows, table_ = sessions(df)
    healed = attribution.attribute_heals(df.where("kind = 'heal'").drop("foe"), rows, table_)
    assert sorted(r["seq"] for r in healed.collect()) == [1, 2, 3]


class _Replay:
    """Fights as a live reader keeps them: a list of the open ones with their members, and the one last hit."""

    def __init__(self, opened, held, friends):
        self.rows = {f["fight_id"]: f for f in opened}
        self.held, self.friends = held, friends
        self.live, self.inside, self.last, self.placed, self.tiers = [], {}, None, {}, set()

    def finish(self, f):
        self.live.remove(f)
        if self.rows[f]["kept"]:
            self.last = None

    def take(self, r):
        t, seq = r["ts"].timestamp(), r["seq"]
        for f in [f for f in self.live if not self.rows[f]["killed"] and self.rows[f]["until"] <= t]:
            self.finish(f)
        for f, kind in self.held.get(seq, []):
            foe = self.rows[f]["foe"]
            if f not in self.inside:
                self.live.append(f)
                self.inside[f] = set()
            if kind in ("hit", "miss"):
                self.inside[f] |= {r["source"], r["target"]} - {foe}
                self.last = f
            elif kind == "touch":
                self.inside[f] |= {r["name"]} - {foe}
            elif kind == "death":
                self.finish(f)
        reach = self.last in self.live or (self.last is not None and self.rows[self.last]["ghost"])
        if r["kind"] == "casting" and reach and (seq, r["source"]) in self.friends:
            self.inside[self.last] |= {r["source"]} - {self.rows[self.last]["foe"]}
        if r["kind"] == "heal":
            self.heal(r, seq, reach)

    def heal(self, r, seq, reach):
        names = {r["source"], r["target"]}
        if reach and self.inside[self.last] & names:
            f, tier = self.last, 1
        else:
            named = [f for f in self.live if f != self.last and self.inside[f] & names]
            newest = self.live[-1:] if (seq, r["source"]) in self.friends else []
            f, tier = (named[0], 2) if named else (newest[0], 3) if newest else (None, 0)
        if f and r["target"] != self.rows[f]["foe"]:
            self.inside[f] |= names - {self.rows[f]["foe"]}
            if self.rows[f]["kept"]:
                self.placed[seq] = f
                self.tiers.add(tier)


@pytest.mark.parametrize("seed", [11, 12])
def test_heals_against_a_replay(table, seed):
    """All three ways, with members by heals and casts, friends as known at each row, and fights without damage."""
    r = random.Random(seed)
    rows, t = [{"kind": "who", "name": "A"}], 0
    for i in range(300):
        t += r.choice([0, 1, 1, 2, 3, 20])
        foe, who = r.choice([("Mob", "A"), ("Rat", "B"), ("Bat", "C"), ("Bat", "D")])
        healed = {"t": t, "kind": "heal", "source": r.choice(["A", "B", "C", "H", "J", "K", "L", "A`s pet"]), "target": r.choice(["A", "B", "H", "J", "L", "X", "Y", "Mob"]), "amount": 2**20 + i, "full_amount": 2**20 + i}
        told = {"t": t, "kind": "who", "name": r.choice(["H", "J"])}
        cast = {"t": t, "kind": "casting", "source": r.choice(["A", "H", "K", "Bat"])}
        missed = miss(t, who, "Ghost", foe="Ghost") if i % 3 == 0 else hit(t, who, foe, foe=foe)
        rows.append(r.choice([hit(t, who, foe, foe=foe), missed, healed, healed, healed, cast, death(t, foe), death(t, who, foe)] + ([told] if i > 100 else [])))
    df = table(*rows)
    assigned, fights_ = sessions(df)
    changes = entities.resolve_foes(df)[1]
    held = {}
    for x in assigned.collect():
        held.setdefault(x["seq"], []).append((x["fight_id"], x["kind"]))
    friends = {(x["seq"], x["name"]) for x in attribution.friends_at(df.where("kind in ('heal', 'casting')"), changes).collect()}
    replay = _Replay([f.asDict() for f in fights.opened_fights(assigned, fights_).collect()], held, friends)
    for x in df.orderBy("seq").collect():
        replay.take(x)
    got = {x["seq"]: x["fight_id"] for x in attribution.placed_heals(df, assigned, fights_, changes).collect()}
    assert got == replay.placed and replay.tiers == {1, 2, 3}


def test_cohorts_count_all_open_fights(table):
    df = table(hit(0), miss(1, "A", "Rat", foe="Rat"), hit(2, "A", "Bat", foe="Bat"), death(3, "Bat"), hit(14, "A", "Cat", foe="Cat"), {"t": 40, "kind": "raw"})
    rows, table_ = sessions(df)
    # the bat dies beside two others; the mob times out at 15 beside rat and cat, the cat alone
    assert {r["foe"]: r["cohort_count"] for r in attribution.cohorts(rows, table_).collect()} == {"Bat": 2, "Mob": 2, "Cat": 0}
    both = table(hit(0), hit(0, "A", "Rat", foe="Rat"), {"t": 40, "kind": "raw"})
    rows, table_ = sessions(both)
    assert {r["foe"]: r["cohort_count"] for r in attribution.cohorts(rows, table_).collect()} == {"Mob": 1, "Rat": 1}


def test_six_second_split(table):
    # a start at second 34 leaves two seconds of the first bucket
    rows, _ = _rows(table(hit(34, amount=100), hit(35, amount=50), hit(37, amount=21), hit(38, source="B", amount=35)))
    series = {(r["name"], r["metric"]): r["values"] for r in ticks.dense(ticks.tick_series(rows)).collect()}
    assert series[("A", "dps")] == [150, 21] and series[("B", "dps")] == [0, 35]


def test_merged_series(spark):
    def run(starts, ends, series):
        f = spark.createDataFrame([(str(i), s, e) for i, (s, e) in enumerate(zip(starts, ends, strict=True))], "fight_id string, s long, e long").select("fight_id", F.timestamp_seconds("s").alias("started_on"), F.timestamp_seconds("e").alias("updated_on"))
        members = f.select(F.lit("m").alias("merge_id"), "fight_id")
        rows = spark.createDataFrame([(str(i), "A", "dps", k, v) for i, x in enumerate(series) for k, v in enumerate(x) if v], "fight_id string, name string, metric string, tick long, value long")
        return ticks.dense(merge.merged_series(members, f, rows)).first()["values"]

    assert run([0, 75], [15, 82], [[0, 3, 0], [7, 23]]) == [0, 3, 0, 7, 23]
    assert run([0, 76], [19, 83], [[0, 3, 0, 0], [7, 23]]) == [0, 3, 0, 0, 7, 23]
    assert run([0, 2], [5, 8], [[0, 3], [7, 23]]) == [7, 26]


def test_fold_tail_and_anonymize(spark):
    people = spark.createDataFrame([("f", n, d, m, 0, n == "Mob", i, None) for i, (n, d, m) in enumerate([("A", 1000, 0), ("B", 40, 500), ("C", 30, 20), ("Mob", 0, 0)])], "fight_id string, name string, outbound_hit_sum long, inbound_melee_sum long, outbound_heal_sum long, is_target boolean, rank_in_fight int, pet_owner string")
    got = {r["name"]: (r["outbound_hit_sum"], r["inbound_melee_sum"]) for r in merge.fold_tail(people).collect()}
    assert got == {"A": (1000, 0), "B": (0, 500), "*Other": (70, 20)}
    hidden, decoder = merge.anonymize(people, F.col("rank_in_fight"))
    assert sorted(r["name"] for r in hidden.collect()) == ["Mob", "Player1", "Player2", "Player3"]
    assert {r["alias"]: r["name"] for r in decoder.collect()} == {"Player1": "A", "Player2": "B", "Player3": "C"}


def test_pets_merge(table):
    rows, _ = _rows(table(hit(0, amount=100, source="O"), hit(1, source="P1", amount=50, type="kick", mods=["Strikethrough"]), hit(2, source="P2", amount=60, type="kick")))
    owners = rows.selectExpr("log_id", "explode(array('P1', 'P2')) AS name", "'O' AS owner").distinct()
    merged = rollups.merge_pets(rows, owners)
    attack = {(r["name"], r["attack"]): (r["hit_count"], r["hit_sum"]) for r in rollups.attack_rollup(merged).collect()}
    assert attack == {("O", "slash"): (1, 100), ("O", "pet:kick"): (2, 110)}
    assert {r["name"]: r["outbound_hit_sum"] for r in rollups.participant_rollup(merged).collect()}["O"] == 210


def test_raids(spark):
    rows = [("f1", "a", "Add", "Z", "Raid", "Killed", 0, 100, 10), ("f2", "a", "Boss", "Z", "Raid", "Killed", 50, 200, 110), ("f3", "a", "Add", "Z", "Raid", "Killed", 300, 400, 10), ("f4", "a", "Other", "Z", "Raid", "Killed", 0, 10, 5), ("f5", "a", "Add", "Z", "Group", "Killed", 0, 10, 5)]
    table_ = spark.createDataFrame(rows, "fight_id string, log_id string, foe string, zone string, party string, status string, s long, e long, hp long").selectExpr("*", "timestamp_seconds(s) AS started_on", "timestamp_seconds(e) AS updated_on", "e AS end_seq")
    templates = spark.createDataFrame([("R", "Z", "Add", False), ("R", "Z", "Boss", True)], "raid string, zone string, mob string, ends_on_death boolean")
    members, raids = merge.raid_membership(table_, templates)
    groups = {}
    for r in members.collect():
        groups.setdefault(r["merge_id"], set()).add(r["fight_id"])
    assert sorted(map(sorted, groups.values())) == [["f1", "f2"], ["f3"]]
    assert sorted((r["cohort_count"], r["finished"]) for r in raids.collect()) == [(1, False), (2, True)]


def test_a_raid_takes_no_fight_over_an_hour_after_it_began(spark):
    # at 0:00, 1:01:00 and 2:00:30: the third is within an hour of the second
    rows = [(f"f{i}", "a", "Add", "Z", "Raid", "Killed", s, s + 10, 10) for i, s in enumerate([0, 3660, 7230])]
    table_ = spark.createDataFrame(rows, "fight_id string, log_id string, foe string, zone string, party string, status string, s long, e long, hp long").selectExpr("*", "timestamp_seconds(s) AS started_on", "timestamp_seconds(e) AS updated_on", "e AS end_seq")
    templates = spark.createDataFrame([("R", "Z", "Add", False)], "raid string, zone string, mob string, ends_on_death boolean")
    assert sorted(r["cohort_count"] for r in merge.raid_membership(table_, templates)[1].collect()) == [1, 2]


def test_very_long_merges_have_no_series(spark):
    header = spark.createDataFrame([("a", 3001), ("b", 601), ("c", 600)], "fight_id string, duration long")
    series = spark.createDataFrame([(f, "A", "dps", t, 1) for f in "abc" for t in (0, 4, 5)], "fight_id string, name string, metric string, tick long, value long")
    assert sorted((r["fight_id"], r["tick"], r["value"]) for r in merge.fit_series(header, series).collect()) == [("b", 0, 2), ("b", 1, 1), ("c", 0, 1), ("c", 4, 1), ("c", 5, 1)]


@pytest.mark.parametrize(("said", "told"), [("Attacking a moss golem Master.", True), ("Sorry, Master... calming down.", True), ("By your command, master.", True), ("I live again...", True), ("I met the Master", False), ("Following you, Master", False)])
def test_pets_tell_their_master(table, said, told):
    changes = entities.resolve_foes(table({"kind": "chat", "source": "Kebn", "channel": "tell", "message": said}))[1].where("name = 'Kebn'").collect()
    assert bool(changes and changes[-1]["owner"] == "Me") == told


def test_class_from_most_casts(table, spark):
    dim = spark.createDataFrame([("Zap", 1, "WIZ"), ("Mend", 1, "CLR"), ("Both", 2, "CLR,WIZ")], "name string, class_count int, classes string").selectExpr("*", "0 AS duration_ticks", "5 AS target", "CAST(NULL AS STRING) AS land_pet")
    cast = [{"kind": "casting", "source": "W", "type": "Spell", "spell": x} for x in ("Mend", "Zap", "Zap", "Both", "Mend")]
    changes = entities.resolve_foes(table(*cast), dim)[1].where("name = 'W'").orderBy("seq").collect()
    # of those that tie, the first
    assert [r["class"] for r in changes] == ["CLR", "CLR", "WIZ", "CLR"]


def known(changes, name):
    return {r["name"]: r for r in entities.current_entities(changes).collect()}[name]


@pytest.mark.parametrize(("rows", "name", "kind"), [
    ([{"kind": "who", "name": "F", "class": "RNG", "level": 60}, hit(1, "F", "X", foe=None)], "X", "Foe"),
    ([{"kind": "who", "name": "F"}, hit(1, "X", "F", foe=None)], "X", "Foe"),
    ([{"kind": "consider", "name": "E", "faction": "scowls at you"}, hit(1, "E", "X", foe=None)], "X", "Friend"),
    ([{"kind": "consider", "name": "E", "faction": "scowls at you"}, hit(1, "X", "E", foe=None)], "X", "Friend"),
    ([{"kind": "consider", "name": "E", "faction": "scowls at you"}, death(1, "E")], "E", "Unknown"),
    ([{"kind": "consider", "name": "E", "faction": "regards you indifferently", "level": 9}], "E", "Unknown"),
])
def test_friend_and_foe(table, rows, name, kind):
    assert known(entities.resolve_foes(table(*rows))[1], name)["type"] == kind


def test_players_pets_and_classes(table, spark):
    spell_rows = [("Claw Rk. II", 1, 2048, "WIZ", 10, None, None, None, None, 5), ("Pet Heal", 2, 2, "CLR", 10, None, None, None, " glows.", 14)]
    dim = spark.createDataFrame(spell_rows, "name string, class_count int, class_mask int, classes string, duration_ticks int, land_self string, land_others string, wears_off string, land_pet string, target int")
    df = table(
        {"kind": "casting", "source": "W", "spell": "Claw Rk. II", "type": "Spell"}, {"kind": "chat", "source": "Jabober", "channel": "say", "message": "My leader is W."}, hit(1, "Me", "Rat", foe=None),
        {"kind": "casting", "source": "Me", "spell": "Pet Heal", "type": "Spell", "t": 2}, {"kind": "raw", "text": "Kebartik glows.", "t": 3}, {"kind": "loot", "name": "L", "item": "x", "source": "y"}, hit(4, "Gob", "Kebartik", foe=None), hit(5, "St", "Rat", foe=None, type="backstab"),
    )
    foes, changes = entities.resolve_foes(df, dim)
    assert known(changes, "W")["class"] == "WIZ" and known(changes, "Jabober")["owner"] == "W" and known(changes, "St")["class"] == "ROG"
    assert known(changes, "L")["is_player"] and known(changes, "Kebartik")["owner"] == "Me"
    assert {r["seq"]: r["foe"] for r in foes.collect()}[2] == "Rat"
    as_of = entities.entities_as_of(df.where("kind = 'hit'"), changes, "source", "seq").where("seq = 7").first()
    assert as_of["class_of"] == "ROG" and as_of["type_of"] == "Friend"


def test_buffs(table, spark):
    spells = spark.createDataFrame([("Shield of Light", 6, 10, "You glow.", " glows."), ("Aura I", 41, 20, "You shine.", " shines.")], "name string, target int, duration_ticks int, land_self string, land_others string")
    tracked = buffs.tracked_spells(spells, spark.createDataFrame([("Shield of Light", 0), ("Aura I", 1)], "spell string, place int"))
    df = table(
        {"kind": "casting", "source": "A", "spell": "Shield of Light Rk. II"}, {"kind": "raw", "text": "You shine."}, {"kind": "raw", "text": "Bob shines."}, {"kind": "raw", "text": "Bob glows."}, death(9, "Bob"),
        {"kind": "shield", "source": "T", "target": "U"}, {"kind": "rescued", "target": "V"},
    )
    got = {(r["target"], r["spell"]) for r in buffs.buff_events(df, tracked).collect()}
    assert got == {("A", "Shield of Light Rk. II"), ("Me", "Aura"), ("Bob", "Aura"), ("Bob", "*Died"), ("U", "*Shielded by T"), ("V", "*Rescued by DI")}


def test_drops(table, spark):
    df = table({"kind": "loot", "item": "Gem", "source": "Rat"}, {"kind": "zone", "name": "Z"}, {"kind": "loot", "item": "Gem", "source": "Rat"}, {"kind": "rot", "item": "Gem", "source": "Rat"}, {"kind": "loot", "item": "Junk", "source": "Rat"}, {"kind": "loot", "item": "Gem"})
    got = loot.drop_counts(loot.drops(df, spark.sql("SELECT 'Junk' AS item"))).collect()
    assert [(r["zone"], r["mob"], r["item"], r["n"]) for r in got] == [("Z", "Rat", "Gem", 2)]


def _chain():
    """Each of twelve heals makes the healer of the next a member."""
    return [{"t": 1 + k, "kind": "heal", "source": f"P{k}" if k else "A", "target": f"P{k + 1}", "amount": 1, "full_amount": 1} for k in range(12)]


def test_a_chain_of_heals_is_no_chain_of_passes(table, monkeypatch):
    df = table(hit(0), *_chain())
    rows, table_ = sessions(df)
    written = []
    for module in (m for m in (attribution, ordered) if hasattr(m, "stored")):
        monkeypatch.setattr(module, "stored", lambda df, label, f=module.stored: written.append(label) or f(df, label))
    healed = attribution.attribute_heals(df.where("kind = 'heal'").drop("foe"), rows, table_)
    assert healed.count() == 12 and len(written) < 12


def test_heals_in_chunks(table):
    """Members are handed over to the chunks after; a fight that ended takes none along."""
    df = table(hit(0), *_chain(), death(14), hit(40), *[{**h, "t": h["t"] + 40} for h in _chain()[3:]], {"t": 54, "kind": "heal", "source": "A", "target": "P4", "amount": 1, "full_amount": 1})
    rows, table_ = sessions(df)
    healed = df.where("kind = 'heal'").drop("foe")
    whole = sorted(map(str, attribution.attribute_heals(healed, rows, table_).collect()))
    assert len(whole) == 13
    assert sorted(map(str, attribution.attribute_heals(healed, rows, table_, size=4).collect())) == whole
