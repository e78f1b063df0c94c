"""The queries of the engine over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skirmish.functions import text as names
from skirmish.operators import attribution, buffs, entities, fights, loot, merge, rollups, rules, ticks
from skirmish.operators.lines import rejected_lines, split_lines
from skirmish.plans import duel, expected, rendered, reports
from skirmish.plans.rendered import Tables, table
from skirmish.sources import logs, rosters, sinks, spells, store
from skirmish.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_COMBAT, _FIGHTS = expected.COMBAT, expected.FIGHTS
_SHORT = """
SELECT fight_id, foe, hp, rank, name, damage, CAST(damage // fd AS BIGINT) AS dps, CAST(damage * 100 // top AS BIGINT) AS pct_of_top FROM (
  SELECT p.fight_id, f.foe, f.hp, p.name, p.outbound_hit_sum AS damage, f.duration AS fd, max(p.outbound_hit_sum) OVER (PARTITION BY p.fight_id) AS top,
    CAST(row_number() OVER (PARTITION BY p.fight_id ORDER BY p.outbound_hit_sum DESC, p.name) AS INTEGER) AS rank
  FROM people p JOIN fights f USING (fight_id) WHERE NOT p.is_target) WHERE rank <= 10 AND damage > 0"""


@query(_FIGHTS + _SHORT)
def top_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top damage dealers of every fight with damage per second and share of the top."""
    t = Tables(spark, sf_dir)
    return reports.short_summary(rollups.participant_rollup(t.rows), t.fights)


_KINDS = "['chat', 'consider', 'rot', 'craft', 'xp', 'aaxp', 'aa_purchase', 'skill', 'shield', 'rescued', 'taunt', 'dice', 'coin', 'output_file', 'cast_fail', 'cure', 'raw']"


@query(_COMBAT + f" SELECT kind, count(*) AS n FROM (SELECT kind FROM combat UNION ALL SELECT CASE kind WHEN 'pdeath' THEN 'death' ELSE kind END FROM extra UNION ALL SELECT {_KINDS}[k + 1] FROM aside) GROUP BY kind")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of every rule; the log has messages of all 25 kinds."""
    return rules.rule_counts(rendered.events(spark, sf_dir))


_ASIDE = f""" SELECT seq, {_KINDS}[k + 1] AS kind, CASE WHEN k IN (0, 10, 11, 14) THEN actor WHEN k = 2 THEN foe WHEN k = 8 THEN 'Bulwark' WHEN k = 15 THEN actor END AS source,
  CASE WHEN k IN (8, 9) THEN actor WHEN k = 10 THEN foe WHEN k = 15 THEN other END AS target, CASE k WHEN 1 THEN foe WHEN 3 THEN 'Larry' WHEN 6 THEN 'Tear' WHEN 7 THEN 'Swimming' END AS name,
  CASE k WHEN 4 THEN 'SoloXP' WHEN 14 THEN 'fizzle' END AS type, CASE WHEN k IN (14, 15) THEN 'Plague Bolt' END AS spell, CASE k WHEN 2 THEN gem WHEN 3 THEN gem || ' Ring' WHEN 11 THEN gem END AS item,
  CASE k WHEN 0 THEN 'group' END AS channel, CASE k WHEN 0 THEN 'pull now' END AS message, CASE k WHEN 1 THEN 44 WHEN 7 THEN i % 200 END AS level, CASE k WHEN 1 THEN true END AS rare, CASE k WHEN 1 THEN 'it appears quite formidable.' END AS strength,
  CASE k WHEN 4 THEN '1.500000' END AS xp, CASE k WHEN 5 THEN 1 END AS amount, CASE k WHEN 5 THEN i % 50 END AS total, CASE k WHEN 6 THEN i % 7 END AS cost, CASE k WHEN 11 THEN 1 END AS min, CASE k WHEN 11 THEN 1000 END AS max, CASE k WHEN 11 THEN i % 1000 + 1 END AS roll,
  CASE k WHEN 12 THEN i % 9 + 1 END AS gold, CASE k WHEN 12 THEN i % 10 END AS copper, CASE k WHEN 13 THEN 'list' || i || '.txt' END AS file_name FROM aside WHERE k < 16"""
_INTS = ("level", "total", "cost", "min", "max", "roll", "gold", "copper")


@query(_COMBAT + f", told AS ({_ASIDE.replace(chr(39) + 'Tear' + chr(39), chr(39) + 'Tin Ear ' + chr(39) + ' || (i % 5)')} UNION ALL BY NAME SELECT seq, 'consider' AS kind, name, 44 AS level, false AS rare, 'it appears quite formidable.' AS strength FROM extra WHERE kind = 'consider') SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('amount', *_INTS))}) FROM told")
def side_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat, considering, trade, progress, dice, coins, cures and the like, with their columns."""
    kinds = ("chat", "consider", "rot", "craft", "xp", "aaxp", "aa_purchase", "skill", "shield", "rescued", "taunt", "dice", "coin", "output_file", "cast_fail", "cure")
    e = rendered.events(spark, sf_dir).where(F.col("kind").isin(*kinds))
    return e.select("seq", "kind", "source", "target", "name", "type", "spell", "item", "channel", "message", "rare", "strength", F.col("xp").cast("string").alias("xp"), "amount", *[F.col(c).cast("long").alias(c) for c in _INTS], "file_name")


@query(_COMBAT + " SELECT log_id, seq, 'The crowd counts ' || i || ' coins.' AS text FROM aside WHERE k = 16 UNION ALL SELECT log_id, seq, name || ' glistens.' FROM extra WHERE kind = 'raw' AND name <> 'Larry'")
def unmatched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a number that no rule knows."""
    return rules.unmatched(rendered.events(spark, sf_dir)).select("log_id", "seq", "text")


@query(_COMBAT + " SELECT seq, log_id, ts, kind, source, target, amount, full_amount, type, spell, CASE WHEN riposte THEN 'Riposte,Strikethrough' WHEN strike THEN 'Strikethrough' WHEN crit THEN 'Critical' ELSE '' END AS mods FROM combat WHERE kind <> 'death'")
def combat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses and heals as text, read back to columns; a ward's heals are its owner's."""
    e = rules.normalize_sources(rendered.events(spark, sf_dir).where(F.col("kind").isin("hit", "miss", "heal")))
    return e.select("seq", "log_id", "ts", "kind", "source", "target", "amount", "full_amount", "type", "spell", F.array_join(F.coalesce("mods", F.array().cast("array<string>")), ",").alias("mods"))


@query("SELECT 'eqlog_Larry_' || CAST(event_id // 2000 AS VARCHAR) AS log_id, count(*) AS n FROM events WHERE event_id % 101 = 0 GROUP BY 1")
def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_lines(rendered.lines(spark, sf_dir)).groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))


@query(_COMBAT + " SELECT seq, CASE WHEN riposte THEN 48 WHEN strike THEN 32 WHEN crit THEN 1 ELSE 0 END AS mod_bits FROM combat WHERE kind = 'hit'")
def mod_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rendered.events(spark, sf_dir).where(F.col("kind") == "hit")
    return e.select("seq", names.mod_bits(F.coalesce("mods", F.array().cast("array<string>"))).alias("mod_bits"))


@query(expected.SESSIONS + " SELECT fight_id, log_id, foe, start_seq, started_on, updated_on, end_seq, status, hp, zone, party, duration FROM fights")
def fight_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fights around inferred foes, with pending hits, raid gaps, zone and party."""
    return Tables(spark, sf_dir).fights


@query(_FIGHTS + " SELECT * REPLACE (CAST(rank_in_fight AS INTEGER) AS rank_in_fight) FROM ranked")
def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.participant_rollup(Tables(spark, sf_dir).rows)


@query(_FIGHTS + " SELECT * FROM attacks")
def attack_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.attack_rollup(Tables(spark, sf_dir).rows)


@query(_FIGHTS + " SELECT fight_id, source AS name, kind AS type, spell, count(*) AS hit_count, CAST(sum(amount) AS BIGINT) AS hit_sum, max(amount) AS hit_max, CAST(0 AS BIGINT) AS full_sum, count(*) FILTER (crit) AS crit_count, CAST(coalesce(sum(amount) FILTER (crit), 0) AS BIGINT) AS crit_sum, CAST(0 AS BIGINT) AS twin_count FROM frows WHERE kind = 'hit' AND spell IS NOT NULL GROUP BY 1, 2, 3, 4")
def spell_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).rows
    return rollups.spell_rollup(rows.drop("full_amount"))


@query(_FIGHTS + " SELECT * FROM waterfall")
def defense_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rollups.defense_rollup(t.rows, rollups.participant_rollup(t.rows))


@query(_FIGHTS + " SELECT p.fight_id, p.name, CAST(p.inbound_miss_count - coalesce(d.n, 0) AS BIGINT) AS strike_prone_count FROM people p LEFT JOIN (SELECT fight_id, target AS name, count(*) AS n FROM frows WHERE kind = 'miss' AND type IN ('miss', 'invul', 'rune') GROUP BY 1, 2) d USING (fight_id, name)")
def strike_prone(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rollups.strike_prone(t.rows, rollups.participant_rollup(t.rows))


@query(_FIGHTS + " SELECT * FROM series")
def tick_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.tick_series(Tables(spark, sf_dir).rows)


@query(_FIGHTS + " SELECT fight_id, name, metric, tick // 5 AS tick, CAST(sum(value) AS BIGINT) AS value FROM series GROUP BY 1, 2, 3, 4")
def wide_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.widen(ticks.tick_series(Tables(spark, sf_dir).rows), 5)


@query(_FIGHTS + ", lasts AS (SELECT fight_id, name, metric, max(tick) AS last FROM series GROUP BY 1, 2, 3), grid AS (SELECT fight_id, name, metric, unnest(range(0, last + 1)) AS tick FROM lasts) SELECT fight_id, name, metric, string_agg(CAST(coalesce(s.value, 0) AS VARCHAR), ',' ORDER BY g.tick) AS values FROM grid g LEFT JOIN series s USING (fight_id, name, metric, tick) GROUP BY 1, 2, 3")
def dense_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ticks.dense(ticks.tick_series(Tables(spark, sf_dir).rows))
    return found.withColumn("values", F.array_join(F.col("values").cast("array<string>"), ","))


@query(_COMBAT + ", hits AS (SELECT log_id, seq FROM combat WHERE kind = 'hit')" + expected.placed("found", "hits") + " SELECT seq, zone, party FROM found")
def zone_and_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone and party that held at every hit."""
    e = fights.with_party(fights.with_zone(rendered.events(spark, sf_dir).select(*rendered.COMBAT)))
    return e.where(F.col("kind") == "hit").select("seq", "zone", "party")


@query(_FIGHTS + expected.COHORTS)
def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other fights that were open when one ended."""
    t = Tables(spark, sf_dir)
    return attribution.cohorts(t.assigned, t.fights).select("fight_id", "cohort_count")


@query(_FIGHTS + " SELECT a.fight_id, a.died AS name, count(*) AS death_count FROM assigned a JOIN fights USING (fight_id) WHERE kind = 'touch' GROUP BY 1, 2")
def deaths_in_fights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    died = attribution.attribute_deaths(t.events.where(F.col("kind") == "death"), t.assigned, t.fights)
    return rollups.death_rollup(died)


def _heals(t: Tables) -> DataFrame:
    """Heals in their fights, stored once a session: several queries sum them up."""
    return store.stored_once(t.source, "heals", lambda: attribution.placed_heals(t.events, t.assigned, t.fights, t.changes))


@query(_FIGHTS + expected.HEALS + " SELECT fight_id, source AS name, target, count(*) AS hit_count, CAST(sum(amount) AS BIGINT) AS hit_sum, CAST(sum(full_amount) AS BIGINT) AS full_sum, CAST(sum(full_amount) - sum(amount) AS BIGINT) AS overheal FROM healed GROUP BY 1, 2, 3 HAVING sum(amount) > 0")
def heals_in_fights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heals with the fight they count for, summed by healer and target."""
    return rollups.heal_rollup(_heals(Tables(spark, sf_dir)))


@query(_FIGHTS + expected.HEALS + """, both_ways AS (SELECT fight_id, ts, source AS name, 'out' AS side, amount, full_amount FROM healed UNION ALL SELECT fight_id, ts, target, 'in', amount, full_amount FROM healed
), sums AS (SELECT fight_id, name, CAST(coalesce(sum(amount) FILTER (side = 'out'), 0) AS BIGINT) AS outbound_heal_sum, CAST(coalesce(sum(full_amount) FILTER (side = 'out'), 0) AS BIGINT) AS outbound_full_heal_sum,
  CAST(coalesce(sum(amount) FILTER (side = 'in'), 0) AS BIGINT) AS inbound_heal_sum, CAST(coalesce(sum(full_amount) FILTER (side = 'in'), 0) AS BIGINT) AS inbound_full_heal_sum, min(ts) FILTER (side = 'out') AS a, max(ts) FILTER (side = 'out') AS b FROM both_ways GROUP BY 1, 2
), joined AS (SELECT fight_id, name, coalesce(outbound_hit_sum, 0) AS outbound_hit_sum, coalesce(inbound_hit_sum, 0) AS inbound_hit_sum, coalesce(outbound_heal_sum, 0) AS outbound_heal_sum, coalesce(outbound_full_heal_sum, 0) AS outbound_full_heal_sum,
  coalesce(inbound_heal_sum, 0) AS inbound_heal_sum, coalesce(inbound_full_heal_sum, 0) AS inbound_full_heal_sum, f.duration AS whole, name = f.foe AS is_target, epoch(greatest(last_action, b)) - epoch(least(first_action, a)) + 1 AS own
  FROM everyone FULL JOIN sums USING (fight_id, name) JOIN fights f USING (fight_id))
SELECT fight_id, name, outbound_hit_sum, inbound_hit_sum, outbound_heal_sum, outbound_full_heal_sum, inbound_heal_sum, inbound_full_heal_sum, is_target, CAST(CASE WHEN is_target THEN whole ELSE coalesce(own, 0) END AS BIGINT) AS duration,
  CASE WHEN name LIKE 'Player%' THEN 'RNG' END AS class, CAST(NULL AS VARCHAR) AS pet_owner FROM joined WHERE is_target OR outbound_hit_sum > 0 OR inbound_hit_sum > 0 OR outbound_heal_sum > 0""")  # fmt: skip
def healers_and_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with their healing, and class and owner as known when the fight ended; who was idle is left out."""
    t = Tables(spark, sf_dir)
    people = fights.with_finish_state(rollups.participant_rollup(t.rows, _heals(t)), t.fights, t.changes)
    return people.select("fight_id", "name", "outbound_hit_sum", "inbound_hit_sum", "outbound_heal_sum", "outbound_full_heal_sum", "inbound_heal_sum", "inbound_full_heal_sum", "is_target", "duration", "class", "pet_owner")


@query(_FIGHTS + expected.HEALS + """, beats AS (SELECT fight_id, foe, source, target, amount, CAST(greatest(0, CAST(epoch(ts) AS BIGINT) // 6 - CAST(epoch(started_on) AS BIGINT) // 6) AS BIGINT) AS tick FROM (SELECT fight_id, fight_foe AS foe, source, target, amount, ts, started_on FROM healed))
SELECT fight_id, name, metric, tick, CAST(sum(amount) AS BIGINT) AS value FROM (SELECT fight_id, source AS name, 'hps' AS metric, tick, amount FROM beats UNION ALL SELECT fight_id, target, 'inbound_hps', tick, amount FROM beats) GROUP BY 1, 2, 3, 4 HAVING sum(amount) <> 0""")  # fmt: skip
def heal_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Healing done and received in six-second ticks."""
    return ticks.tick_series(_heals(Tables(spark, sf_dir)))


@query(_FIGHTS + expected.HEALS + " SELECT fight_id, source AS name, 'heal' AS type, spell, count(*) AS hit_count, CAST(sum(amount) AS BIGINT) AS hit_sum, max(amount) AS hit_max, CAST(sum(full_amount) AS BIGINT) AS full_sum, CAST(row_number() OVER (PARTITION BY fight_id, source ORDER BY sum(amount) DESC, spell) AS INTEGER) AS place FROM healed GROUP BY 1, 2, 3, 4")
def heal_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heals by caster and spell, in their order."""
    found = rollups.ordered_children(rollups.spell_rollup(_heals(Tables(spark, sf_dir))), "hit_sum", "spell", ("fight_id", "name", "type"))
    return found.drop("crit_count", "crit_sum", "twin_count")


@query()
def exact_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fights with timeouts checked as a live reader does; tested against a replay."""
    found = fights.assign_fights_exact(rendered.combat(spark, sf_dir))
    return found.groupBy("log_id", "foe", "start_seq").agg(F.max("seq").alias("end_seq"), F.count(F.lit(1)).alias("n"))


@query(_COMBAT + " SELECT log_id, CASE WHEN source = foe || '''s corpse' THEN source ELSE foe END AS foe, count(*) AS n FROM combat WHERE kind IN ('hit', 'miss') AND j >= 3 AND source IS NOT NULL GROUP BY 1, 2")
def resolved_foes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foe of each hit and miss, inferred from who lists, parties, loot and earlier fights."""
    found, _ = entities.foes_and_changes(rendered.entity_states(spark, sf_dir))
    return found.groupBy("log_id", "foe").agg(F.count(F.lit(1)).alias("n"))


@query(_COMBAT + """, told AS (SELECT log_id, name, true AS player, true AS who, false AS seen FROM extra WHERE kind = 'who'
  UNION ALL SELECT log_id, actor, true, false, false FROM raw WHERE j >= 3 AND i % 97 <> 0 AND i % 41 = 0 UNION ALL SELECT log_id, name, false, false, true FROM extra WHERE kind = 'consider' UNION ALL SELECT log_id, name, false, false, false FROM extra WHERE kind = 'pdeath'
  UNION ALL SELECT log_id, 'Larry', true, false, false FROM raw UNION ALL SELECT log_id, actor, true, false, false FROM aside WHERE k = 0 UNION ALL SELECT log_id, foe, false, false, k = 1 FROM aside WHERE k IN (1, 10)
  UNION ALL SELECT log_id, 'Bulwark', false, false, false FROM aside WHERE k = 8 UNION ALL SELECT log_id, source, false, false, false FROM combat WHERE kind IN ('hit', 'miss') AND source IS NOT NULL
  UNION ALL SELECT log_id, target, false, false, false FROM combat WHERE kind IN ('hit', 'miss') AND source IS NOT NULL AND j >= 3 UNION ALL SELECT log_id, foe, false, false, false FROM combat WHERE kind = 'death'
  UNION ALL SELECT log_id, actor || '`s ward', false, false, false FROM base WHERE kind = 'heal' AND i % 19 = 0 AND j >= 3
  UNION ALL SELECT log_id, source, false, false, false FROM combat WHERE kind = 'heal' AND source LIKE 'Medic%' AND target LIKE 'Player%')
SELECT log_id, name, bool_or(player) AS is_player, CASE WHEN bool_or(who) THEN 'RNG' WHEN name = 'Bulwark' THEN 'WAR' END AS class, CAST(CASE WHEN bool_or(who) THEN 65 WHEN bool_or(seen) THEN 44 END AS INTEGER) AS level FROM told GROUP BY 1, 2""")
def known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, changes = entities.foes_and_changes(rendered.entity_states(spark, sf_dir))
    return entities.current_entities(changes).select("log_id", "name", "is_player", "class", "level")


@query(_COMBAT + " SELECT l.zone, l.mob, l.item, count(*) AS n FROM (SELECT last_value(CASE WHEN kind = 'zone' THEN name END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS zone, kind, other AS mob, name AS item FROM (SELECT log_id, seq, kind, name, other FROM extra WHERE kind IN ('zone', 'loot') UNION ALL SELECT log_id, seq, 'rot', gem, foe FROM aside WHERE k = 2)) l WHERE l.kind <> 'zone' AND l.zone IS NOT NULL AND l.item <> 'Gem0' GROUP BY 1, 2, 3")
def drop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loot and what was left to rot, by zone and mob, from servers of the standard kind."""
    ignore = spark.sql("SELECT 'Gem0' AS item")
    e = rendered.events(spark, sf_dir)
    return loot.drop_counts(loot.drops(e.where(logs.is_standard_server(F.col("server"))), ignore))


@query(_FIGHTS + " SELECT p.fight_id, p.name, p.outbound_hit_sum AS total, CAST(p.outbound_hit_sum // f.duration AS BIGINT) AS dps, CAST(p.outbound_hit_sum * 1000 // nullif(f.hp, 0) AS BIGINT) AS permille_of_hp, CAST(p.outbound_hit_sum * 1000 // nullif(max(p.outbound_hit_sum) OVER (PARTITION BY p.fight_id), 0) AS BIGINT) AS permille_of_top FROM people p JOIN fights f USING (fight_id) WHERE NOT p.is_target")
def damage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return reports.shares(rollups.participant_rollup(t.rows), t.fights)


@query(_FIGHTS + " SELECT fight_id, CAST(row_number() OVER (PARTITION BY fight_id ORDER BY rank_in_fight) AS INTEGER) AS slot, name, outbound_hit_sum FROM (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY CASE WHEN name = 'Player7' AND outbound_hit_sum > 0 THEN 0 ELSE 1 END, rank_in_fight) AS n FROM ranked WHERE NOT is_target) WHERE n <= 3")
def pinned_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pinned_top(rollups.participant_rollup(Tables(spark, sf_dir).rows), ("player7",), 3)


@query(_FIGHTS + """, listed AS (SELECT f.*, p.inbound_hit_count AS hits, (SELECT count(*) FROM people q WHERE q.fight_id = f.fight_id AND NOT q.is_target) AS n FROM fights f LEFT JOIN people p ON p.fight_id = f.fight_id AND p.is_target)
SELECT fight_id, log_id, foe, CAST(row_number() OVER (PARTITION BY log_id ORDER BY updated_on DESC, fight_id) AS INTEGER) AS place, coalesce(zone, 'Unknown') AS zone, strftime(updated_on, '%b %d %H:%M') AS ended, status, hp, duration, CAST(hp // duration AS BIGINT) AS hp_per_second, party || ': ' || n AS party FROM listed WHERE NOT ((duration < 10 OR coalesce(hits, 0) < 5 OR hp < 1000) AND status = 'Timeout')""")  # fmt: skip
def fight_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    found = reports.fight_list(t.fights, rollups.participant_rollup(t.rows))
    return found.withColumn("ended", names.fmt_date(F.col("updated_on"), F.lit("2024-06-01").cast("timestamp"))).drop("updated_on")


@query(_FIGHTS + " SELECT f.fight_id, f.foe FROM fights f LEFT JOIN people p ON p.fight_id = f.fight_id AND p.is_target WHERE status = 'Killed' AND f.duration >= 10 AND coalesce(p.inbound_hit_count, 0) >= 5 AND f.hp >= 1000")
def published_fights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return reports.publishable(t.fights, rollups.participant_rollup(t.rows)).select("fight_id", "foe")


@query(expected.SESSIONS + ", one AS (SELECT log_id, CAST(started_on AS DATE) AS d, party, zone FROM fights QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY start_seq) = 1) SELECT f.fight_id FROM fights f JOIN one o ON o.log_id = f.log_id AND o.d = CAST(f.started_on AS DATE) AND o.party = f.party AND o.zone = f.zone")
def same_evening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fights of the day, party and zone of each log's first."""
    found = Tables(spark, sf_dir).fights
    first = found.groupBy("log_id").agg(F.min_by("fight_id", "start_seq").alias("fight_id"))
    return reports.same_session(found, first, by_zone=True).select("fight_id")


@query(_FIGHTS + " SELECT fight_id, foe FROM fights f WHERE foe = 'Mob3' OR coalesce(lower(zone), '') LIKE '%mob3%' OR EXISTS (SELECT 1 FROM people p WHERE p.fight_id = f.fight_id AND p.name LIKE 'Mob3%')")
def fight_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return reports.search_fights(t.fights, rollups.participant_rollup(t.rows), "MOB3").select("fight_id", "foe")


@query(_FIGHTS + """ SELECT fight_id, name, section, label, CAST(value AS BIGINT) AS value, CAST(per_second AS BIGINT) AS per_second, CAST(pct AS BIGINT) AS pct FROM (
  SELECT p.fight_id, p.name, 'total' AS section, 'total' AS label, outbound_hit_sum AS value, outbound_hit_sum // f.duration AS per_second, NULL AS pct FROM people p JOIN fights f USING (fight_id)
  UNION ALL SELECT fight_id, name, 'taken', '*hit*', inbound_hit_count, NULL, inbound_hit_count * 100 // nullif(inbound_hit_count + inbound_miss_count, 0) FROM people
  UNION ALL SELECT a.fight_id, a.name, 'attack', attack, hit_sum, hit_sum // f.duration, NULL FROM attacks a JOIN fights f USING (fight_id)
  UNION ALL SELECT fight_id, name, 'defense', '*' || type || '*', count, NULL, CAST(floor(count * 100 / nullif(attempts, 0)) AS BIGINT) FROM waterfall)""")  # fmt: skip
def fight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    people = rollups.participant_rollup(t.rows)
    return reports.long_summary(people, t.fights, rollups.attack_rollup(t.rows), rollups.defense_rollup(t.rows, people))


_BOARD = _FIGHTS + """, cut AS (SELECT fight_id, name, least(r, 5) AS slot, CASE WHEN r <= 4 THEN attack ELSE 'other' END AS label, sum(hit_sum) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY fight_id, name ORDER BY hit_sum DESC, attack) AS r FROM attacks) GROUP BY 1, 2, 3, 4),
rates AS (SELECT fight_id, name, slot, label, CAST(s // duration AS BIGINT) AS n FROM cut JOIN fights USING (fight_id) WHERE slot <= 4 OR s > 0),
notes AS (SELECT fight_id, name, string_agg(CASE WHEN n >= 1000000 THEN CAST((n + 5000) // 10000 // 100 AS VARCHAR) || '.' || lpad(CAST((n + 5000) // 10000 % 100 AS VARCHAR), 2, '0') || 'M'
  WHEN n >= 10000 THEN CAST((n + 500) // 1000 AS VARCHAR) || 'K' WHEN n > 1000 THEN CAST((n + 50) // 100 // 10 AS VARCHAR) || '.' || CAST((n + 50) // 100 % 10 AS VARCHAR) || 'K' ELSE CAST(n AS VARCHAR) END || ' ' || label, ', ' ORDER BY slot) AS notes FROM rates GROUP BY 1, 2),
fell AS (SELECT DISTINCT fight_id, died AS name FROM assigned WHERE kind = 'touch')
SELECT p.fight_id, p.name, outbound_hit_sum AS damage, CAST(outbound_hit_sum * 100 // max(outbound_hit_sum) OVER (PARTITION BY p.fight_id) AS BIGINT) AS pct_of_top, CAST(outbound_hit_sum // f.duration AS BIGINT) AS dps,
  CASE WHEN d.name IS NOT NULL THEN 'DIED - ' ELSE '' END || n.notes AS notes
FROM people p JOIN fights f ON f.fight_id = p.fight_id LEFT JOIN notes n ON n.fight_id = p.fight_id AND n.name = p.name LEFT JOIN fell d ON d.fight_id = p.fight_id AND d.name = p.name WHERE NOT p.is_target AND outbound_hit_sum > 0"""


@query(_BOARD)
def player_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    died = attribution.attribute_deaths(t.events.where(F.col("kind") == "death"), t.assigned, t.fights).withColumnRenamed("died", "name")
    return reports.player_board(rollups.participant_rollup(t.rows), t.fights, rollups.attack_rollup(t.rows), died)


_MERGE = _FIGHTS + """, m AS (SELECT fight_id, log_id AS merge_id, started_on, updated_on, foe, hp, CAST(epoch(started_on) AS BIGINT) // 6 AS head, CAST(epoch(updated_on) AS BIGINT) // 6 AS tail FROM fights),
covered AS (SELECT DISTINCT merge_id, unnest(range(head, tail + 1)) AS pos FROM m), placed AS (SELECT merge_id, pos, row_number() OVER (PARTITION BY merge_id ORDER BY pos) - 1 AS n FROM covered),
offsets AS (SELECT m.merge_id, m.fight_id, CAST(p.n AS BIGINT) AS "offset" FROM m JOIN placed p ON p.merge_id = m.merge_id AND p.pos = m.head)"""


def _by_log(f: DataFrame) -> DataFrame:
    return f.select(F.col("log_id").alias("merge_id"), "fight_id")


@query(_MERGE + " SELECT * FROM offsets")
def merged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fights of a log on one timeline without gaps."""
    found = Tables(spark, sf_dir).fights
    return merge.timeline(_by_log(found), found)


@query(_MERGE + ' SELECT merge_id AS fight_id, name, metric, tick + "offset" AS tick, CAST(sum(value) AS BIGINT) AS value FROM series JOIN offsets USING (fight_id) GROUP BY 1, 2, 3, 4')
def merged_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return merge.merged_series(_by_log(t.fights), t.fights, ticks.tick_series(t.rows))


@query(_MERGE + """, mobs AS (SELECT merge_id, foe, count(*) AS n, sum(hp) AS s FROM m GROUP BY 1, 2), notes AS (SELECT merge_id, string_agg(n || ' x ' || foe, ', ' ORDER BY s DESC, foe) AS mob_notes FROM mobs GROUP BY 1)
SELECT m.merge_id AS fight_id, min(started_on) AS started_on, max(updated_on) AS updated_on, CAST(sum(hp) AS BIGINT) AS hp, count(*) AS mob_count, any_value(mob_notes) AS mob_notes, '* ' || count(*) || ' combined mobs' AS name, 'Merged' AS status,
  CAST(epoch(max(updated_on)) - epoch(min(started_on)) + 1 AS BIGINT) AS total_duration FROM m JOIN notes USING (merge_id) GROUP BY 1""")  # fmt: skip
def merged_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Tables(spark, sf_dir).fights
    return merge.merged_header(_by_log(found), found).drop("zone", "party")


@query(_FIGHTS + " SELECT f.log_id AS fight_id, a.name, attack, CAST(sum(hit_count) AS BIGINT) AS hit_count, CAST(sum(hit_sum) AS BIGINT) AS hit_sum, max(hit_max) AS hit_max, CAST(sum(crit_count) AS BIGINT) AS crit_count, CAST(sum(crit_sum) AS BIGINT) AS crit_sum FROM attacks a JOIN fights f USING (fight_id) GROUP BY 1, 2, 3")
def merged_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return merge.merged_rollup(_by_log(t.fights), rollups.attack_rollup(t.rows), ["name", "attack"])


_COUNTERS = ("outbound_hit_count", "outbound_hit_sum", "outbound_miss_count", "outbound_strike_count", "inbound_hit_count", "inbound_hit_sum", "inbound_melee_count", "inbound_melee_sum", "inbound_riposte_sum", "inbound_strike_count", "inbound_miss_count")
_MERGED_PEOPLE = _MERGE + f""", named AS (SELECT f.log_id AS merge_id, p.* REPLACE (CASE WHEN p.is_target THEN 'X' ELSE p.name END AS name) FROM people p JOIN fights f ON f.fight_id = p.fight_id),
busy AS (SELECT merge_id, name, count(DISTINCT tick) * 6 AS busy FROM (
  SELECT o.merge_id, CASE WHEN s.name = f.foe THEN 'X' ELSE s.name END AS name, s.tick + o."offset" AS tick FROM series s JOIN offsets o USING (fight_id) JOIN fights f USING (fight_id)) GROUP BY 1, 2)
SELECT merge_id AS fight_id, name, is_target, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _COUNTERS)}, CAST(coalesce(any_value(busy), 0) AS BIGINT) AS duration FROM named LEFT JOIN busy USING (merge_id, name) GROUP BY 1, 2, 3"""


@query(_MERGED_PEOPLE)
def merged_fights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants of each log's merged fights with the time they were active."""
    t = Tables(spark, sf_dir)
    members = _by_log(t.fights)
    return merge.merged_participants(members, rollups.participant_rollup(t.rows), merge.merged_series(members, t.fights, merge.targets_as_x(ticks.tick_series(t.rows), t.fights)))


_BY_ZONE = _FIGHTS + """, m AS (SELECT fight_id, log_id || '|' || coalesce(zone, 'none') AS merge_id, started_on, updated_on, foe, hp, CAST(epoch(started_on) AS BIGINT) // 6 AS head, CAST(epoch(updated_on) AS BIGINT) // 6 AS tail FROM fights),
covered AS (SELECT DISTINCT merge_id, unnest(range(head, tail + 1)) AS pos FROM m), spots AS (SELECT merge_id, pos, row_number() OVER (PARTITION BY merge_id ORDER BY pos) - 1 AS n FROM covered),
offsets AS (SELECT m.merge_id, m.fight_id, m.foe, CAST(p.n AS BIGINT) AS "offset" FROM m JOIN spots p ON p.merge_id = m.merge_id AND p.pos = m.head),
moved AS (SELECT merge_id, CASE WHEN s.name = o.foe THEN 'X' ELSE s.name END AS name, metric, tick + "offset" AS tick, value FROM series s JOIN offsets o USING (fight_id)),
totals AS (SELECT merge_id, CAST(epoch(max(updated_on)) - epoch(min(started_on)) + 1 AS BIGINT) AS total FROM m GROUP BY 1),
long AS (SELECT t.merge_id, CAST(greatest(1, least(coalesce((SELECT max(tick) + 1 FROM moved x WHERE x.merge_id = t.merge_id AND x.name = 'X') * 6, 0), total)) AS BIGINT) AS duration FROM totals t)"""


def _by_zone(f: DataFrame) -> DataFrame:
    return merge.unmerged(f).select(F.concat_ws("|", "log_id", F.coalesce("zone", F.lit("none"))).alias("merge_id"), "fight_id")


@query(_BY_ZONE + " SELECT merge_id AS fight_id, duration FROM long")
def merged_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the merged fights of a zone took, without gaps and idle ends."""
    t = Tables(spark, sf_dir)
    members = _by_zone(t.fights)
    moved = merge.merged_series(members, t.fights, merge.targets_as_x(ticks.tick_series(t.rows), t.fights))
    return merge.merged_duration(merge.merged_header(members, t.fights), moved).select("fight_id", "duration")


@query(_BY_ZONE + " SELECT merge_id AS fight_id, name, metric, CASE WHEN duration > 600 THEN tick // 5 ELSE tick END AS tick, CAST(sum(value) AS BIGINT) AS value FROM moved JOIN long USING (merge_id) WHERE duration <= 3000 GROUP BY 1, 2, 3, 4")
def fitted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of a zone's merged fights, in buckets that fit their length."""
    t = Tables(spark, sf_dir)
    members = _by_zone(t.fights)
    moved = merge.merged_series(members, t.fights, merge.targets_as_x(ticks.tick_series(t.rows), t.fights))
    return merge.fit_series(merge.merged_duration(merge.merged_header(members, t.fights), moved), moved)


@query(_BY_ZONE + """, sums AS (SELECT m.merge_id, CASE WHEN is_target THEN 'X' ELSE name END AS name, is_target, CAST(sum(outbound_hit_sum) AS BIGINT) AS a, CAST(sum(inbound_melee_sum) AS BIGINT) AS b FROM people JOIN m USING (fight_id) GROUP BY 1, 2, 3),
counted AS (SELECT *, count(*) FILTER (NOT is_target) OVER (PARTITION BY merge_id) AS n FROM sums), many AS (SELECT * FROM counted WHERE n > 8 AND NOT is_target), folded AS (
  SELECT merge_id, CASE WHEN a < 0.6 * max(a) OVER w THEN '*Other' ELSE name END AS name, a, 0 AS b FROM many WINDOW w AS (PARTITION BY merge_id)
  UNION ALL SELECT merge_id, CASE WHEN b < 0.1 * max(b) OVER w THEN '*Other' ELSE name END, 0, b FROM many WINDOW w AS (PARTITION BY merge_id))
SELECT merge_id AS fight_id, name, CAST(sum(a) AS BIGINT) AS outbound_hit_sum, CAST(sum(b) AS BIGINT) AS inbound_melee_sum, CAST(0 AS BIGINT) AS outbound_heal_sum FROM folded GROUP BY 1, 2 HAVING sum(a) > 0 OR sum(b) > 0
UNION ALL SELECT merge_id, name, a, b, 0 FROM counted WHERE n <= 8 OR is_target""")  # fmt: skip
def merged_crowds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants of a zone's merged fights; where they are many, the long tail is one."""
    t = Tables(spark, sf_dir)
    named = rollups.participant_rollup(t.rows).withColumn("name", F.when(F.col("is_target"), "X").otherwise(F.col("name"))).withColumn("outbound_heal_sum", F.lit(0).cast("long"))
    return merge.fold_crowds(merge.merged_rollup(_by_zone(t.fights), named.drop("duration"), ["name", "is_target"]), 8, damage=0.6)



_TAIL = """ SELECT fight_id, name, CAST(sum(a) AS BIGINT) AS outbound_hit_sum, CAST(sum(b) AS BIGINT) AS inbound_melee_sum, CAST(0 AS BIGINT) AS outbound_heal_sum FROM (
  SELECT fight_id, CASE WHEN outbound_hit_sum < 0.3 * max(outbound_hit_sum) OVER w THEN '*Other' ELSE name END AS name, outbound_hit_sum AS a, 0 AS b FROM people WINDOW w AS (PARTITION BY fight_id)
  UNION ALL SELECT fight_id, CASE WHEN inbound_melee_sum < 0.3 * max(inbound_melee_sum) OVER w THEN '*Other' ELSE name END, 0, inbound_melee_sum FROM people WINDOW w AS (PARTITION BY fight_id)
) GROUP BY 1, 2 HAVING sum(a) > 0 OR sum(b) > 0"""


@query(_FIGHTS + _TAIL)
def folded_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = rollups.participant_rollup(Tables(spark, sf_dir).rows).withColumn("outbound_heal_sum", F.lit(0).cast("long"))
    return merge.fold_tail(people, damage=0.3, tank=0.3)


@query(_FIGHTS + " SELECT fight_id, name, 'Player' || row_number() OVER (PARTITION BY fight_id ORDER BY rank_in_fight) AS alias FROM ranked WHERE NOT is_target")
def anonymous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = rollups.participant_rollup(Tables(spark, sf_dir).rows)
    return merge.anonymize(people, F.col("rank_in_fight"))[1]


_LOW = """, low AS (SELECT fight_id, name, outbound_hit_sum < 0.3 * max(outbound_hit_sum) OVER (PARTITION BY fight_id) AS few_hits, inbound_melee_sum < 0.3 * max(inbound_melee_sum) OVER (PARTITION BY fight_id) AS little_taken FROM people)"""


def _tail(t: Tables) -> DataFrame:
    people = rollups.participant_rollup(t.rows).withColumn("outbound_heal_sum", F.lit(0).cast("long"))
    return merge.tail_names(people, damage=0.3, tank=0.3)


@query(_FIGHTS + _LOW + """ SELECT fight_id, CASE WHEN few_hits THEN '*Other' ELSE name END AS name, attack, CAST(sum(hit_count) AS BIGINT) AS hit_count, CAST(sum(hit_sum) AS BIGINT) AS hit_sum, max(hit_max) AS hit_max, CAST(sum(crit_count) AS BIGINT) AS crit_count, CAST(sum(crit_sum) AS BIGINT) AS crit_sum
FROM attacks LEFT JOIN low USING (fight_id, name) GROUP BY 1, 2, 3""")
def tail_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacks, those of who did little damage together."""
    t = Tables(spark, sf_dir)
    rows = rollups.attack_rollup(t.rows).select("fight_id", "name", "attack", "hit_count", "hit_sum", "hit_max", "crit_count", "crit_sum")
    return merge.fold_rows(rows, _tail(t), "damage", ["hit_count", "hit_sum", "crit_count", "crit_sum"], ["hit_max"])


@query(_FIGHTS + _LOW + """ SELECT fight_id, CASE WHEN CASE metric WHEN 'dps' THEN few_hits ELSE little_taken END THEN '*Other' ELSE name END AS name, metric, tick, CAST(sum(value) AS BIGINT) AS value FROM series LEFT JOIN low USING (fight_id, name) GROUP BY 1, 2, 3, 4""")
def tail_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of six-second ticks, those of the tail as one a metric."""
    t = Tables(spark, sf_dir)
    return merge.fold_series(ticks.tick_series(t.rows), _tail(t))


@query(_FIGHTS + expected.HEALS + """, done AS (SELECT fight_id, source AS name, target, CAST(sum(amount) AS BIGINT) AS hit_sum FROM healed GROUP BY 1, 2, 3 HAVING sum(amount) > 0
), listed AS (SELECT *, row_number() OVER (PARTITION BY fight_id, name ORDER BY hit_sum DESC, target) AS place FROM done
), said AS (SELECT fight_id, name, rank_in_fight AS o, 0 AS p, 0 AS place FROM ranked WHERE NOT is_target UNION ALL SELECT l.fight_id, l.target, r.rank_in_fight, 2, l.place FROM listed l JOIN ranked r ON r.fight_id = l.fight_id AND r.name = l.name AND NOT r.is_target
), firsts AS (SELECT s.fight_id, s.name, min({'o': o, 'p': p, 'place': s.place}) AS spot FROM said s JOIN fights f ON f.fight_id = s.fight_id AND f.foe <> s.name GROUP BY 1, 2
), aliases AS (SELECT fight_id, name, 'Player' || row_number() OVER (PARTITION BY fight_id ORDER BY spot, name) AS alias FROM firsts)
SELECT d.fight_id, coalesce(a.alias, d.name) AS name, coalesce(b.alias, d.target) AS target, d.hit_sum FROM done d JOIN ranked r ON r.fight_id = d.fight_id AND r.name = d.name
LEFT JOIN aliases a ON a.fight_id = d.fight_id AND a.name = d.name LEFT JOIN aliases b ON b.fight_id = d.fight_id AND b.name = d.target""")
def anonymous_heals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heals of participants with healers and healed by their aliases."""
    t = Tables(spark, sf_dir)
    people = rollups.participant_rollup(t.rows)
    place = F.row_number().over(Window.partitionBy("fight_id", "name").orderBy(F.col("hit_sum").desc(), "target"))
    done = rollups.heal_rollup(_heals(t)).join(people.select("fight_id", "name"), ["fight_id", "name"], "left_semi")
    decoder = merge.anonymize(people, F.col("rank_in_fight"), done.withColumn("place", place))[1]
    return merge.renamed(merge.renamed(done, decoder), decoder, "target").select("fight_id", "name", "target", "hit_sum")


_RAIDS = expected.RAID_SESSIONS + """, part AS (SELECT *, replace(zone, 'Zone', 'Raid') AS raid, foe = 'Mob8' AND status = 'Killed' AS ended, epoch(started_on) AS began FROM fights WHERE party = 'Raid' AND zone IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY log_id, raid ORDER BY updated_on, end_seq) AS n FROM part),
chain AS (SELECT log_id, raid, n, fight_id, began AS since, 0 AS k, ended FROM numbered WHERE n = 1
  UNION ALL SELECT x.log_id, x.raid, x.n, x.fight_id, CASE WHEN c.ended OR x.began - c.since > 3600 THEN x.began ELSE least(c.since, x.began) END, CASE WHEN c.ended OR x.began - c.since > 3600 THEN c.k + 1 ELSE c.k END, x.ended
  FROM chain c JOIN numbered x ON x.log_id = c.log_id AND x.raid = c.raid AND x.n = c.n + 1),
mobs AS (SELECT c.log_id, c.raid, c.k, foe, count(*) AS n, sum(hp) AS s FROM chain c JOIN part USING (fight_id) GROUP BY ALL), notes AS (SELECT log_id, raid, k, string_agg(n || ' x ' || foe, ', ' ORDER BY s DESC, foe) AS mob_notes FROM mobs GROUP BY ALL)
SELECT c.log_id, c.raid AS name, any_value(p.zone) AS zone, min(p.start_seq) AS start_seq, min(p.started_on) AS started_on, max(p.updated_on) AS updated_on, count(*) AS cohort_count, count(*) AS mob_count, bool_or(p.ended) AS finished, CAST(sum(hp) AS BIGINT) AS hp,
  any_value(mob_notes) AS mob_notes, 'Raid' AS party, CAST(epoch(max(updated_on)) - epoch(min(started_on)) + 1 AS BIGINT) AS total_duration FROM chain c JOIN part p USING (fight_id) JOIN notes o ON o.log_id = c.log_id AND o.raid = c.raid AND o.k = c.k GROUP BY c.log_id, c.raid, c.k"""


@query(_RAIDS)
def raids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raids by template: one a zone, whose last mob ends it and with it the fights of its other mobs."""
    templates = spark.sql("SELECT concat('Raid', z) AS raid, concat('Zone', z) AS zone, concat('Mob', m) AS mob, m = 8 AS ends_on_death FROM (SELECT explode(sequence(0, 4)) AS z) CROSS JOIN (SELECT explode(sequence(0, 8)) AS m)")
    t = Tables(spark, sf_dir)
    found = store.stored(fights.without_friends(fights.fight_table(rendered.assigned(t.events, templates)), t.changes), "raid_fights")
    members, told = merge.raid_membership(found, templates)
    start = members.join(found.select("fight_id", "log_id", "start_seq"), "fight_id").groupBy(F.col("merge_id").alias("fight_id"), "log_id").agg(F.min("start_seq").alias("start_seq"))
    headers = merge.raid_headers(members, told, found).join(start, "fight_id")
    return headers.select("log_id", "name", "zone", "start_seq", "started_on", "updated_on", "cohort_count", "mob_count", "finished", "hp", "mob_notes", "party", "total_duration")


_PSEUDO = """pseudo AS (SELECT log_id, ts, seq, name, '*Died' AS spell FROM extra WHERE kind = 'pdeath' UNION ALL SELECT log_id, ts, seq, foe, '*Died' FROM combat WHERE kind = 'death'
  UNION ALL SELECT log_id, ts, seq, actor, CASE k WHEN 8 THEN '*Shielded by Bulwark' ELSE '*Rescued by DI' END FROM aside WHERE k IN (8, 9))"""


@query(_FIGHTS + f", {_PSEUDO} SELECT fight_id, name, spell, CAST(epoch(d.ts) - epoch(f.started_on) AS BIGINT) AS time FROM people p JOIN fights f USING (fight_id) JOIN pseudo d USING (name) WHERE d.log_id = f.log_id AND epoch(d.ts) - epoch(f.started_on) >= -10 AND d.ts <= f.updated_on")
def death_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deaths, shields and rescues as buffs of the participants of fights around them."""
    t = Tables(spark, sf_dir)
    marks = buffs.pseudo_buffs(t.events)
    return buffs.buffs_in_fight(marks, rollups.participant_rollup(t.rows), t.fights).drop("seq")


@query(_COMBAT + f""", {_PSEUDO}, casts AS (SELECT log_id, seq, name, coalesce(other, 'Bolt') AS spell, true AS cast FROM extra WHERE kind = 'casting' UNION ALL SELECT log_id, seq, name, 'Aura', false FROM extra WHERE kind = 'raw'),
known AS (SELECT *, last_value(CASE WHEN "cast" THEN spell END IGNORE NULLS) OVER (PARTITION BY log_id, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM casts)
SELECT log_id, seq, name AS target, 'Shield of Dew Rk. II' AS spell, 30 AS duration_ticks FROM known WHERE "cast" AND spell = 'Shield'
UNION ALL SELECT log_id, seq, name, 'Dew Aura', 50 FROM known WHERE NOT "cast" AND coalesce(before, '') <> 'Shield' UNION ALL SELECT log_id, seq, name, spell, NULL FROM pseudo""")  # fmt: skip
def buffs_on_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffs by self casts and landing texts, but for texts that the target's own cast explains, and what counts as one."""
    fields = spark.sql("SELECT id, name, target, formula, cap FROM VALUES (1, 'Shield of Dew', '6', '30', '30'), (2, 'Dew Aura I', '41', '50', '50') AS t(id, name, target, formula, cap)")
    given = {0: F.col("id"), 1: F.col("name"), 11: F.col("formula"), 12: F.col("cap"), 30: F.col("target")}
    split = fields.select(F.array(*[given.get(k, F.lit(255)).cast("string") for k in range(spells.FIELDS)]).alias("f"))
    texts = spark.sql("SELECT id, land_self, land_others, '' AS wears_off FROM VALUES (1, 'You feel dewy.', ' glistens.'), (2, 'You feel dewy.', ' glistens.') AS t(id, land_self, land_others)")
    order = spark.sql("SELECT spell, place FROM VALUES ('Shield of Dew', 0), ('Dew Aura I', 1) AS t(spell, place)")
    tracked = buffs.tracked_spells(spells.spells_from_fields(split, texts), order)
    return buffs.buff_events(rendered.events(spark, sf_dir), tracked).drop("ts")


@query("SELECT 'P' || replace(c_name, 'Customer#', '') AS name, CAST(c_custkey % 90 AS INTEGER) AS level, 'ENC' AS class, true AS is_player, 'Friend' AS type FROM customer WHERE c_custkey % 90 > 0")
def roster_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the lines of roster exports, read and taken as who events."""
    name = F.concat(F.lit("P"), F.replace("c_name", F.lit("Customer#"), F.lit("")))
    guild, raid = F.concat_ws("\t", name, F.col("c_custkey") % 90, F.lit("Enchanter"), F.lit("Member")), F.concat_ws("\t", F.col("c_custkey") % 12 + 1, name, F.col("c_custkey") % 90, F.lit("Enchanter"))
    rows = table(spark, sf_dir, "customer").where("c_custkey % 90 > 0").select(F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 2 == 0, guild).otherwise(raid).alias("line"), F.lit("Guild_test-20240105-101500.txt").alias("path"))
    told = rosters.as_who_events(rosters.parse_rosters(rows), F.lit("roster"), F.monotonically_increasing_id())
    columns = [F.lit(None).cast(k).alias(c) for c, k in (("owner", "string"), *rules.FAMILY_COLUMNS.items()) if c not in told.columns]
    _, changes = entities.resolve_foes(store.stored(told.select("*", *columns, F.lit("").alias("text")), "roster"))
    return entities.current_entities(changes).select("name", "level", "class", "is_player", "type")


@query(_FIGHTS + " SELECT fight_id, foe, count(*) AS n_people, CAST(sum(outbound_hit_sum) AS BIGINT) AS total FROM people JOIN fights USING (fight_id) GROUP BY 1, 2")
def fight_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents, one a fight; the counts are read from the nested lists."""
    t = Tables(spark, sf_dir)
    documents = sinks.nest_fights(t.fights, rollups.participant_rollup(t.rows), rollups.attack_rollup(t.rows), ticks.dense(ticks.tick_series(t.rows)))
    return documents.select("fight_id", "foe", F.size("participants").cast("long").alias("n_people"), F.aggregate("participants", F.lit(0).cast("long"), lambda s, p: s + p["outbound_hit_sum"]).alias("total"))


@query(_FIGHTS + " SELECT r.fight_id, CASE WHEN kind = 'hit' AND source IN ('Player1', 'Player2') THEN 'Player0' ELSE source END AS name, CASE WHEN source IN ('Player1', 'Player2') THEN 'pet:' || CASE WHEN riposte THEN 'riposte' ELSE type END ELSE CASE WHEN riposte THEN 'riposte' ELSE type END END AS attack, count(*) AS hit_count, CAST(sum(amount) AS BIGINT) AS hit_sum, max(amount) AS hit_max, count(*) FILTER (crit) AS crit_count, CAST(coalesce(sum(amount) FILTER (crit), 0) AS BIGINT) AS crit_sum FROM frows r WHERE kind = 'hit' GROUP BY 1, 2, 3")
def pets_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacks with two names credited to a third as its pets."""
    t = Tables(spark, sf_dir)
    owners = t.events.select("log_id").distinct().select("log_id", F.explode(F.array(F.lit("Player1"), F.lit("Player2"))).alias("name"), F.lit("Player0").alias("owner"))
    return rollups.attack_rollup(rollups.merge_pets(t.rows, owners))


@query(_COMBAT + " SELECT log_id, source AS name, TIMESTAMP '2024-01-01' + to_seconds(CAST(epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) // 6 * 6) AS window_start, CAST(sum(amount) AS BIGINT) AS damage FROM combat WHERE kind = 'hit' AND source IS NOT NULL GROUP BY 1, 2, 3")
def tumbling_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.tumbling_damage(rendered.events(spark, sf_dir).where("source is not null"))


@query(_COMBAT + expected.ACTS + expected.placed("found", "swung") + ", g AS (SELECT a.*, CASE WHEN epoch(ts) < max(epoch(ts) + CASE WHEN party = 'Raid' THEN 120 ELSE 15 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS isnew FROM swung a JOIN found p ON p.log_id = a.log_id AND p.seq = a.seq WHERE kind IN ('hit', 'miss') WINDOW w AS (PARTITION BY a.log_id, foe ORDER BY a.seq)), r AS (SELECT *, sum(isnew) OVER (PARTITION BY log_id, foe ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT log_id, foe, min(ts) AS started_on, count(*) AS n, CAST(coalesce(sum(amount) FILTER (kind = 'hit'), 0) AS BIGINT) AS damage FROM r GROUP BY log_id, foe, run")
def quick_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by idle gap alone; every row keeps its session open for its own gap."""
    return live.quick_sessions(rendered.combat(spark, sf_dir).where("foe is not null and source is not null"))


@query("""SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS INTEGER) AS session, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS cents, bool_or(event_type = 'purchase') AS ended FROM (
  SELECT *, sum(isnew) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR lag(event_type) OVER w = 'purchase' OR epoch(ts) - epoch(lag(ts) OVER w) >= 21600 THEN 1 ELSE 0 END AS isnew FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, run""")  # fmt: skip
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: six hours without an event or a purchase end one."""
    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    at = F.col("ts").cast("timestamp").cast("double")
    idle = at - F.lag(at).over(user)
    fresh = F.coalesce((F.lag("event_type").over(user) == "purchase") | (idle >= 21600), F.lit(True)).cast("int")
    runs = e.withColumn("_f", fresh).withColumn("run", F.sum("_f").over(user.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", F.col("run").cast("int").alias("session")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100)).cast("long").alias("cents"), F.bool_or(F.col("event_type") == "purchase").alias("ended"))


def _order_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as hits: an order is a fight, a supplier who strikes, a return flag the attack, a discount over 5 % a critical."""
    crit = F.when(F.col("l_discount") > 0.05, F.array(F.lit("Critical"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fight_id"), F.lit("hit").alias("kind"), F.col("l_suppkey").cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.col("l_returnflag").alias("type"), crit.alias("mods"), F.floor("l_extendedprice").cast("long").alias("amount"), F.lit(None).cast("string").alias("spell"), F.col("l_shipdate").alias("ts"))


_ORDER_ATTACKS = "SELECT l_orderkey AS fight_id, CAST(l_suppkey AS VARCHAR) AS name, l_returnflag AS attack, count(*) AS hit_count, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS hit_sum, CAST(max(floor(l_extendedprice)) AS BIGINT) AS hit_max, count(*) FILTER (l_discount > 0.05) AS crit_count, CAST(coalesce(sum(floor(l_extendedprice)) FILTER (l_discount > 0.05), 0) AS BIGINT) AS crit_sum FROM lineitem GROUP BY 1, 2, 3"


@query(_ORDER_ATTACKS)
def order_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.attack_rollup(_order_hits(spark, sf_dir))


@query("SELECT fight_id, name, total, rank, CAST(total * 100 // top AS BIGINT) AS pct_of_top FROM (SELECT l_orderkey AS fight_id, CAST(l_suppkey AS VARCHAR) AS name, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY sum(floor(l_extendedprice)) DESC, CAST(l_suppkey AS VARCHAR)) AS INTEGER) AS rank, CAST(max(sum(floor(l_extendedprice))) OVER (PARTITION BY l_orderkey) AS BIGINT) AS top FROM lineitem GROUP BY 1, 2) WHERE rank <= 3")
def order_top_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _order_hits(spark, sf_dir).groupBy("fight_id", F.col("source").alias("name")).agg(F.sum("amount").alias("total"))
    fight = Window.partitionBy("fight_id")
    ranked = sums.withColumn("rank", F.row_number().over(fight.orderBy(F.col("total").desc(), "name"))).withColumn("top", F.max("total").over(fight))
    return ranked.where("rank <= 3").select("fight_id", "name", "total", "rank", F.floor(F.col("total") * 100 / F.col("top")).cast("long").alias("pct_of_top"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS name, CAST(epoch(l_shipdate) AS BIGINT) // 2592000 AS tick, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2")
def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts by supplier in buckets of 30 days."""
    hits = _order_hits(spark, sf_dir)
    bucket = ticks.tick(F.col("ts"), F.timestamp_seconds(F.lit(0)), 86400 * 30)
    return hits.groupBy(F.col("source").alias("name"), bucket.alias("tick")).agg(F.sum("amount").alias("value"))


_SUPPLIERS = "SELECT n_regionkey AS fight_id, CAST(s_suppkey AS VARCHAR) AS name, sum(floor(l_extendedprice)) AS a FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2"


@query(f"SELECT fight_id, name, CAST(sum(a) AS BIGINT) AS outbound_hit_sum, CAST(0 AS BIGINT) AS inbound_melee_sum, CAST(0 AS BIGINT) AS outbound_heal_sum FROM (SELECT fight_id, CASE WHEN a < 0.95 * max(a) OVER (PARTITION BY fight_id) THEN '*Other' ELSE name END AS name, a FROM ({_SUPPLIERS})) GROUP BY 1, 2")
def supplier_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a region, all below 95 % of its largest folded into one."""
    sums = _order_hits(spark, sf_dir).groupBy(F.col("source").alias("name")).agg(F.sum("amount").alias("outbound_hit_sum"))
    where = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("name"), F.col("n_regionkey").alias("fight_id"))
    rows = sums.join(where, "name").withColumns({"inbound_melee_sum": F.lit(0).cast("long"), "outbound_heal_sum": F.lit(0).cast("long")})
    return merge.fold_tail(rows, damage=0.95)


_MASK = " + ".join(f"CASE WHEN (p_partkey * 7 + {k * 31}) % 300 < 255 THEN {1 << k} ELSE 0 END" for k in range(16))


@query("SELECT p_partkey AS id, CASE WHEN f = 0 THEN 0 WHEN f IN (1, 6, 12) THEN least(v, 127) WHEN f = 5 THEN least(v, 2) WHEN f = 7 THEN least(v, 254) ELSE v END AS duration_ticks, CAST(mask AS INTEGER) AS class_mask, CAST(bit_count(CAST(mask AS INTEGER)) AS INTEGER) AS class_count FROM (SELECT p_partkey, (p_partkey % 8) AS f, CASE p_partkey % 8 WHEN 2 THEN 100 WHEN 3 THEN 100 WHEN 4 THEN 50 ELSE 100 END AS v, " + _MASK + " AS mask FROM part)")
def spell_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spell table made of ``part``: durations by formula (cap 100) and class masks from levels."""
    key = F.col("p_partkey")
    levels = {36 + k: (key * 7 + k * 31) % 300 for k in range(16)}
    given = {0: key, 1: F.concat(F.lit("Spell "), key), 11: key % 8, 12: F.lit(100), 30: F.lit(5), **levels}
    fields = F.array(*[given.get(k, F.lit(0)).cast("string") for k in range(spells.FIELDS)])
    return spells.spells_from_fields(table(spark, sf_dir, "part").select(fields.alias("f"))).select(F.col("id").cast("long").alias("id"), "duration_ticks", "class_mask", "class_count")


@query("SELECT c_custkey, CASE WHEN n >= 10000 THEN CAST((n + 500) // 1000 AS VARCHAR) || 'K' WHEN n > 1000 THEN CAST((n + 50) // 100 // 10 AS VARCHAR) || '.' || CAST((n + 50) // 100 % 10 AS VARCHAR) || 'K' ELSE CAST(n AS VARCHAR) END AS short, CASE WHEN length(c_name) > 12 THEN trim(c_name[1:10]) || '..' ELSE c_name END AS clipped FROM (SELECT c_custkey, c_name, CAST(floor(abs(c_acctbal) * 3) AS BIGINT) AS n FROM customer)")
def short_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.abs("c_acctbal") * 3).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", names.fmt_num(n).alias("short"), names.clip(F.col("c_name"), 12).alias("clipped"))


@query("SELECT p_partkey, upper(p_name[1:1]) || p_name[2:] AS fixed, p_name AS base, p_name IN ('yourself') AS own FROM part")
def fixed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as mob names: a possessive ending and a rank are put on and taken off again."""
    p = table(spark, sf_dir, "part")
    name = F.col("p_name")
    fixed = names.fix_name(F.concat(name, F.lit("'s")), F.lit("Larry"))
    return p.select("p_partkey", fixed.alias("fixed"), names.strip_rank(F.concat(name, F.lit(" Rk. III"))).alias("base"), (names.fix_name(name, F.lit("Larry")) == "Larry").alias("own"))


@query("SELECT name, class, owner, is_player, strftime(d, '%Y-%m-%d') AS updated_on FROM (SELECT 'P' || c_custkey AS name, 'RNG' AS class, CAST(NULL AS VARCHAR) AS owner, true AS is_player, DATE '2024-02-01' - CAST(c_custkey % 60 AS INTEGER) AS d FROM customer WHERE c_custkey % 60 <= 30)")
def registry_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as known players: exported to text and read back as of a day."""
    day = F.date_sub(F.lit("2024-02-01").cast("date"), (F.col("c_custkey") % 60).cast("int"))
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), F.col("c_custkey")).alias("name"), F.lit("RNG").alias("class"), F.lit(None).cast("string").alias("owner"), F.lit(True).alias("is_player"), day.alias("updated_on"))
    text = rosters.export_registry(known).select(F.concat_ws(":", "name", "class", F.coalesce("owner", F.lit("")), F.date_format("updated_on", "yyyy-MM-dd")).alias("data"))
    return rosters.import_registry(text, F.lit("2024-02-01").cast("date")).withColumn("updated_on", F.col("updated_on").cast("string"))


_TOLD = """SELECT c_custkey, ['Gobaner', 'Jabn', 'Bob', 'Kebeker', 'Xan', 'Vartik', 'Lor', 'Zebarab'][c_custkey % 8 + 1] AS pet, ['Ancient: Fire', 'Zap IV', 'Zap Rk. II', 'Zap Rk.III', 'Zap'][c_custkey % 5 + 1] AS spell, c_custkey % 3 AS ticks,
  ['Bob`s pet', 'Eye of Al', 'Al''s warder', 'Moe`s ward', 'Moe', 'Moe`s petal'][c_custkey % 6 + 1] AS who, ['himself', 'herself', 'itself', 'Rat'][c_custkey % 4 + 1] AS target, ['Critical', 'Lucky Critical', 'Twincast', 'Riposte Strikethrough', 'Flurry', 'Lucky Flurry', ''][c_custkey % 7 + 1] AS tag FROM customer"""


def _tags(kind: str) -> str:
    """The mods of a tag's words by the table of its kind, each once, sorted."""
    known = " ".join(f"WHEN '{word}' THEN {mods!r}" for word, mods in names.MOD_WORDS[kind].items())
    return f"array_to_string(list_sort(list_distinct(flatten(list_transform(string_split(lower(tag), ' '), lambda w: CASE w {known} ELSE [] END)))), ',')"


@query(f"""WITH told AS ({_TOLD}) SELECT c_custkey, regexp_matches(pet, '^[GJKLVXZ]([aeio][bknrs]){{0,2}}(ab|er|n|tik)$') AS is_pet, starts_with(spell, 'Ancient:') OR regexp_matches(spell, 'Rk[.]\\s?I?II$') OR (regexp_matches(spell, '\\s[XVI]{{1,4}}$') AND ticks > 0) AS was_cast,
  CASE WHEN who LIKE 'Eye of %' THEN who[8:] WHEN regexp_matches(who, '[''`]s (warder|ward|pet)$') THEN regexp_extract(who, '^(.+)[''`]s', 1) END AS owner, CASE WHEN target LIKE '%self' THEN who ELSE target END AS target,
  {_tags('heal')} AS heal_tags, {_tags('miss')} AS miss_tags FROM told""")
def name_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pets' names, spells that were cast, owners by names, reflexive targets and tags, on words dealt over customers."""
    key = F.col("c_custkey")

    def dealt(*words: str) -> Column:
        return F.get(F.array(*map(F.lit, words)), (key % len(words)).cast("int"))

    who, tag = dealt("Bob`s pet", "Eye of Al", "Al's warder", "Moe`s ward", "Moe", "Moe`s petal"), dealt("Critical", "Lucky Critical", "Twincast", "Riposte Strikethrough", "Flurry", "Lucky Flurry", "")
    tags = {f"{k}_tags": F.array_join(F.array_sort(names.parse_mods(tag, k)), ",") for k in ("heal", "miss")}
    return table(spark, sf_dir, "customer").select(
        "c_custkey", names.is_pet_name(dealt("Gobaner", "Jabn", "Bob", "Kebeker", "Xan", "Vartik", "Lor", "Zebarab")).alias("is_pet"),
        names.unlikely_click(dealt("Ancient: Fire", "Zap IV", "Zap Rk. II", "Zap Rk.III", "Zap"), key % 3).alias("was_cast"), names.pet_owner(who).alias("owner"),
        names.reflexive(dealt("himself", "herself", "itself", "Rat"), who).alias("target"), *[c.alias(n) for n, c in tags.items()],
    )


_GATED = """WITH told AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN TIMESTAMP '1990-05-05' ELSE date_trunc('second', o_orderdate) END AS ts,
  CASE o_orderkey % 6 WHEN 0 THEN 'You cannot see your target.' WHEN 1 THEN 'You have entered an area where Bind Affinity is allowed.' WHEN 2 THEN 'You have entered Zone' || (o_orderkey % 9) || '.' WHEN 3 THEN 'You cannot see your target' ELSE 'Your Location is ' || (o_orderkey % 50) || '.25, -' || (o_orderkey % 7) || '.50, ' || (o_orderkey % 3) || '.75' END AS text FROM orders)
SELECT o_orderkey AS seq, CASE WHEN year(ts) = 1990 THEN TIMESTAMP '1994-01-01' ELSE ts END AS ts, CASE WHEN o_orderkey % 6 = 2 THEN 'zone' WHEN o_orderkey % 6 > 3 THEN 'location' ELSE 'raw' END AS kind, CASE WHEN o_orderkey % 6 = 2 THEN 'Zone' || (o_orderkey % 9) END AS name,
  CAST(CASE WHEN o_orderkey % 6 > 3 THEN o_orderkey % 50 END AS BIGINT) AS y, CAST(CASE WHEN o_orderkey % 6 > 3 THEN -(o_orderkey % 7) END AS BIGINT) AS x, CAST(CASE WHEN o_orderkey % 6 > 3 THEN o_orderkey % 3 END AS BIGINT) AS z
FROM told WHERE o_orderkey % 6 <> 0 AND (year(ts) = 1990 OR (ts >= TIMESTAMP '1994-01-01' AND ts <= TIMESTAMP '1996-12-31'))"""


@query(_GATED)
def gated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made of orders between two dates, without noise; zones that are none, and the location rule beside the defaults."""
    key = F.col("o_orderkey")
    stamp = F.when(key % 13 == 0, F.lit("1990-05-05").cast("timestamp")).otherwise(F.col("o_orderdate"))
    place = F.concat(F.lit("Your Location is "), key % 50, F.lit(".25, -"), key % 7, F.lit(".50, "), key % 3, F.lit(".75"))
    text = (
        F.when(key % 6 == 0, "You cannot see your target.").when(key % 6 == 1, "You have entered an area where Bind Affinity is allowed.")
        .when(key % 6 == 2, F.concat(F.lit("You have entered Zone"), key % 9, F.lit("."))).when(key % 6 == 3, "You cannot see your target").otherwise(place)
    )
    line = F.concat(F.lit("["), F.date_format(stamp, "EEE MMM dd HH:mm:ss yyyy"), F.lit("] "), text)
    made = table(spark, sf_dir, "orders").select(F.lit("log").alias("log_id"), key.alias("seq"), F.lit("Ann").alias("owner"), F.lit("test").alias("server"), line.alias("line"))
    e = rules.extract_events(split_lines(store.spread(made), min_date="1994-01-01", max_date="1996-12-31"), [*rules.DEFAULT_RULES, rules.LOCATION])
    return e.select("seq", "ts", "kind", "name", *[F.col(c).cast("long").alias(c) for c in "yxz"])


@query(duel.FOES)
def duel_foes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foe of every swing in a log of duels: conflicts, pets, aggression and deaths decide."""
    return entities.foes_and_changes(duel.folded(spark, sf_dir))[0]


@query(duel.ENTITIES)
def duel_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of everyone in the end: type, owner by tells, spells, landing texts and names, class by deeds and casts."""
    changes = entities.foes_and_changes(duel.folded(spark, sf_dir))[1]
    return entities.current_entities(changes).select("log_id", "name", "type", "is_player", "owner", "class", "level")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_damage(spark, sf_dir)
