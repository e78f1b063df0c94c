"""The rendered log and its fights as SQL, from the columns of ``events``: what many queries' SQL starts from."""

from __future__ import annotations

COMBAT = """
WITH RECURSIVE raw AS (
  SELECT event_id AS i, event_id % 2000 AS j, 'eqlog_Larry_' || CAST(event_id // 2000 AS VARCHAR) AS log_id, TIMESTAMP '2024-01-01' + to_seconds(2 * event_id) AS ts,
    'Player' || (user_id % 12) AS actor, 'Player' || ((user_id + 1) % 12) AS other, 'Mob' || (((event_id // 50) + (user_id % 2)) % 9) AS foe,
    event_type AS et, value, CAST(floor(value * 100) AS BIGINT) AS amount FROM events
), base AS (
  SELECT i * 32 AS seq, i, j, log_id, ts, foe, actor, other,
    CASE WHEN et = 'view' THEN 'miss' WHEN et = 'signup' THEN 'heal' WHEN et = 'purchase' AND value > 100 THEN 'death' ELSE 'hit' END AS kind,
    CASE WHEN (et = 'click' AND i % 5 = 0) OR (et = 'view' AND i % 2 = 0) THEN foe WHEN et = 'purchase' AND value > 100 THEN NULL ELSE actor END AS source,
    CASE WHEN (et = 'click' AND i % 5 = 0) OR (et = 'view' AND i % 2 = 0) THEN actor WHEN et = 'signup' THEN other WHEN et = 'purchase' AND value > 100 THEN NULL ELSE foe END AS target,
    CASE WHEN et IN ('click', 'error') OR (et = 'purchase' AND NOT value > 100) THEN amount WHEN et = 'signup' THEN amount // 2 END AS amount,
    CASE WHEN et = 'signup' THEN amount END AS full_amount,
    CASE WHEN et = 'click' THEN CASE WHEN i % 5 = 0 THEN 'bite' ELSE 'slash' END WHEN et = 'error' THEN 'dot' WHEN et = 'view' THEN CASE WHEN i % 2 = 0 THEN 'dodge' ELSE 'miss' END WHEN et = 'purchase' AND NOT value > 100 THEN 'ds' END AS type,
    CASE WHEN et = 'error' THEN 'Plague Bolt' WHEN et = 'signup' THEN 'Light Touch' END AS spell,
    et IN ('click', 'error') AND i % 13 <> 0 AND i % 11 <> 0 AND i % 7 = 0 AS crit,
    et IN ('click', 'error') AND (i % 13 = 0 OR i % 11 = 0) AS strike,
    et IN ('click', 'error') AND i % 13 = 0 AS riposte
  FROM raw WHERE i % 101 <> 0
), combat AS (
  SELECT * FROM base
  UNION ALL SELECT i * 32 + 4, i, j, log_id, ts, foe, actor, other, 'hit', NULL, foe, 7, NULL, 'dot', 'Creeping Doom', false, false, false FROM raw WHERE j >= 3 AND i % 37 = 0
  UNION ALL SELECT i * 32 + 21, i, j, log_id, ts, foe, actor, other, 'hit', actor || '''s corpse', foe, i % 50 + 1, NULL, 'dot', 'Plague Bolt', false, false, false FROM raw WHERE j >= 3 AND i % 89 = 0
  UNION ALL SELECT i * 32 + 22, i, j, log_id, ts, foe, actor, other, 'hit', foe || '''s corpse', actor, 3, NULL, 'dot', 'Rot', false, false, false FROM raw WHERE j >= 3 AND i % 83 = 0
  UNION ALL SELECT i * 32 + 24, i, j, log_id, ts, foe, actor, other, 'heal', 'Medic' || (i % 5), actor, i % 90 + 1, i % 90 + 1, NULL, 'Light Touch', false, false, false FROM raw WHERE j >= 3 AND i % 59 = 0
  UNION ALL SELECT i * 32 + 25, i, j, log_id, ts, foe, actor, other, 'heal', 'Medic' || (i % 5), 'Orphan' || (i % 7), 3, 3, NULL, 'Light Touch', false, false, false FROM raw WHERE j >= 3 AND i % 19 = 0
  UNION ALL SELECT i * 32 + 26, i, j, log_id, ts, foe, actor, other, 'heal', 'Orphan' || (i % 7), 'Stray' || (i % 4), 2, 2, NULL, 'Light Touch', false, false, false FROM raw WHERE j >= 3 AND i % 13 = 0
  UNION ALL SELECT i * 32 + 27, i, j, log_id, ts, foe, actor, other, 'heal', 'Stray' || (i % 4), 'Orphan' || ((i + 1) % 7), 1, 1, NULL, 'Light Touch', false, false, false FROM raw WHERE j >= 3 AND i % 17 = 0
), aside AS (
  SELECT i * 32 + 5 AS seq, i, log_id, ts, actor, other, foe, 'Gem' || (i % 6) AS gem, (i // 23) % 17 AS k FROM raw WHERE j >= 3 AND i % 23 = 0
), extra AS (
  SELECT i * 32 + 1 AS seq, log_id, ts, 'pdeath' AS kind, actor AS name, foe AS other FROM raw WHERE i % 61 = 0
  UNION ALL SELECT i * 32 + 2, log_id, ts, 'zone', 'Zone' || ((i // 97) % 5), NULL FROM raw WHERE i % 97 = 0
  UNION ALL SELECT i * 32 + 2, log_id, ts, 'loot', 'Gem' || (i % 6), foe FROM raw WHERE j >= 3 AND i % 97 <> 0 AND i % 41 = 0
  UNION ALL SELECT i * 32 + 2, log_id, ts, 'who', actor, NULL FROM raw WHERE j >= 3 AND i % 97 <> 0 AND i % 41 <> 0 AND i % 29 = 0
  UNION ALL SELECT i * 32 + 3, log_id, ts, 'party', CASE (i // 211) % 3 WHEN 0 THEN 'RaidJoined' WHEN 1 THEN 'RaidLeft' ELSE 'GroupLeft' END, NULL FROM raw WHERE i % 211 = 0
  UNION ALL SELECT i * 32 + 3, log_id, ts, 'casting', actor, NULL FROM raw WHERE i % 211 <> 0 AND i % 53 = 0
  UNION ALL SELECT i * 32 + 8 + p, log_id, ts, 'who', 'Player' || p, NULL FROM raw, (SELECT unnest(range(12)) AS p) WHERE j = 2
  UNION ALL SELECT i * 32 + 6, log_id, ts, 'casting', actor, 'Shield' FROM raw WHERE j >= 3 AND i % 31 = 0
  UNION ALL SELECT i * 32 + 7, log_id, ts, 'raw', actor, 'Aura' FROM raw WHERE j >= 3 AND i % 43 = 0
  UNION ALL SELECT i * 32 + 23, log_id, ts, 'raw', 'Larry', 'Aura' FROM raw WHERE j >= 3 AND i % 47 = 0
  UNION ALL SELECT i * 32 + 20, log_id, ts, 'consider', foe, NULL FROM raw WHERE j >= 3 AND i % 89 = 0
), marks AS (
  SELECT log_id, seq, name AS zone, CAST(NULL AS VARCHAR) AS fixed, CAST(NULL AS VARCHAR) AS moved FROM extra WHERE kind = 'zone'
  UNION ALL SELECT log_id, seq, NULL, CASE name WHEN 'RaidJoined' THEN 'Raid' WHEN 'RaidLeft' THEN 'Group' END, CASE name WHEN 'GroupLeft' THEN 'Solo' END FROM extra WHERE kind = 'party'
  UNION ALL SELECT log_id, seq, NULL, CASE k WHEN 4 THEN 'Solo' END, CASE k WHEN 0 THEN 'Group' END FROM aside WHERE k IN (0, 4)
)"""

_PLACED = """, {name}_all AS (SELECT log_id, seq, zone, fixed, moved, false AS asked FROM marks UNION ALL SELECT DISTINCT log_id, seq, NULL, NULL, NULL, true FROM {rows}
), {name}_last AS (
  SELECT log_id, seq, asked, last_value(zone IGNORE NULLS) OVER w AS zone, last_value(fixed IGNORE NULLS) OVER w AS p, last_value(CASE WHEN fixed IS NOT NULL THEN seq END IGNORE NULLS) OVER w AS p_at,
    last_value(moved IGNORE NULLS) OVER w AS g, last_value(CASE WHEN moved IS NOT NULL THEN seq END IGNORE NULLS) OVER w AS g_at
  FROM {name}_all WINDOW w AS (PARTITION BY log_id ORDER BY seq, asked ROWS UNBOUNDED PRECEDING)
), {name} AS (SELECT log_id, seq, zone, CASE WHEN p IN ('Solo', 'Group') AND g_at > p_at THEN g ELSE p END AS party FROM {name}_last WHERE asked)"""


def placed(name: str, rows: str) -> str:
    """A table ``name`` of (log_id, seq, zone, party): what held at the rows of another."""
    return _PLACED.format(name=name, rows=rows)


ACTS = """, swung AS (
  SELECT seq, i, log_id, ts, kind, foe, replace(source, '''s corpse', '') AS source, target, amount, type, spell, crit, strike, riposte, CAST(NULL AS VARCHAR) AS died FROM combat
  WHERE (kind IN ('hit', 'miss') AND j >= 3 AND source IS NOT NULL AND source <> foe || '''s corpse') OR kind = 'death'
  UNION ALL SELECT seq, seq // 32, log_id, ts, 'touch', other, NULL, NULL, NULL, NULL, NULL, false, false, false, name FROM extra WHERE kind = 'pdeath'
)"""

_SESSIONS = """, flagged AS (
  SELECT a.*, zone, party, CASE WHEN lag(ts) OVER w IS NULL OR lag(kind) OVER w IN ('death', 'forced') OR epoch(ts) - epoch(lag(ts) OVER w) >= CASE WHEN party = 'Raid' THEN 120 ELSE 15 END THEN 1 ELSE 0 END AS isnew
  FROM acts a JOIN held h ON h.log_id = a.log_id AND h.seq = a.seq WINDOW w AS (PARTITION BY a.log_id, foe ORDER BY a.seq, kind = 'forced')
), runs AS (
  SELECT *, sum(isnew) OVER (PARTITION BY log_id, foe ORDER BY seq, kind = 'forced' ROWS UNBOUNDED PRECEDING) AS run FROM flagged
), opened AS (
  SELECT *, min(CASE WHEN kind IN ('hit', 'miss') THEN seq END) OVER (PARTITION BY log_id, foe, run) AS start_seq FROM runs
), kept_open AS (
  SELECT * EXCLUDE (isnew, run), sha256(log_id || '|' || foe || '|' || start_seq) AS fight_id FROM opened WHERE seq >= start_seq AND kind <> 'forced'
), starts AS (
  SELECT log_id, foe, fight_id, start_seq, min(ts) AS opened_on FROM kept_open GROUP BY 1, 2, 3, 4
), pend AS (
  SELECT c.seq, c.i, c.log_id, c.ts, c.kind, c.foe, c.source, c.target, c.amount, c.type, c.spell, c.crit, c.strike, c.riposte, CAST(NULL AS VARCHAR) AS died, CAST(NULL AS VARCHAR) AS zone, CAST(NULL AS VARCHAR) AS party, s.start_seq, s.fight_id
  FROM combat c JOIN starts s ON s.log_id = c.log_id AND s.foe = c.foe WHERE c.kind = 'hit' AND c.j < 3 AND c.seq < s.start_seq AND epoch(s.opened_on) - epoch(c.ts) <= 60
  QUALIFY row_number() OVER (PARTITION BY c.log_id, c.seq ORDER BY s.start_seq) = 1
), assigned AS (SELECT * FROM kept_open UNION ALL SELECT * FROM pend
), everyfight AS (
  SELECT fight_id, log_id, foe, start_seq, min(ts) FILTER (seq >= start_seq) AS started_on, max(ts) FILTER (seq >= start_seq) AS updated_on, max(seq) AS end_seq,
    CASE WHEN bool_or(kind = 'death') THEN 'Killed' ELSE 'Timeout' END AS status,
    CAST(coalesce(sum(CASE WHEN kind = 'hit' AND target = foe THEN amount END), 0) AS BIGINT) AS hp,
    first(zone ORDER BY seq) FILTER (seq >= start_seq) AS zone, coalesce(last(party ORDER BY seq) FILTER (seq >= start_seq), 'Solo') AS party,
    CAST(epoch(max(ts) FILTER (seq >= start_seq)) - epoch(min(ts) FILTER (seq >= start_seq)) + 1 AS BIGINT) AS duration,
    (bool_or(kind = 'death') OR coalesce(sum(CASE WHEN kind = 'hit' AND target = foe THEN amount END), 0) > 0) AND coalesce(bool_or(kind = 'hit' AND amount > 0 AND (source <> foe OR target <> foe)), false) AS kept
  FROM assigned GROUP BY fight_id, log_id, foe, start_seq
), fights AS (SELECT * EXCLUDE (kept) FROM everyfight WHERE kept
), frows AS (
  SELECT a.*, f.started_on, f.duration AS fight_duration FROM assigned a JOIN fights f USING (fight_id)
)"""

#: Fights of the rendered log.
SESSIONS = COMBAT + ACTS + ", acts AS (SELECT * FROM swung)" + placed("held", "acts") + _SESSIONS

#: Fights that end with their raid: templates have a raid a zone, ended by Mob8.
RAID_SESSIONS = (
    COMBAT
    + ACTS
    + placed("died", "swung")
    + """, acts AS (SELECT * FROM swung UNION ALL SELECT s.seq, s.i, s.log_id, s.ts, 'forced', 'Mob' || m, NULL, NULL, NULL, NULL, NULL, false, false, false, NULL
  FROM swung s JOIN died d ON d.log_id = s.log_id AND d.seq = s.seq, (SELECT unnest(range(8)) AS m) WHERE s.kind = 'death' AND s.foe = 'Mob8' AND d.party = 'Raid' AND d.zone IS NOT NULL)"""
    + placed("held", "acts")
    + _SESSIONS
)

#: Participants, attacks, defenses and series of fights.
FIGHTS = (
    SESSIONS
    + """, swings AS (
  SELECT fight_id, foe, seq, ts, kind, source, target, amount, type, spell, crit, strike, riposte, fight_duration, false AS derived FROM frows WHERE kind IN ('hit', 'miss')
  UNION ALL SELECT fight_id, foe, seq, ts, 'miss', source, target, NULL, 'unknown', NULL, false, false, false, fight_duration, true FROM frows WHERE kind = 'hit' AND strike AND NOT riposte
), sides AS (
  SELECT *, source AS name, 'out' AS side FROM swings UNION ALL SELECT *, target, 'in' FROM swings
), everyone AS (
  SELECT fight_id, name, name = foe AS is_target,
    count(*) FILTER (kind = 'hit' AND side = 'out') AS outbound_hit_count,
    CAST(coalesce(sum(amount) FILTER (kind = 'hit' AND side = 'out'), 0) AS BIGINT) AS outbound_hit_sum,
    count(*) FILTER (kind = 'miss' AND side = 'out' AND NOT derived) AS outbound_miss_count,
    count(*) FILTER (kind = 'hit' AND side = 'out' AND strike) AS outbound_strike_count,
    count(*) FILTER (kind = 'hit' AND side = 'in') AS inbound_hit_count,
    CAST(coalesce(sum(amount) FILTER (kind = 'hit' AND side = 'in'), 0) AS BIGINT) AS inbound_hit_sum,
    count(*) FILTER (kind = 'hit' AND side = 'in' AND spell IS NULL) AS inbound_melee_count,
    CAST(coalesce(sum(amount) FILTER (kind = 'hit' AND side = 'in' AND spell IS NULL), 0) AS BIGINT) AS inbound_melee_sum,
    CAST(coalesce(sum(amount) FILTER (kind = 'hit' AND side = 'in' AND riposte), 0) AS BIGINT) AS inbound_riposte_sum,
    count(*) FILTER (kind = 'hit' AND side = 'in' AND strike) AS inbound_strike_count,
    count(*) FILTER (kind = 'miss' AND side = 'in') AS inbound_miss_count,
    min(ts) AS first_action, max(ts) AS last_action,
    CAST(CASE WHEN name = foe THEN any_value(fight_duration) ELSE epoch(max(ts)) - epoch(min(ts)) + 1 END AS BIGINT) AS duration
  FROM sides GROUP BY fight_id, name, foe
), people AS (SELECT * FROM everyone WHERE is_target OR outbound_hit_sum > 0 OR inbound_hit_sum > 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY outbound_hit_sum DESC, name) AS rank_in_fight FROM people
), attacks AS (
  SELECT fight_id, source AS name, CASE WHEN riposte THEN 'riposte' ELSE type END AS attack, count(*) AS hit_count, CAST(sum(amount) AS BIGINT) AS hit_sum, max(amount) AS hit_max,
    count(*) FILTER (crit) AS crit_count, CAST(coalesce(sum(amount) FILTER (crit), 0) AS BIGINT) AS crit_sum FROM frows WHERE kind = 'hit' GROUP BY 1, 2, 3
), defenses AS (
  SELECT fight_id, target AS name, type, count(*) AS count FROM swings WHERE kind = 'miss' GROUP BY 1, 2, 3
), waterfall AS (
  SELECT d.*, CAST(p.inbound_melee_count + p.inbound_miss_count - p.inbound_strike_count - coalesce(sum(d.count) OVER (PARTITION BY d.fight_id, d.name
    ORDER BY list_position(['miss', 'invul', 'block', 'riposte', 'parry', 'dodge', 'shield', 'unknown', 'rune'], d.type) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS attempts
  FROM defenses d JOIN people p USING (fight_id, name)
), series AS (
  SELECT fight_id, name, metric, tick, CAST(sum(amount) AS BIGINT) AS value FROM (
    SELECT fight_id, source AS name, 'dps' AS metric, CAST(greatest(0, CAST(epoch(ts) AS BIGINT) // 6 - CAST(epoch(started_on) AS BIGINT) // 6) AS BIGINT) AS tick, amount FROM frows WHERE kind = 'hit'
    UNION ALL SELECT fight_id, target, 'tank_dps', CAST(greatest(0, CAST(epoch(ts) AS BIGINT) // 6 - CAST(epoch(started_on) AS BIGINT) // 6) AS BIGINT), amount FROM frows WHERE kind = 'hit' AND spell IS NULL
  ) GROUP BY 1, 2, 3, 4 HAVING sum(amount) <> 0
)"""
)

#: When every opened fight ends; ghosts time out without damage and are never finished.
ENDED = """, ended AS (
  SELECT *, status = 'Killed' AS killed, epoch(updated_on) + CASE WHEN status = 'Killed' THEN 0 WHEN party = 'Raid' THEN 120 ELSE 15 END AS until, status = 'Timeout' AND hp <= 0 AS ghost FROM everyfight
)"""

#: Heals and the fight each counts for: a replay heal by heal, which keeps who joined a fight by healing or being healed.
HEALS = (
    ENDED
    + """, turns AS (
  SELECT log_id, epoch(ts) AS t, seq, fight_id, 1 AS mark FROM assigned WHERE kind IN ('hit', 'miss') AND seq >= start_seq
  UNION ALL SELECT log_id, until, CASE WHEN killed THEN end_seq ELSE -1 END, '', 2 FROM ended WHERE kept
  UNION ALL SELECT log_id, epoch(ts), seq, NULL, 0 FROM combat WHERE kind = 'heal'
  UNION ALL SELECT log_id, epoch(ts), seq, NULL, 0 FROM extra WHERE kind = 'casting'
), lasts AS (
  SELECT log_id, seq, mark, last_value(fight_id IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY t, seq, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_id FROM turns
), inside AS (
  SELECT fight_id, member, min(since) AS since FROM (
    SELECT fight_id, foe, unnest([source, target]) AS member, greatest(seq, start_seq) AS since FROM assigned WHERE kind IN ('hit', 'miss')
    UNION ALL SELECT fight_id, foe, died, seq FROM assigned WHERE kind = 'touch'
    UNION ALL SELECT f.fight_id, f.foe, c.name, c.seq FROM extra c JOIN lasts l ON l.log_id = c.log_id AND l.seq = c.seq AND l.mark = 0 JOIN ended f ON f.fight_id = l.last_id
      WHERE c.kind = 'casting' AND c.seq > f.start_seq AND (f.ghost OR CASE WHEN f.killed THEN c.seq < f.end_seq ELSE epoch(c.ts) < f.until END)
  ) WHERE member <> foe GROUP BY 1, 2
), befriended AS (SELECT log_id, source AS name, min(seq) AS since FROM combat WHERE kind = 'heal' AND source LIKE 'Medic%' AND target LIKE 'Player%' GROUP BY 1, 2
), meeting AS (
  SELECT c.log_id, c.seq, c.source, c.target, g.fight_id, g.foe, g.start_seq, coalesce(l.last_id = g.fight_id, false) AS is_last,
    CASE WHEN g.killed THEN c.seq < g.end_seq ELSE epoch(c.ts) < g.until END AS listed,
    EXISTS (SELECT 1 FROM inside x WHERE x.fight_id = g.fight_id AND x.member IN (c.source, c.target) AND x.since < c.seq) AS named,
    c.source LIKE 'Player%' OR EXISTS (SELECT 1 FROM befriended b WHERE b.log_id = c.log_id AND b.name = c.source AND b.since <= c.seq) AS friend
  FROM combat c JOIN ended g ON g.log_id = c.log_id AND c.seq > g.start_seq JOIN lasts l ON l.log_id = c.log_id AND l.seq = c.seq AND l.mark = 0
  WHERE c.kind = 'heal' AND (listed OR (g.ghost AND is_last))
), asked AS (
  SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY seq) AS n FROM (
    SELECT log_id, seq, source, target, friend, list({'id': fight_id, 'foe': foe, 'at': start_seq, 'is_last': is_last, 'listed': listed, 'named': named}) AS choices
    FROM meeting GROUP BY log_id, seq, source, target, friend)
), walk AS (
  SELECT DISTINCT log_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS fight_id, CAST(NULL AS VARCHAR) AS fight_foe, CAST([] AS VARCHAR[]) AS joined FROM asked
  UNION ALL
  SELECT log_id, n, seq, best.id, best.foe, CASE WHEN best IS NULL OR target = best.foe THEN joined ELSE list_distinct(list_concat(joined, [best.id || '|' || source, best.id || '|' || target])) END FROM (
    SELECT h.log_id, h.n, h.seq, h.source, h.target, w.joined, list_sort(list_filter(list_transform(h.choices, lambda c: {
      'tier': CASE WHEN (c.named OR list_contains(w.joined, c.id || '|' || h.source) OR list_contains(w.joined, c.id || '|' || h.target)) THEN CASE WHEN c.is_last THEN 1 ELSE 2 END WHEN h.friend AND c.listed THEN 3 END,
      'o': CASE WHEN c.named OR list_contains(w.joined, c.id || '|' || h.source) OR list_contains(w.joined, c.id || '|' || h.target) THEN c.at ELSE -c.at END,
      'id': c.id, 'foe': c.foe}), lambda x: x.tier IS NOT NULL))[1] AS best
    FROM walk w JOIN asked h ON h.log_id = w.log_id AND h.n = w.n + 1
  )
), healed AS (
  SELECT c.*, w.fight_id, w.fight_foe, f.started_on FROM walk w JOIN combat c ON c.log_id = w.log_id AND c.seq = w.seq JOIN fights f ON f.fight_id = w.fight_id WHERE c.target <> w.fight_foe
)"""
)

#: Other fights that are open when one ends.
COHORTS = (
    ENDED
    + """ SELECT f.fight_id, count(g.fight_id) AS cohort_count FROM ended f LEFT JOIN ended g ON g.log_id = f.log_id AND g.fight_id <> f.fight_id AND
  CASE WHEN f.killed THEN g.start_seq < f.end_seq AND CASE WHEN g.killed THEN g.end_seq > f.end_seq ELSE g.until > f.until END ELSE epoch(g.started_on) < f.until AND g.until >= f.until END
WHERE f.kept GROUP BY 1"""
)
