"""A log of duels made of the ``events`` table, in which nobody is known at the start.

Who is friend or foe, whose pet, and of which class has to be told by fights between any
two of ten names, spells, healing, landing texts, tells and deaths: conflicts of friends
and of foes, pets that change sides, names that die and begin anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions.text import CLASSES
from skirmish.operators import entities
from skirmish.operators.lines import split_lines
from skirmish.operators.rules import extract_events
from skirmish.sources import spells
from skirmish.sources.store import spread, stored_once

OWNER = "Ann"
NAMES = ("Ann", "Bob", "Cid", "Dot", "Eve", "Rat", "Bat", "Cat", "Gobaner", "Bob`s pet")
EVENTS_A_LOG = 200
#: Rows of a log that one task folds here: less than a log has.
CHUNK_ROWS = 64


def spell_table(spark: SparkSession) -> DataFrame:
    """Six spells as rows of the game's table; two share a name, one is for pets and has a landing text of its own."""
    codes = list(CLASSES.values())
    given = ((1, "Flame Rk. II", "WIZ", 5), (2, "Frost", "DRU", 5), (3, "Gust", "WIZ,DRU", 5), (4, "Bond", "MAG,BST", 14), (5, "Sleet", "CLR", 5), (6, "Sleet", "CLR", 5))
    rows = []
    for number, name, able, target in given:
        fields = ["255"] * spells.FIELDS
        fields[0], fields[1], fields[11], fields[12], fields[30] = str(number), name, "0", "0", str(target)
        for code in able.split(","):
            fields[36 + codes.index(code)] = "10"
        rows.append((fields,))
    texts = spark.createDataFrame([(1, None, " burns.", None), (4, None, " looks bonded.", None), (5, None, " burns.", None)], "id int, land_self string, land_others string, wears_off string")
    return spells.spells_from_fields(spark.createDataFrame(rows, "f array<string>"), texts)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, seq, owner, server, line)."""
    i, u, v, kind = F.col("event_id"), F.col("user_id"), F.col("value"), F.col("event_type")
    names = F.array(*map(F.lit, NAMES))

    def pick(of: Column, n: Column) -> Column:
        return F.get(of, n.cast("int"))

    def text(*said: Column | str) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in said])

    first = (u + i) % 10
    a, b, person = pick(names, first), pick(names, (first + 1 + (u * 3 + F.floor(i / 7)) % 9) % 10), pick(names, u % 5)
    amount = (F.floor(v) + 1).cast("long")
    cast = pick(F.array(*map(F.lit, ("Flame Rk. II", "Frost", "Gust", "Bond", "Sleet"))), i % 5)
    aimed = pick(F.array(*map(F.lit, ("Flame Rk. II", "Bond", "Gust"))), i % 3)
    said = (
        F.when(kind == "click", text(a, F.when(i % 6 == 0, " backstabs ").when(i % 6 == 1, " frenzies on ").otherwise(" slashes "), b, " for ", amount, " points of damage."))
        .when(kind == "view", text(a, " tries to slash ", b, ", but misses!"))
        .when((kind == "error") & (i % 4 == 0), text(a, " hit ", b, " for ", amount, " points of fire damage by ", aimed, "."))
        .when((kind == "error") & (i % 4 == 1), text(a, " begins casting ", cast, "."))
        .when((kind == "error") & (i % 4 == 2), text(a, " begins singing Hymn."))
        .when(kind == "error", text(a, " activates Rage."))
        .when(kind == "signup", text(a, " healed ", b, " for ", amount, " hit points by ", F.when(i % 3 == 0, "Bond").otherwise("Mend"), "."))
        .when(v > 50, text(b, " has been slain by ", a, "!"))
        .when(i % 5 == 0, text("[60 Warrior] ", person, " (Human) ZONE: here"))
        .when(i % 10 == 1, text("Gobaner tells you, 'My leader is ", person, ".'"))
        .when(i % 5 == 1, text("Gobaner tells you, 'Following you, Master.'"))
        .when(i % 5 == 2, text(a, " has captured ", b, "'s attention!"))
        .when(i % 5 == 3, text(b, " scowls at you, ready to attack -- it looks easy. (Lvl: 30)"))
        .otherwise(text(b, " looks bonded."))
    )
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + 2 * i), "EEE MMM dd HH:mm:ss yyyy")
    log = F.concat(F.lit("eqlog_Ann_"), F.floor(i / EVENTS_A_LOG).cast("string"))
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet")).select(log.alias("log_id"), i.alias("seq"), F.lit(OWNER).alias("owner"), F.lit("test").alias("server"), F.concat(F.lit("["), stamp, F.lit("] "), said).alias("line"))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over who is what, with spells; logs are folded in several chunks each. Stored once a session."""

    def make() -> DataFrame:
        events = extract_events(split_lines(lines(spark, sf_dir)))
        return entities.fold_entities(events, spell_table(spark), CHUNK_ROWS)

    return stored_once(spark.read.parquet(f"{sf_dir}/events.parquet"), "duel", make)


_REPLAY = """
WITH RECURSIVE raw AS (
  SELECT event_id AS i, 'eqlog_Ann_' || (event_id // 200) AS log_id, event_id % 200 AS j, 2 * event_id AS t, event_type AS et, value AS v, user_id % 5 AS person, (user_id + event_id) % 10 AS a,
    ((user_id + event_id) % 10 + 1 + (user_id * 3 + event_id // 7) % 9) % 10 AS b FROM events
), acts AS (
  SELECT *, CASE et WHEN 'click' THEN CASE i % 6 WHEN 0 THEN 'backstab' WHEN 1 THEN 'frenzy' ELSE 'slash' END WHEN 'view' THEN 'miss' WHEN 'error' THEN ['dd', 'cast', 'song', 'disc'][i % 4 + 1] WHEN 'signup' THEN 'heal'
    ELSE CASE WHEN v > 50 THEN 'death' ELSE ['who', 'leader', 'taunt', 'consider', 'bonded'][i % 5 + 1] END END AS act,
    CASE et WHEN 'error' THEN CASE i % 4 WHEN 0 THEN ['Flame Rk. II', 'Bond', 'Gust'][i % 3 + 1] WHEN 1 THEN ['Flame Rk. II', 'Frost', 'Gust', 'Bond', 'Sleet'][i % 5 + 1] END WHEN 'signup' THEN CASE WHEN i % 3 = 0 THEN 'Bond' ELSE 'Mend' END END AS spell,
    ['Ann', 'Bob', 'Cid', 'Dot', 'Eve', 'Rat', 'Bat', 'Cat', 'Gobaner', 'Bob`s pet'] AS names
  FROM raw
), landed AS (  -- a line takes the first cast of the five seconds before, a cast its first line
  SELECT l.i, c.i AS cast_i, l.b, c.names[c.a + 1] AS owner FROM acts l JOIN acts c ON c.log_id = l.log_id AND c.i < l.i AND l.t - c.t <= 5 AND c.act = 'cast' AND c.spell = 'Bond'
  WHERE l.act = 'bonded' QUALIFY row_number() OVER (PARTITION BY l.i ORDER BY c.i) = 1
), emotes AS (SELECT * FROM landed QUALIFY row_number() OVER (PARTITION BY cast_i ORDER BY i) = 1
), told AS (
  SELECT x.*,
    CASE WHEN act IN ('backstab', 'frenzy', 'slash', 'miss', 'dd') THEN 'swing' WHEN act IN ('heal', 'death') THEN act END AS step,
    -- what the line tells of a first name, and of a second
    CASE WHEN act IN ('backstab', 'frenzy', 'dd', 'cast', 'song', 'disc') OR (act = 'taunt' AND a <> 9) THEN a WHEN act = 'who' THEN person WHEN act = 'leader' THEN 8 WHEN act = 'consider' THEN x.b WHEN e.i IS NOT NULL THEN e.b END AS n1,
    CASE WHEN act IN ('who', 'disc', 'taunt', 'leader') THEN 'Friend' WHEN act = 'consider' THEN 'Foe' END AS type1,
    act IN ('who', 'disc') AS player1, act = 'who' AS clears1, act = 'leader' AS leads,
    CASE WHEN act = 'leader' THEN CASE WHEN x.i % 10 = 1 THEN names[person + 1] ELSE 'Ann' END ELSE e.owner END AS owner1,
    CASE act WHEN 'backstab' THEN 'ROG' WHEN 'frenzy' THEN 'BER' WHEN 'song' THEN 'BRD' WHEN 'who' THEN 'WAR' ELSE CASE WHEN spell = 'Flame Rk. II' AND act IN ('dd', 'cast') THEN 'WIZ' END END AS cls1,
    CASE act WHEN 'who' THEN 60 WHEN 'consider' THEN 30 END AS level1,
    CASE WHEN (act = 'taunt' AND a <> 9) OR (act IN ('dd', 'heal') AND spell = 'Bond') THEN x.b END AS n2,
    CASE WHEN act = 'taunt' THEN 'Foe' END AS type2, CASE WHEN act IN ('dd', 'heal') AND spell = 'Bond' THEN names[a + 1] END AS owner2
  FROM acts x LEFT JOIN emotes e USING (i)
), numbered AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY i) AS n FROM told
), walk AS (
  SELECT log_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS foe,
    list_transform(range(10), lambda k: {'t': CASE WHEN k = 0 THEN 'Friend' ELSE 'Unknown' END, 'p': k = 0, 'o': CASE WHEN k = 9 THEN 'Bob' END, 'c': CAST(NULL AS VARCHAR), 'l': CAST(NULL AS INTEGER), 'g': CAST(0 AS BIGINT), 'k': k = 0}) AS s
  FROM (SELECT DISTINCT log_id FROM told)
  UNION ALL
  SELECT log_id, n, i, CASE foe WHEN 1 THEN names[a + 1] WHEN 2 THEN names[b + 1] END,
    list_transform(s, lambda x, k: CASE
      WHEN step = 'swing' AND k = a + 1 THEN {'t': CASE foe WHEN 1 THEN 'Foe' WHEN 2 THEN 'Friend' ELSE x.t END, 'p': x.p, 'o': x.o, 'c': x.c, 'l': x.l, 'g': own_g, 'k': true}
      WHEN step = 'swing' AND k = b + 1 AND foe > 0 THEN {'t': CASE foe WHEN 2 THEN 'Foe' ELSE 'Friend' END, 'p': x.p, 'o': x.o, 'c': x.c, 'l': x.l, 'g': x.g, 'k': true}
      WHEN step = 'heal' AND k = a + 1 AND s[b + 1].p THEN {'t': 'Friend', 'p': x.p, 'o': x.o, 'c': x.c, 'l': x.l, 'g': x.g, 'k': true}
      WHEN step = 'death' AND k = b + 1 THEN {'t': CASE WHEN x.p THEN x.t ELSE 'Unknown' END, 'p': x.p, 'o': x.o, 'c': x.c, 'l': x.l, 'g': CAST(0 AS BIGINT), 'k': x.k OR NOT x.p}
      ELSE x END)
  FROM (
    SELECT *, CASE
      WHEN step IS DISTINCT FROM 'swing' OR s[a + 1].o IS NOT DISTINCT FROM names[b + 1] OR s[b + 1].o IS NOT DISTINCT FROM names[a + 1] OR (s[a + 1].p AND s[b + 1].p) THEN 0
      WHEN s[a + 1].t = s[b + 1].t AND s[a + 1].t <> 'Unknown' THEN CASE WHEN (s[b + 1].p AND NOT s[a + 1].p) OR own_g > s[b + 1].g THEN 1 WHEN (s[a + 1].p AND NOT s[b + 1].p) OR own_g < s[b + 1].g THEN 2 ELSE 0 END
      WHEN s[a + 1].t = 'Friend' OR s[b + 1].t = 'Foe' THEN 2 WHEN s[a + 1].t = 'Foe' OR s[b + 1].t = 'Friend' THEN 1
      WHEN (a = 8) = (b = 8) THEN 0 WHEN a = 8 THEN 2 ELSE 1 END AS foe
    FROM (
      SELECT *, CASE WHEN s[b + 1].p THEN 1704067200 + t ELSE s[a + 1].g END AS own_g FROM (
        SELECT e.*, list_transform(w.s, lambda x, k: CASE
          WHEN k = e.n1 + 1 THEN {'t': coalesce(e.type1, x.t), 'p': x.p OR e.player1, 'o': CASE WHEN e.clears1 THEN NULL WHEN e.owner1 IS NOT NULL AND NOT x.p AND (e.leads OR x.o IS NULL) THEN e.owner1 ELSE x.o END,
            'c': coalesce(e.cls1, x.c), 'l': coalesce(e.level1, x.l), 'g': x.g, 'k': true}
          WHEN k = e.n2 + 1 THEN {'t': coalesce(e.type2, x.t), 'p': x.p, 'o': CASE WHEN e.owner2 IS NOT NULL AND NOT x.p AND x.o IS NULL THEN e.owner2 ELSE x.o END, 'c': x.c, 'l': x.l, 'g': x.g, 'k': true}
          ELSE x END) AS s
        FROM walk w JOIN numbered e ON e.log_id = w.log_id AND e.n = w.n + 1
      )
    )
  )
)"""

FOES = _REPLAY + " SELECT log_id, seq, foe FROM walk WHERE foe IS NOT NULL"

#: A class that nothing tells is that of most casts, the first of those that tie.
ENTITIES = _REPLAY + """, ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY n DESC) = 1
), people AS (SELECT log_id, k, ['Ann', 'Bob', 'Cid', 'Dot', 'Eve', 'Rat', 'Bat', 'Cat', 'Gobaner', 'Bob`s pet'][k] AS name, s[k] AS x FROM ends, range(1, 11) AS r(k)
), hints AS (SELECT log_id, a + 1 AS k, CASE spell WHEN 'Flame Rk. II' THEN 'WIZ' WHEN 'Frost' THEN 'DRU' WHEN 'Sleet' THEN 'CLR' END AS hint, count(*) AS c, min(i) AS first_i FROM acts WHERE act = 'cast' AND spell IN ('Flame Rk. II', 'Frost', 'Sleet') GROUP BY 1, 2, 3
), hinted AS (SELECT log_id, k, hint FROM hints QUALIFY row_number() OVER (PARTITION BY log_id, k ORDER BY c DESC, first_i) = 1)
SELECT p.log_id, p.name, CASE WHEN p.x.t = 'Unknown' AND o.x.k THEN o.x.t ELSE p.x.t END AS type, p.x.p AS is_player, p.x.o AS owner, coalesce(p.x.c, h.hint) AS class, p.x.l AS level
FROM people p LEFT JOIN people o ON o.log_id = p.log_id AND o.name = p.x.o LEFT JOIN hinted h ON h.log_id = p.log_id AND h.k = p.k WHERE p.x.k"""
