"""Stateful streams: the same fights as the batch's from shuffled chunks, and drops in batches over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from skirmish.operators import attribution, fights
from skirmish.streaming import stateful

ROWS = "log_id string, seq long, ts timestamp, kind string, source string, target string, foe string, name string, killshot string, amount long, friend boolean"


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    stateful.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _events(seed, n):
    r, out, t = random.Random(seed), [], 1_700_000_000
    for i in range(n):
        t += r.choice([0, 1, 1, 2, 4, 25])
        who, foe = r.choice("ABC"), r.choice(["Mob", "Rat", "Bat"])
        kind = r.choice(["hit", "hit", "hit", "miss", "heal", "heal", "casting", "death"])
        row = {"log_id": f"log{i % 2}", "seq": i, "ts": t, "kind": kind, "friend": False}
        if kind in ("hit", "miss"):
            row |= {"source": who, "target": foe, "foe": foe, "amount": 10 + i}
        elif kind == "heal":
            row |= {"source": r.choice("ABCHJ"), "target": r.choice(["A", "B", "H", "X", "Y"]), "amount": i}
            row["friend"] = row["source"] in "AJ"
        elif kind == "casting":
            row |= {"source": r.choice("CJ"), "friend": True}
        else:
            name, by = r.choice([(foe, who), (foe, who), (who, foe)])
            row |= {"name": name, "killshot": by, "foe": name}
        out.append(row)
    return out


def _frame(spark, rows):
    names = [c.split()[0] for c in ROWS.split(", ")]
    return spark.createDataFrame([tuple(x.get(c) for c in names) for x in rows], ROWS.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))


def _run(stream, out, state):
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def test_live_fights_equal_the_batch(spark, tmp_path):
    rows = _events(3, 240)
    end = {"log_id": "log0", "seq": 10**6, "ts": rows[-1]["ts"] + 1000, "kind": "miss", "source": "A", "target": "Z", "foe": "Z", "amount": 0, "friend": False}
    # chunks of 60 rows arrive in three files each, in any order
    r = random.Random(9)
    for k in range(0, len(rows), 60):
        part = rows[k : k + 60]
        r.shuffle(part)
        _frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for second in (0, 1):  # two rows far later let the watermark pass all
        _frame(spark, [end | {"seq": 10**6 + second, "ts": end["ts"] + second, "log_id": f"log{second}"}]).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        _run(stateful.live_fights(stream, watermark="10 minutes"), tmp_path / "out", tmp_path / "state")
    _frame(spark, [end | {"seq": 10**6 + 9, "ts": end["ts"] + 5000}]).write.mode("append").parquet(str(tmp_path / "in"))
    _run(stateful.live_fights(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), watermark="10 minutes"), tmp_path / "out", tmp_path / "state")
    got = {(x["log_id"], x["foe"], x["started_on"].timestamp(), x["updated_on"].timestamp(), x["status"], x["hp"], x["heals"], x["healed"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}

    df = _frame(spark, rows)
    assigned = fights.assign_fights(fights.with_killshots(df.where("kind in ('hit', 'miss', 'death')")))
    table = fights.fight_table(assigned)
    friends = df.where("friend").select("log_id", "seq", F.col("source").alias("name"))
    casts = attribution.attribute_casts(df.where("kind = 'casting'"), assigned, table, friends)
    healed = attribution.attribute_heals(df.where("kind = 'heal'").drop("foe"), assigned, table, friends, joined_by=casts)
    sums = {x["fight_id"]: (x["n"], x["s"]) for x in healed.groupBy("fight_id").agg(F.count("*").alias("n"), F.sum("amount").alias("s")).collect()}
    want = {(x["log_id"], x["foe"], x["started_on"].timestamp(), x["updated_on"].timestamp(), x["status"], x["hp"], *sums.get(x["fight_id"], (0, 0))) for x in table.collect()}
    assert got == want and sum(x[6] for x in want) > 10


def test_drop_batches(spark, tmp_path):
    schema = "log_id string, ts timestamp, server string, zone string, mob string, item string"

    def add(log, start, n, first):
        spark.createDataFrame([(log, start + i, "test", "Zone", "Mob", f"i{first + i}") for i in range(n)], schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        _run(stateful.drop_batches(stream, watermark="0 seconds"), tmp_path / "out", tmp_path / "state")
        return sorted((r["log_id"], r["batch"], r["place"], r["item"]) for r in spark.read.schema(stateful._DROPS).parquet(str(tmp_path / "out")).collect())

    t = 1_700_000_000
    assert add("a", t, 4, 0) == []
    assert [x[3] for x in add("a", t + 10, 7, 4)] == sorted((f"i{k}" for k in range(11)), key=lambda x: int(x[1:]))
    assert len(add("a", t + 20, 3, 11)) == 11
    # another log's drops move the watermark on: after ten minutes the three go, in a batch of their own
    found = add("b", t + 2000, 1, 50)
    found = add("b", t + 2001, 1, 51)
    assert [x for x in found if x[1] == 1] == [("a", 1, k, f"i{11 + k}") for k in range(3)]
    assert len(found) == 14
