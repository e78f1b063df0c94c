"""Live fights with their heals and casts, and drops in batches: state a log, with event-time timers.

Rows of a log are held by second until the watermark passes it, and then taken in order,
so what comes out does not depend on the order in which chunks arrived within the
watermark. A fight is a map state by foe, and leaves it when it ends; drops wait in a list
state until there are ten or a while has passed. State lives in RocksDB
(:func:`use_state_store`), so it may be larger than memory, and in the checkpoint, so a
restarted query neither loses nor repeats a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skirmish.operators.fights import GROUP_GAP, RAID_GAP

WATERMARK = "2 minutes"
BATCH = 10
WAIT = 600
_FIGHT = "log_id string, foe string, started_on timestamp, updated_on timestamp, status string, hp long, hits long, heals long, healed long, members long"
_OPEN = "seq long, started long, updated long, hp long, hits long, gap long, heals long, healed long, members string"
_NAMES = [c.split()[0] for c in _OPEN.split(", ")]
_DROPS = "log_id string, batch long, place int, ts timestamp, server string, zone string, mob string, item string"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Fights(StatefulProcessor):
    """One log: the rows of seconds that may still get more, the open fights, and the foe last hit."""

    def __init__(self, group_gap: int, raid_gap: int):
        self.gaps = (group_gap, raid_gap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "second long", "rows string")
        self.open = handle.getMapState("open", "foe string", _OPEN)
        self.last = handle.getValueState("last", "foe string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held: dict[int, list] = {}
        for batch in rows:
            for r in batch.drop(columns=["log_id", "ts"]).to_dict("records"):
                r = {k: None if v is None or v != v else v for k, v in r.items()}
                held.setdefault(int(r["t"]), []).append(r)
        for second, more in held.items():
            had = json.loads(self.waiting.getValue((second,))[0]) if self.waiting.containsKey((second,)) else []
            self.waiting.updateValue((second,), (json.dumps(had + more),))
            self.handle.registerTimer(second * 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = expiredTimerInfo.getExpiryTimeInMs() // 1000
        live = {k[0]: dict(zip(_NAMES, v, strict=True)) for k, v in self.open.iterator()}
        for fight in live.values():
            fight["members"] = set(json.loads(fight["members"]))
        before, last = set(live), self.last.get()[0] if self.last.exists() else None
        out: list[tuple] = []

        def finish(foe: str, status: str) -> None:
            nonlocal last
            f = live.pop(foe)
            if f["members"] and (status == "Killed" or f["hp"] > 0):
                last = None
                out.append((*key, foe, *(pd.Timestamp(f[c], unit="s") for c in ("started", "updated")), status, f["hp"], f["hits"], f["heals"], f["healed"], len(f["members"])))
            elif foe == last:
                last = None

        for second in sorted(k[0] for k in self.waiting.keys() if k[0] <= upto):
            for r in sorted(json.loads(self.waiting.getValue((second,))[0]), key=lambda r: r["seq"]):
                for foe in [x for x, f in live.items() if f["updated"] + f["gap"] <= second]:
                    finish(foe, "Timeout")
                last = self.take(r, second, live, last, finish)
            self.waiting.removeKey((second,))
        for foe in [x for x, f in live.items() if f["updated"] + f["gap"] <= upto]:
            finish(foe, "Timeout")
        for foe in before - set(live):
            self.open.removeKey((foe,))
        for foe, f in live.items():
            self.open.updateValue((foe,), tuple(json.dumps(sorted(f[c])) if c == "members" else f[c] for c in _NAMES))
            self.handle.registerTimer((f["updated"] + f["gap"]) * 1000)
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _FIGHT.split(", ")])

    def take(self, r: dict, second: int, live: dict, last: str | None, finish) -> str | None:
        kind, foe = r["kind"], r["foe"]
        if kind in ("hit", "miss") and foe and r["source"]:
            f = live.setdefault(foe, {"seq": r["seq"], "started": second, "updated": second, "hp": 0, "hits": 0, "gap": 0, "heals": 0, "healed": 0, "members": set()})
            f["updated"], f["gap"] = second, self.gaps[r["party"] == "Raid"]
            f["members"] |= {r["source"], r["target"]} - {foe}
            if kind == "hit" and r["target"] == foe:
                f["hp"] += int(r["amount"])
                f["hits"] += 1
            return foe
        if kind == "death":
            if r["name"] in live:
                live[r["name"]]["updated"] = second
                finish(r["name"], "Killed")
                return None
            if r["killshot"] in live:
                live[r["killshot"]]["updated"] = second
                live[r["killshot"]]["members"].add(r["name"])
        elif kind == "casting" and last in live and r["friend"] and r["source"] != last:
            live[last]["members"].add(r["source"])
        elif kind == "heal":
            names = {r["source"], r["target"]} - {None}
            first = [last] if last in live and live[last]["members"] & names else []
            named = first or [x for x, f in sorted(live.items(), key=lambda x: x[1]["seq"]) if f["members"] & names]
            newest = [max(live, key=lambda x: live[x]["seq"])] if live and r["friend"] else []
            for at in (named or newest)[:1]:
                if r["target"] != at:
                    live[at]["heals"] += 1
                    live[at]["healed"] += int(r["amount"])
                    live[at]["members"] |= names - {at}
        return last

    def close(self) -> None:
        pass


def live_fights(rows: DataFrame, group_gap: int = GROUP_GAP, raid_gap: int = RAID_GAP, watermark: str = WATERMARK) -> DataFrame:
    """Fights as they finish, with the heals that count for them and their members.

    ``rows`` have (log_id, seq, ts, kind, source, target, foe, name, killshot, amount), and
    if they know them, party and friend: whether the source is one at that row.
    """
    for c, kind in (("party", "string"), ("friend", "boolean")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    wanted = rows.where(F.col("kind").isin("hit", "miss", "death", "heal", "casting")).withWatermark("ts", watermark)
    narrow = wanted.select("log_id", "ts", F.unix_timestamp("ts").alias("t"), "seq", "kind", "source", "target", "foe", "name", "killshot", F.coalesce("amount", F.lit(0)).cast("long").alias("amount"), "party", F.coalesce("friend", F.lit(False)).alias("friend"))
    return narrow.groupBy("log_id").transformWithStateInPandas(_Fights(group_gap, raid_gap), _FIGHT, "append", "EventTime")


class _Batches(StatefulProcessor):
    """Drops of one log that wait, and the number of the next batch."""

    def __init__(self, size: int, wait: int):
        self.size, self.wait = size, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long, server string, zone string, mob string, item string")
        self.batch = handle.getValueState("batch", "n long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = sorted(tuple(None if v is None or v != v else v for v in (r.t, r.server, r.zone, r.mob, r.item)) for b in rows for r in b.itertuples())
        held = [*self.held.get(), *new]
        if len(held) >= self.size:
            yield self.flush(key, held)
        elif new:
            n, due = self.batch.get() if self.batch.exists() else (0, 0)
            if not due:
                due = held[0][0] + self.wait
                self.handle.registerTimer(due * 1000)
            self.held.put(held)
            self.batch.update((n, due))
            yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, due = list(self.held.get()), self.batch.get()[1] if self.batch.exists() else 0
        if held and due and due * 1000 <= expiredTimerInfo.getExpiryTimeInMs():  # else a batch has gone since
            yield self.flush(key, held)

    def flush(self, key: tuple, held: list[tuple]) -> pd.DataFrame:
        n = self.batch.get()[0] if self.batch.exists() else 0
        self.held.clear()
        self.batch.update((n + 1, 0))
        return pd.DataFrame([(*key, n, i, pd.Timestamp(t, unit="s"), *rest) for i, (t, *rest) in enumerate(held)], columns=[c.split()[0] for c in _DROPS.split(", ")])

    def close(self) -> None:
        pass


def drop_batches(drops: DataFrame, size: int = BATCH, wait: int = WAIT, watermark: str | None = None) -> DataFrame:
    """Drops (log_id, ts, server, zone, mob, item) in numbered batches: ``size`` and more at once, or fewer when the first has waited for ``wait`` seconds."""
    timed = drops if watermark is None else drops.withWatermark("ts", watermark)
    rows = timed.select("log_id", "ts", F.unix_timestamp("ts").alias("t"), "server", "zone", "mob", "item")
    return rows.groupBy("log_id").transformWithStateInPandas(_Batches(size, wait), _DROPS, "append", "EventTime")
