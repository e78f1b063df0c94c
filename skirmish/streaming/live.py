"""Live logs: chunks of lines to finished fights and drops, with Structured Streaming.

Extraction is the batch's own projection. Fights are a stateful operator: per log
and foe, one open fight as state, an event-time timer as its idle timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skirmish.operators.fights import GROUP_GAP, RAID_GAP
from skirmish.operators.lines import split_lines
from skirmish.operators.rules import extract_events
from skirmish.sources.sinks import write_once

WATERMARK = "2 minutes"
_FIGHT = "log_id string, foe string, started_on timestamp, updated_on timestamp, status string, hp long, hits long"
_STATE = "started double, updated double, hp long, hits long, gap long"


def live_events(lines: DataFrame, log_tz: str = "UTC") -> DataFrame:
    return extract_events(split_lines(lines, log_tz))


def stream_fights(combat: DataFrame, group_gap: int = GROUP_GAP, raid_gap: int = RAID_GAP, watermark: str = WATERMARK, opened: bool = False) -> DataFrame:
    """Finished fights from a stream of combat rows (log_id, seq, ts, kind, target, foe, name, amount, party).

    A fight closes when its foe dies, or when a row comes a gap later, or when the
    watermark passes its last row by the gap. With ``opened`` there is a row of status
    Open too when a fight begins. Rows later than the watermark are dropped, and
    counted by :func:`late_rows`.
    """

    def close(key: tuple, s: list, status: str) -> tuple:
        return (*key, pd.Timestamp(s[0], unit="s"), pd.Timestamp(s[1], unit="s"), status, s[2], s[3])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            if now and now[2] > 0:
                out.append(close(key, now, "Timeout"))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
            for r in rows.itertuples():
                at = r.ts.timestamp()
                if now and at - now[1] >= now[4]:
                    if now[2] > 0:
                        out.append(close(key, now, "Timeout"))
                    now = None
                if r.kind == "death":
                    if now:
                        now[1] = at
                        out.append(close(key, now, "Killed"))
                        now = None
                    continue
                if now is None:
                    now = [at, at, 0, 0, group_gap]
                    if opened:
                        out.append(close(key, now, "Open"))
                now[1], now[4] = max(at, now[1]), raid_gap if r.party == "Raid" else group_gap
                if r.kind == "hit" and r.target == key[1]:
                    now[2] += int(r.amount)
                    now[3] += 1
            if now:
                state.update(tuple(now))
                state.setTimeoutTimestamp(max(int((now[1] + now[4]) * 1000), state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["log_id", "foe", "started_on", "updated_on", "status", "hp", "hits"])

    party = F.col("party") if "party" in combat.columns else F.lit(None).cast("string")
    narrow = combat.where(F.col("kind").isin("hit", "miss", "death") & F.col("foe").isNotNull()).select("log_id", "foe", "ts", "kind", "target", F.coalesce("amount", F.lit(0)).alias("amount"), party.alias("party"), "seq")
    return narrow.withWatermark("ts", watermark).groupBy("log_id", "foe").applyInPandasWithState(step, _FIGHT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


_DROP = "log_id string, ts timestamp, server string, zone string, mob string, item string"


def stream_drops(events: DataFrame, ignore: DataFrame | None = None, watermark: str = WATERMARK) -> DataFrame:
    """What was looted or left, with the zone that the log was in: state a log is its last zone. ``ignore`` lists items."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        zone = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable").itertuples():
            if r.kind == "zone":
                zone = r.name
            elif zone is not None and isinstance(r.source, str):
                out.append((*key, r.ts, r.server, zone, r.source, r.item))
        if zone is not None:
            state.update((zone,))
        yield pd.DataFrame(out, columns=["log_id", "ts", "server", "zone", "mob", "item"])

    rows = events.where(F.col("kind").isin("zone", "loot", "rot")).select("log_id", "seq", "ts", "kind", "name", "source", "item", "server")
    found = rows.withWatermark("ts", watermark).groupBy("log_id").applyInPandasWithState(step, _DROP, "zone string", "append", GroupStateTimeout.NoTimeout)
    return found if ignore is None else found.join(ignore.select("item").distinct(), "item", "left_anti").select("log_id", "ts", "server", "zone", "mob", "item")


def append_json(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends each batch of rows, as drops are, as JSON; the sink's log keeps a batch from being written twice."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def late_rows(query) -> int:
    """Rows that a query has dropped so far because they came later than its watermark."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])


def quick_sessions(combat: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """A quick view: sessions by idle gap only. Session windows merge at a gap equal to their length, so it is a second less."""
    gap = F.when(F.col("party") == "Raid", F.lit(f"{RAID_GAP - 1} seconds")).otherwise(F.lit(f"{GROUP_GAP - 1} seconds"))
    live = combat.where(F.col("kind").isin("hit", "miss"))
    live = live.withWatermark("ts", watermark) if combat.isStreaming else live
    found = live.groupBy("log_id", "foe", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("kind") == "hit", F.col("amount"))).alias("damage"))
    return found.select("log_id", "foe", F.col("w.start").alias("started_on"), "n", F.coalesce("damage", F.lit(0)).alias("damage"))


def tumbling_damage(combat: DataFrame, watermark: str = WATERMARK, width: str = "6 seconds") -> DataFrame:
    """Damage by name in six-second windows of the clock."""
    hits = combat.where(F.col("kind") == "hit")
    hits = hits.withWatermark("ts", watermark) if combat.isStreaming else hits
    found = hits.groupBy("log_id", F.col("source").alias("name"), F.window("ts", width).alias("w")).agg(F.sum("amount").alias("damage"))
    return found.select("log_id", "name", F.col("w.start").alias("window_start"), "damage")


def publish(stream: DataFrame, path: str, checkpoint: str, key: list[str] | None = None):
    """A query that writes each finished fight once, also after a restart: rows are keyed by log, foe and start."""
    keys = key or ["log_id", "foe", "started_on"]

    def save(batch: DataFrame, _: int) -> None:
        held = batch.withColumn("publish_id", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256)).persist()  # read twice
        try:
            write_once(held, path, "publish_id")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
