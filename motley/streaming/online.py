"""Structured Streaming: windowed counts, diverse sets kept online, biased reservoirs."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than ``late`` are dropped by the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "12 hours") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def first_seen(texts: DataFrame, late: str = "1 day") -> DataFrame:
    """Exact duplicates of a text dropped within the watermark."""
    return texts.withColumn("_key", F.sha2(F.lower(F.trim("text")), 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def bigrams(text: str) -> frozenset:
    w = text.lower().split()
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)])


def distance(a: str, b: str) -> float:
    """0.6 bigram Jaccard distance + 0.15 length difference + 0.25 vocabulary distance."""

    def apart(x, y):
        return 1 - len(x & y) / len(x | y) if x or y else 0.0

    n, m = len(a.split()), len(b.split())
    return 0.6 * apart(bigrams(a), bigrams(b)) + 0.15 * abs(n - m) / max(n, m, 1) + 0.25 * apart(set(a.lower().split()), set(b.lower().split()))


class DiverseSet:
    """At most k texts.  While it is not full every text that is not blank is taken; then a text at least ``threshold``
    from all others may replace the oldest, or the one with the nearest neighbour ("weakest"), or nothing ("none")."""

    def __init__(self, k: int, threshold: float = 0.3, replace: str = "weakest", held: list[str] | None = None, seen: int = 0):
        self.k, self.threshold, self.replace, self.held, self.seen = k, threshold, replace, held or [], seen

    def offer(self, text: str | None) -> tuple[bool, float]:
        self.seen += 1
        if text is None or not text.strip():
            return False, 0.0
        near = min((distance(text, t) for t in self.held), default=1.0)
        if len(self.held) < self.k:
            self.held.append(text)
            return True, near
        if near < self.threshold or self.replace == "none":
            return False, near
        out = 0
        if self.replace == "weakest":
            alone = [min(distance(a, b) for j, b in enumerate(self.held) if j != i) if len(self.held) > 1 else 1.0 for i, a in enumerate(self.held)]
            out = int(np.argmin(alone))
            if near <= alone[out]:
                return False, near
        del self.held[out]
        self.held.append(text)
        return True, near


def diverse_set(texts: DataFrame, k: int = 20, threshold: float = 0.3, replace: str = "weakest") -> DataFrame:
    """A stream (g, ts, id, text) to (g, id, accepted, distance); each group's set is its state, in order of (ts, id) inside a batch."""

    def update(key, batches, state: GroupState):
        kept = json.loads(state.get[0]) if state.exists else {"held": [], "seen": 0}
        keeper = DiverseSet(k, threshold, replace, kept["held"], kept["seen"])
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        found = [(key[0], i, *keeper.offer(t)) for i, t in zip(rows["id"], rows["text"])]
        state.update((json.dumps({"held": keeper.held, "seen": keeper.seen}),))
        yield pd.DataFrame(found, columns=["g", "id", "accepted", "distance"])

    return texts.groupBy("g").applyInPandasWithState(update, "g string, id long, accepted boolean, distance double", "state string", "append", GroupStateTimeout.NoTimeout)


def reservoir(texts: DataFrame, k: int, bias: float = 0.5) -> DataFrame:
    """A reservoir of k texts per group: item n replaces a random one with chance (1 - bias) k / n + bias * distance to the
    nearest held text.  Draws come from a hash of group and id, so a replay gives the same reservoir."""

    def update(key, batches, state: GroupState):
        kept = json.loads(state.get[0]) if state.exists else {"held": [], "seen": 0}
        held, seen, out = kept["held"], kept["seen"], []
        for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples():
            seen += 1
            rng = np.random.default_rng([int(r.id), *str(key[0]).encode()])
            if len(held) < k:
                held.append(r.text)
                out.append((key[0], r.id, True))
                continue
            near = min(distance(r.text, t) for t in held)
            taken = bool(rng.random() < (1 - bias) * k / seen + bias * near)
            if taken:
                held[int(rng.integers(k))] = r.text
            out.append((key[0], r.id, taken))
        state.update((json.dumps({"held": held, "seen": seen}),))
        yield pd.DataFrame(out, columns=["g", "id", "accepted"])

    return texts.groupBy("g").applyInPandasWithState(update, "g string, id long, accepted boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def append_sink(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet"):
    """Exactly-once append of every batch to files."""
    return stream.writeStream.format(kind).option("checkpointLocation", checkpoint).outputMode("append").start(path)
