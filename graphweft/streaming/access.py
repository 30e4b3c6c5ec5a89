"""Access signals over a stream (an extension: batch does the same in ``analytics.signals``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per key and tumbling window; later than ``late`` is left out."""
    w = F.window(F.col(time), width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), *keys, "events")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = F.session_window(F.col(time), gap)
    return events.withWatermark(time, late).groupBy(s.alias("s"), key).agg(F.count("*").alias("events")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), key, "events")


def co_access_stream(events: DataFrame, group: str, node: str, at_ms: str, window_ms: int = 30_000, least: int = 3, keep_ms: int = 86_400_000, forget: bool = False) -> DataFrame:
    """``group, a, b, count`` each time a pair of one group's nodes has been accessed within the window at least ``least`` times.

    State per group: the accesses of the last window, and the counts of the pairs seen in the last ``keep_ms`` of the group's own time. With
    ``forget`` a group without events for that long in processing time loses its state; the stream then runs a batch at every trigger.
    """
    kinds = dict(events.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [group, "a", "b", "count"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        recent, counts = [], {}
        if state.exists:
            held, pairs, numbers, seen = state.get
            recent = [(int(t), n) for t, n in (x.split("\t", 1) for x in held)]
            counts = {p: (c, t) for p, c, t in zip(pairs, numbers, seen)}
        out, now = [], None
        rows = pd.concat(list(batches)).dropna().sort_values([at_ms, node])
        for t, n in zip(rows[at_ms].astype("int64"), rows[node].astype(str)):
            now = t
            recent = [(u, m) for u, m in recent if t - u < window_ms]
            for _, m in recent:
                if m != n:
                    pair = "\t".join(sorted((m, n)))
                    counts[pair] = (counts.get(pair, (0, t))[0] + 1, t)
                    if counts[pair][0] >= least:
                        a, b = pair.split("\t")
                        out.append((key[0], a, b, counts[pair][0]))
            recent.append((t, n))
        if now is not None:
            counts = {p: v for p, v in counts.items() if now - v[1] < keep_ms}
        state.update(([f"{t}\t{n}" for t, n in recent], list(counts), [int(c) for c, _ in counts.values()], [int(t) for _, t in counts.values()]))
        if forget:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=columns)

    src = events.select(group, F.col(node).cast("string").alias(node), F.col(at_ms).cast("long").alias(at_ms))
    return src.groupBy(group).applyInPandasWithState(step, f"`{group}` {kinds[group]}, a string, b string, count long", "recent array<string>, pairs array<string>, counts array<long>, seen array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)
