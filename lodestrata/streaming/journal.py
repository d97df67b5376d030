"""Event journals and bursts as streams, each with a batch twin that must agree."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def payload_digest(*columns: str):
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def dedupe_batch(events: DataFrame, key: str, order: str, payload: list[str]) -> DataFrame:
    """First event of each key by `order` with status accepted; later ones are repeat (same payload) or
    conflict (another one)."""
    marked = events.withColumn("__d", payload_digest(*payload))
    first = marked.groupBy(key).agg(F.min(F.struct(order, "__d")).alias("f"))
    joined = marked.join(first, key)
    status = F.when(F.col(order) == F.col("f")[order], "accepted").when(F.col("__d") == F.col("f.__d"), "repeat").otherwise("conflict")
    return joined.select(*events.columns, status.alias("status"))


def dedupe_stream(events: DataFrame, key: str, order: str, payload: list[str]) -> DataFrame:
    """The same over a stream: state per key is the digest of its first payload. (key, order, status)"""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest = state.get[0] if state.exists else None
        for pdf in batches:
            out = []
            for n, d in pdf.sort_values(order)[[order, "__d"]].itertuples(index=False):
                out.append((name[0], n, "accepted" if digest is None else "repeat" if d == digest else "conflict"))
                digest = digest or d
            state.update((digest,))
            yield pd.DataFrame(out, columns=[key, order, "status"])

    types = dict(events.dtypes)
    marked = events.select(key, order, payload_digest(*payload).alias("__d"))
    return marked.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, {order} {types[order]}, status string", "digest string", "append", GroupStateTimeout.NoTimeout)


def latest_fold(events: DataFrame, group: str, order: str, status: str, wanted: str) -> DataFrame:
    """Last event of each group, then those of a status: last wins first, the filter comes second."""
    rest = [c for c in events.columns if c != group]
    last = events.groupBy(group).agg(F.max_by(F.struct(*rest), order).alias("e"))
    return last.select(group, "e.*").where(F.col(status) == wanted)


def bursts(events: DataFrame, ts: str, by: str, gap: str = "30 seconds", watermark: str | None = None) -> DataFrame:
    """Runs of events of one `by` with no gap of `gap` or more: (by, first, last, n). With a watermark this
    works on a stream; events later than it are left out."""
    held = events.withWatermark(ts, watermark) if watermark else events
    g = held.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return g.select(by, "first", "last", "n")


def undo_history(events: DataFrame, group: str, order: str, value: str, most: int = 200) -> DataFrame:
    """Per group the current value after undo events (value null) and the bounded list of what can be undone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stack: list = []
        for v in pdf.sort_values(order)[value]:
            if pd.isna(v):
                stack[-1:] = []
            else:
                stack = [*stack, v][-most:]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "current": [stack[-1] if stack else None], "depth": [len(stack)]})

    types = dict(events.dtypes)
    return events.groupBy(group).applyInPandas(run, f"{group} {types[group]}, current {types[value]}, depth long")
