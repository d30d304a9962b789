"""Streams of evidence: windows of flow, sessions, layering and module alerts with state, incremental keyword search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def flow_windows(events: DataFrame, account: str, ts: str, amount: str, leg: str, late: str = "1 hour", width: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """Inflow and outflow per account and sliding window; rows later than ``late`` are dropped by the watermark."""
    rows = events.withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, width, slide), account).agg(
        F.sum(F.when(F.col(leg) == "IN", F.col(amount))).alias("inflow"), F.sum(F.when(F.col(leg) == "OUT", F.col(amount))).alias("outflow"), F.count(F.lit(1)).alias("n")
    )
    return out.select(F.col("window.start").alias("starts"), F.col("window.end").alias("ends"), account, F.coalesce("inflow", F.lit(0.0)).alias("inflow"), F.coalesce("outflow", F.lit(0.0)).alias("outflow"), "n")


def sessions(events: DataFrame, account: str, ts: str, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Bursts of an account's events without a pause longer than ``gap``."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), account).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"), account, "n")


def layering(events: DataFrame, account: str, ts: str, amount: str, leg: str, event: str, days: float = 3.0, quiet_hours: int = 24 * 7) -> DataFrame:
    """account, in_event, out_event, dispatched as outflows arrive: each takes what is left of earlier inflows.

    State per account: inflows within ``days`` that are not used up, so it is bounded by the window; none is kept for an account
    without such inflows, or without events for ``quiet_hours`` of processing. Input is to arrive in time order within an account.
    """
    limit = days * 86_400

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        found = []
        for frame in frames:
            for r in frame.sort_values(["t", "event"]).itertuples(index=False):
                held = [h for h in held if r.t - h[1] <= limit and h[2] > 0]
                if r.leg == "IN":
                    held.append((r.event, r.t, r.cents))
                    continue
                need, rest = r.cents, []
                for e, t, left in held:
                    take = min(need, left)
                    if take > 0:
                        found.append((key[0], e, r.event, take / 100))
                    need -= take
                    rest.append((e, t, left - take))
                held = rest
        held = [h for h in held if h[2] > 0]
        if held:
            state.update(tuple(list(c) for c in zip(*held, strict=True)))
            state.setTimeoutDuration(quiet_hours * 3_600_000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=["account", "in_event", "out_event", "dispatched"])

    slim = events.select(
        F.col(account).cast("long").alias("account"), F.unix_timestamp(F.col(ts).cast("timestamp")).alias("t"), F.round(F.col(amount) * 100).cast("long").alias("cents"), F.col(leg).alias("leg"), F.col(event).cast("long").alias("event")
    )
    return slim.groupBy("account").applyInPandasWithState(
        work, "account long, in_event long, out_event long, dispatched double", "events array<long>, times array<long>, cents array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def module_alerts(findings: DataFrame, entity: str, module: str, least: int = 3, quiet_hours: int = 24 * 90) -> DataFrame:
    """entity, modules: once per entity, when the ``least``-th distinct module reports it.

    State per entity: the modules that reported it; forgotten after ``quiet_hours`` of processing without a finding.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(state.get[0]) if state.exists else set()
        before = len(seen)
        for frame in frames:
            seen |= set(frame.module)
        state.update((sorted(seen),))
        state.setTimeoutDuration(quiet_hours * 3_600_000)
        fresh = before < least <= len(seen)
        yield pd.DataFrame({"entity": [key[0]] * fresh, "modules": [",".join(sorted(seen))] * fresh})

    slim = findings.select(F.col(entity).cast("string").alias("entity"), F.col(module).alias("module"))
    return slim.groupBy("entity").applyInPandasWithState(work, "entity string, modules string", "modules array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = (), report: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """All that has arrived, in micro-batches, as Parquet below ``path``: a folder per batch, written anew if a batch is repeated.

    keys: rows of a batch that agree in them count once. report(batch, rows) is told of each batch when it is written. The size
    of a batch is the source's matter (``maxFilesPerTrigger``).
    """

    def keep(rows: DataFrame, batch: int) -> None:
        out = rows.dropDuplicates(list(keys)) if keys else rows
        target = f"{path}/batch={batch}"
        out.write.mode("overwrite").parquet(target)
        if report is not None:
            report(batch, rows.sparkSession.read.parquet(target).count())

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_hits(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Hits as they come, appended as CSV files with a header; each is there once, whatever fails on the way."""
    return stream.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def search_new_terms(docs: DataFrame, searched: DataFrame, terms: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, term, hits for the terms that were not searched before; terms are few and travel to the texts."""
    new = terms.select("term").distinct().join(searched.select("term"), "term", "left_anti")
    listed = new.agg(F.collect_list(F.lower("term")).alias("terms"))
    rows = docs.select(id_col, F.lower(text).alias("_t")).join(F.broadcast(listed))  # one row is broadcast
    hits = rows.select(id_col, "_t", F.explode("terms").alias("term"))
    count = ((F.length("_t") - F.length(F.replace("_t", "term", F.lit("")))) / F.length("term")).cast("int")
    return hits.select(id_col, "term", count.alias("hits")).filter("hits > 0")
