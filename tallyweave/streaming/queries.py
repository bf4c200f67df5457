"""Streaming forms of validation, activity counts, deduplication and ticket states."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import rules as R


def validate_stream(stream: DataFrame, rules: list[R.Rule], **options) -> DataFrame:
    """The issues of row checks on a stream; ``unique`` needs ``unique_stream``."""
    if any(r.check == "unique" for r in rules):
        raise ValueError("unique is a stateful check: use unique_stream")
    return R.validate(stream, rules, **options)


def validate_with_tables(stream: DataFrame, rules: list[R.Rule], tables: Callable[[], dict], folder: str, **options) -> None:
    """All issues of a stream, look-ups in reference tables too: ``folder``/out, a folder per batch.

    ``tables`` gives the ``refs`` of ``rules.validate`` (see ``references.table_checks``)
    and is asked for each batch, so that a batch meets the tables as they
    are then: reading them by path in it takes a new version in.  A batch that is run again
    replaces its own folder.  ``unique`` needs ``unique_stream``.
    """
    if any(r.check == "unique" for r in rules):
        raise ValueError("unique is a stateful check: use unique_stream")

    def check(batch: DataFrame, number: int) -> None:
        R.validate(batch, rules, refs=tables(), **options).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(check).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def activity_windows(stream: DataFrame, *, at: str, kind: str, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per kind and window; later events than the watermark are dropped."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    counts = stream.withWatermark(at, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "events")


def dedupe_stream(stream: DataFrame, *, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def unique_stream(stream: DataFrame, *, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """(key, occurrences so far) of each repeat of a key: the second and later events.

    The first event of a key can't be flagged after the fact.  State expires
    when the watermark passes a key's last event.
    """

    def count(group, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = state.get if state.exists else (0, 0)
        for frame in frames:
            rows = len(frame)
            last = max(last, int(frame["ms"].max()))
            first = max(seen + 1, 2)
            if seen + rows >= 2:
                numbers = range(first, seen + rows + 1)
                yield pd.DataFrame({"key": [group[0]] * len(numbers), "occurrence": list(numbers)})
            seen += rows
        state.update((seen, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)

    keyed = stream.withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"), F.col(at))
    return keyed.groupBy("key").applyInPandasWithState(count, "key string, occurrence long", "seen long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def ticket_states(stream: DataFrame, *, key: str = "ticket_id", action: str = "action", order: str = "seq") -> DataFrame:
    """Ticket status after each batch of decisions, by the rules of ``apply_decisions`` (without blockers)."""

    def fold(group, frames, state: GroupState):
        status = state.get[0] if state.exists else "pending_review"
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if row.action == "reject":
                status = "rejected"
            elif row.action == "approve" and status == "pending_review":
                status = "approved"
            elif row.action == "complete" and status == "approved":
                status = "completed"
        state.update((status,))
        yield pd.DataFrame({"ticket_id": [group[0]], "status": [status]})

    given = stream.select(F.col(key).cast("string").alias("ticket_id"), F.col(action).alias("action"), F.col(order).cast("long").alias("seq"))
    return given.groupBy("ticket_id").applyInPandasWithState(fold, "ticket_id string, status string", "status string", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Process what is there and stop; results and checkpoint in ``folder``."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def delta_stream(stream: DataFrame, folder: str, keys: list[str], order: list[str]) -> None:
    """Per micro-batch: the last table with the batch's rows in place of those with equal keys, written as a new version.

    Of a batch's rows with equal keys the last by the columns ``order`` (and then
    by the other columns) counts. A version is a whole table: for tables
    much larger than their batches, give the batches more time to gather.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys and c not in order]
        last = F.max_by(F.struct(*batch.columns), F.struct(*order, *rest)).alias("row")
        rows = batch.groupBy(*keys).agg(last).select("row.*")
        if number:
            old = spark.read.parquet(f"{folder}/v{number - 1}")
            rows = old.join(rows.select(*keys), keys, "left_anti").unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{folder}/v{number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
