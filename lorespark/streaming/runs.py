"""Run state over a stream of run events, refusing moves that are not allowed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespark.operators.runs import STATES, entered_from
from lorespark.schemas import RUN_EVENTS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = (
    "run_id string, seq long, phase string, status string, accepted boolean,"
    " state_phase string, state_status string, _at long"
)


def allowed(old: tuple[str, str] | None, new: tuple[str, str]) -> bool:
    """Whether a run in state ``old`` (phase, status) may go to ``new``."""
    if new not in STATES or (old is not None and old not in STATES):
        return False
    return (0 if old is None else STATES.index(old) + 1) in entered_from(*new)


#: Every state with the states that a run may enter it from; ``None`` is a run that has not begun.
MOVES = {new: {old for old in (None, *STATES) if allowed(old, new)} for new in STATES}


def judge(key: Any, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The events of one run in a micro-batch, in order; ``state`` keeps its accepted phase and status."""
    old = tuple(state.get) if state.exists else None
    began = old
    frames = list(rows)
    seq, phase, status, at = (
        frames[0][c].to_numpy() if len(frames) == 1 else pd.concat([f[c] for f in frames]).to_numpy()
        for c in ("seq", "phase", "status", "_at")
    )
    order = np.lexsort((seq, at))
    seq, phase, status, at = seq[order], phase[order], status[order], at[order]
    accepted, phases, statuses = [], [], []
    for new in zip(phase, status):
        moved = old in MOVES.get(new, ())
        old = new if moved else old
        accepted.append(moved)
        phases.append(old and old[0]), statuses.append(old and old[1])
    if old != began:
        state.update(old)
    yield pd.DataFrame(
        {
            "run_id": key[0], "seq": seq, "phase": phase, "status": status, "accepted": accepted,
            "state_phase": phases, "state_status": statuses, "_at": at,
        }
    )


def run_status_stream(run_events: DataFrame) -> DataFrame:
    """Every event with whether it was accepted and the run's state after it.

    A refused move leaves the state as it was. Events of a run are put in order within a
    micro-batch, whose size the trigger options of the source bound; batches come in order. States
    travel to Python and back along with the rows, many runs at a time, not by a call for each run.
    """
    # Times are numbers on their way through Python, where a conversion for each run costs most.
    columns = run_events.select("run_id", "seq", "phase", "status", F.unix_micros("ts").alias("_at"))
    judged = columns.groupBy("run_id").applyInPandasWithState(
        judge, OUT, "phase string, status string", "append", GroupStateTimeout.NoTimeout
    )
    return judged.withColumn("_at", F.timestamp_micros("_at")).withColumnRenamed("_at", "ts")


def stream_run_events(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """Run events files as they arrive in a folder."""
    return (
        spark.readStream.schema(RUN_EVENTS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(directory)
    )


def store_run_states(run_events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Judge everything that has arrived, append the result to a table, then stop.

    The session must keep its stream state in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    return (
        run_status_stream(run_events)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
