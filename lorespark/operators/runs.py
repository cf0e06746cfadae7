"""Run log: current state of each run and moves that were not allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.frames import numbered
from lorespark.schemas import PHASES
from lorespark.session import durable


def run_status(run_events: DataFrame) -> DataFrame:
    """``(run_id, kb_id, phase, status, started_at, completed_at, error)``, by start.

    ``completed_at`` and ``error`` belong to the current state: they are null again once a
    run advances or is retried.
    """
    last = F.max_by(F.struct("kb_id", "phase", "status", "error", "ts"), F.struct("ts", "seq"))
    return (
        run_events.groupBy("run_id")
        .agg(last.alias("last"), F.min("ts").alias("started_at"))
        .select(
            "run_id",
            "last.kb_id",
            "last.phase",
            "last.status",
            "started_at",
            F.when(F.col("last.status") == "completed", F.col("last.ts")).alias("completed_at"),
            F.when(F.col("last.status") == "failed", F.col("last.error")).alias("error"),
        )
        .orderBy("started_at", "run_id")
    )


#: The states a run can be in, numbered from 1; 0 is a run that has not begun.
STATES = [(phase, status) for phase in PHASES for status in ("running", "completed", "failed")]
#: Events that one task folds at a time.
STRETCH = 256


def entered_from(phase: str, status: str) -> list[int]:
    """The numbers of the states from which a run may enter a state."""
    at = PHASES.index(phase)
    if status != "running":
        return [STATES.index((phase, "running")) + 1]
    begin = STATES.index((PHASES[at - 1], "completed")) + 1 if at else 0
    return [STATES.index((phase, "failed")) + 1, begin]


def state_number(phase: Column, status: Column) -> Column:
    """The number of a state; 0 for a phase or status that no run can have."""
    table = F.create_map(*[F.lit(x) for i, s in enumerate(STATES) for x in (" ".join(s), i + 1)])
    return F.coalesce(F.try_element_at(table, F.concat_ws(" ", phase, status)), F.lit(0))


def next_state(state: Column, event: Column) -> Column:
    """The state after an event that asks for state ``event``; a refused one changes nothing."""
    none = F.array().cast("array<int>")
    entered = F.array(none, *[F.array(*[F.lit(x) for x in entered_from(*s)]) for s in STATES])
    return F.when(F.array_contains(F.get(entered, event), state), event).otherwise(state)


def _stretches(rows: DataFrame, place: str, stretch: int, *columns: str) -> DataFrame:
    """``run_id, at, rows``: the rows of each stretch of places in order; a bounded number."""
    return rows.groupBy("run_id", F.floor(F.col(place) / stretch).cast("long").alias("at")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), *columns))).alias("rows")
    )


def _scan(stretches: DataFrame, starts: DataFrame | None, step) -> DataFrame:
    """Rows of ``stretches`` with ``before``, the state of the run before each; ``step`` leads on."""
    if starts is None:
        begun = stretches.withColumn("start", F.lit(0))
    else:
        begun = stretches.join(starts, ["run_id", "at"])
    seen = F.struct(F.col("start").alias("state"), F.array().cast("array<int>").alias("before"))
    before = F.reduce(
        "rows",
        seen,
        lambda acc, row: F.struct(
            step(acc["state"], row).alias("state"),
            F.concat(acc["before"], F.array(acc["state"])).alias("before"),
        ),
        lambda acc: acc["before"],
    )
    paired = begun.withColumn("before", before)
    return paired.select("run_id", F.explode(F.arrays_zip("rows", "before")).alias("x")).select(
        "run_id", "x.rows.*", "x.before"
    )


def judged_events(run_events: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Each event with ``accepted`` and the accepted state before it, ``prev_phase, prev_status``.

    An event is a function from the state before to the state after. Functions of a stretch of
    ``stretch`` events are composed into one table of what becomes of each state, tables of as
    many stretches into the next, until a run is one table; going back down, every stretch learns
    the state it starts from. So no task holds more than a stretch, and a run with a third of all
    events is worked on by as many tasks as it has stretches. Events of one run with equal time
    and ``seq`` are judged in no certain order.
    """
    asked = run_events.withColumn("_event", state_number(F.col("phase"), F.col("status")))
    placed = durable(numbered(asked, ["run_id"], ["ts", "seq"], "_n").withColumn("_n", F.col("_n") - 1))
    most = placed.agg(F.max("_n")).first()[0] or 0
    identity = F.array(*[F.lit(i) for i in range(len(STATES) + 1)])

    levels: list[DataFrame] = []
    while most >= stretch:
        if levels:
            folded = _stretches(levels[-1], "at", stretch, "table")
            then = lambda table, row: F.transform(table, lambda s: F.get(row["table"], s))
        else:
            folded = _stretches(placed, "_n", stretch, "_event")
            then = lambda table, row: F.transform(table, lambda s: next_state(s, row["_event"]))
        levels.append(durable(folded.select("run_id", "at", F.reduce("rows", identity, then).alias("table"))))
        most //= stretch
    starts = None
    for level in reversed(levels):
        rows = _scan(_stretches(level, "at", stretch, "table"), starts, lambda s, row: F.get(row["table"], s))
        starts = rows.select("run_id", F.col("place").alias("at"), F.col("before").alias("start"))
    held = [c for c in placed.columns if c not in ("run_id", "_n")]
    rows = _scan(_stretches(placed, "_n", stretch, *held), starts, lambda s, row: next_state(s, row["_event"]))
    names = lambda i: F.get(F.array(*[F.lit(s[i]) for s in STATES]), F.col("before") - 1)
    return rows.select(
        *run_events.columns,
        (next_state(F.col("before"), F.col("_event")) != F.col("before")).alias("accepted"),
        names(0).alias("prev_phase"),
        names(1).alias("prev_status"),
    )


def invalid_transitions(run_events: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Events of the log that are refused, with the state their run was and stays in."""
    return judged_events(run_events, stretch).filter("not accepted").drop("accepted")
