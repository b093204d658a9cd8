"""Live early-stop alerts: the batch walk as keyed state, with steps put in order across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpuslab.streaming import snapshots, state

STANDING = "best double, best_step long, stale long, stop_step long, taken long, top long, late long, timer long"
PENDING = "step long, loss double"
PROGRESS = T.StructType([
    T.StructField("run_name", T.StringType()),
    T.StructField("best_step", T.LongType()),
    T.StructField("best_loss", T.DoubleType()),
    T.StructField("stop_step", T.LongType()),
    T.StructField("stopped", T.BooleanType()),
    T.StructField("n_late", T.LongType()),
])


@dataclass
class Standing:
    """Where a run stands after all steps up to ``taken``; ``top`` is the greatest step seen."""

    best: float | None = None
    best_step: int | None = None
    stale: int = 0
    stop_step: int | None = None
    taken: int | None = None
    top: int | None = None
    late: int = 0
    timer: int | None = None

    def take(self, step: int, loss: float, patience: int, min_delta: float) -> None:
        self.taken = step
        if self.stop_step is not None:
            return
        if self.best is None or loss < self.best - min_delta:
            self.best, self.best_step, self.stale = loss, step, 0
        else:
            self.stale += 1
            if self.stale >= patience:
                self.stop_step = step


class Walk(StatefulProcessor):
    """Per run: the walk so far as one value, and a list of the steps that wait for earlier ones.

    A step is taken when one that is ``slack`` or more greater has been seen, when more than ``most`` steps wait (the
    earliest go first), or when the run has been silent for ``idle`` milliseconds. A step at or before one that was
    taken is late: it is counted and left out. A step that comes again while it waits counts once.
    """

    def __init__(self, patience: int, min_delta: float, slack: int, most: int, idle: int | None):
        self.patience, self.min_delta, self.slack, self.most, self.idle = patience, min_delta, slack, most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", STANDING)
        self.waiting = handle.getListState("pending", PENDING)

    def _load(self) -> tuple[Standing, dict[int, float]]:
        if not self.standing.exists():
            return Standing(), {}
        waiting = {s: x for s, x in self.waiting.get()} if self.waiting.exists() else {}
        return Standing(*self.standing.get()), waiting

    def _save(self, walk: Standing, waiting: dict[int, float]) -> None:
        self.standing.update((walk.best, walk.best_step, walk.stale, walk.stop_step, walk.taken, walk.top, walk.late, walk.timer))
        if waiting:
            self.waiting.put(sorted(waiting.items()))
        elif self.waiting.exists():
            self.waiting.clear()

    def _take(self, walk: Standing, waiting: dict[int, float], steps: list[int]) -> None:
        for step in steps:
            walk.take(step, waiting.pop(step), self.patience, self.min_delta)
        if walk.stop_step is not None:
            waiting.clear()

    def _row(self, key: tuple, walk: Standing, waiting: dict[int, float]) -> Row:
        """Where the run stands if what waits is all that is still to come."""
        ahead = Standing(walk.best, walk.best_step, walk.stale, walk.stop_step)
        for step in sorted(waiting):
            ahead.take(step, waiting[step], self.patience, self.min_delta)
        name = None if key[0] is None else str(key[0])
        return Row(run_name=name, best_step=ahead.best_step, best_loss=ahead.best, stop_step=ahead.stop_step, stopped=ahead.stop_step is not None, n_late=walk.late)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        walk, waiting = self._load()
        for row in rows:
            step, loss = row["step"], row["loss"]
            if walk.stop_step is not None or walk.taken is not None and step <= walk.taken:
                walk.late += walk.stop_step is None
                continue
            waiting[step] = loss
            walk.top = step if walk.top is None else max(walk.top, step)
            if len(waiting) >= 2 * self.most + 1024:
                self._take(walk, waiting, sorted(waiting)[: -self.most or None])
        order = sorted(waiting)
        ready = [s for s in order if s <= walk.top - self.slack]
        self._take(walk, waiting, max(ready, order[: max(0, len(order) - self.most)], key=len))
        if self.idle is not None:
            if walk.timer is not None:
                self.handle.deleteTimer(walk.timer)
            walk.timer = None
            if waiting:
                walk.timer = timerValues.getCurrentProcessingTimeInMs() + self.idle
                self.handle.registerTimer(walk.timer)
        self._save(walk, waiting)
        yield self._row(key, walk, waiting)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        walk, waiting = self._load()
        self._take(walk, waiting, sorted(waiting))
        walk.timer = None
        self._save(walk, waiting)
        yield self._row(key, walk, waiting)

    def close(self) -> None:
        pass


def track(
    evals: DataFrame, run: str = "run_name", step: str = "step", loss: str = "loss", patience: int = 3, min_delta: float = 0.01,
    slack: int = 0, most: int = 10_000, idle_seconds: float | None = None,
) -> DataFrame:
    """A row per run and micro-batch with where the run stands.

    Steps that arrive at most ``slack`` steps after a greater one are put in their place, also across micro-batches, so
    the rows end as the batch walk does; others are late and counted. At most ``most`` steps of a run wait in its state,
    beside those that one micro-batch brings (``maxFilesPerTrigger`` bounds these); with ``idle_seconds`` a silent run's
    steps are taken when its timer fires. Missing losses are skipped.
    """
    idle = None if idle_seconds is None else int(1000 * idle_seconds)
    narrow = evals.where(F.col(loss).isNotNull()).select(F.col(run).alias("run"), F.col(step).cast("long").alias("step"), F.col(loss).cast("double").alias("loss"))
    return narrow.groupBy("run").transformWithState(
        Walk(patience, min_delta, slack, most, idle), PROGRESS, "Update", "None" if idle is None else "ProcessingTime"
    )


def start(evals: DataFrame, path: str, once: bool = False, every: int = snapshots.EVERY, **options) -> StreamingQuery:
    """Keep the progress of all runs below ``path``; ``every`` micro-batches it is folded into a base."""
    def publish(progress: DataFrame, number: int) -> None:
        snapshots.publish(progress, number, path, "run_name", every)

    with state.keyed_store(evals.sparkSession):
        writer = track(evals, **options).writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{path}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer).start()


def progress(spark, path: str) -> DataFrame:
    """The newest progress row of each run, with the number of its late steps."""
    return snapshots.latest(spark, path, "run_name", PROGRESS)


def latest(spark, path: str) -> DataFrame:
    return progress(spark, path).drop("n_late")
