"""The life of runs as a stream: a state machine of each run, in state that survives restarts.

Requests (run_id, seq, to_status, occurred_at) arrive in any order within a lateness. A request waits in its run's state until the watermark
has passed it, then all that have waited are taken in order of (occurred_at, seq), so outcomes don't depend on how files arrive. Legal ones move
the run, illegal ones are refused and leave it where it is; both become rows, told apart by ``kind``, by which a sink can be partitioned.
A run that stays in an open status for longer than ``stuck`` gets a row of kind stuck, once until it moves again.

Runs are dealt into shards by hash, and a shard is a key of the stream's state: reading and writing state costs a few calls a shard and batch, not a few
a run and batch. A shard that a batch touches is read whole, and written whole when requests fall due, so shards should be many enough to hold some hundreds of runs each.

Requests later than the lateness are dropped by the watermark, as Spark counts in the query's progress; nothing else is. A run's state is its status,
one time and what waits, so a run of very many requests holds those within the lateness only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans.audit import TRANSITIONS

OUTCOMES = "kind string, run_id string, seq long, from_status string, to_status string, status string, moved boolean, occurred_us long"
MOVED, REFUSED, STUCK = "moved", "refused", "stuck"
#: Shards of a stream where nothing else is said.
SHARDS = 1024
#: The run of rows that only move the watermark.
CLOCK = "(clock)"
LEGAL = frozenset(TRANSITIONS)
OPEN = frozenset(a for a, _ in TRANSITIONS)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunMachine(StatefulProcessor):
    """The runs of a shard, which share a state, a timer and the calls that read and write them. ``recorded``: requests are statuses that a run did
    have, so each is judged against the one before it, legal or not."""

    def __init__(self, stuck_ms: int, recorded: bool) -> None:
        self.stuck_ms, self.recorded = stuck_ms, recorded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wake = handle.getValueState("wake", "at_ms long")
        self.runs = handle.getListState("runs", "run_id string, status string, since_ms long, told boolean")
        self.waiting = handle.getListState("waiting", "run_id string, seq long, to_status string, at_us long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803, ARG002
        new = [(r.run_id, r.seq, r.to_status, r.at_us) for r in rows if r.run_id != CLOCK]
        if new:
            self.waiting.appendList(new)
            at, before = min(_ms(at) for *_, at in new), self.wake.get()
            if before is None or at < before[0]:
                if before is not None:
                    self.handle.deleteTimer(before[0])
                self._wake_at(at)
        return iter([])

    def _wake_at(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.wake.update((at,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803, ARG002
        """Take what the watermark has passed; wake again at the first of the rest, or when the next run counts as stuck."""
        now, out = timerValues.getCurrentWatermarkInMs(), []
        held = sorted(self.waiting.get(), key=lambda w: (w[3], w[1]))
        due = [w for w in held if _ms(w[3]) <= now]
        state = {r[0]: (r[1], r[2], r[3]) for r in self.runs.get()}
        for run_id, seq, wanted, at in due:
            status, since, told = state.get(run_id) or ("pending", None, False)
            moved = (status, wanted) in LEGAL
            after = wanted if moved else status
            out.append(Row(kind=MOVED if moved else REFUSED, run_id=run_id, seq=seq, from_status=status, to_status=wanted, status=after, moved=moved, occurred_us=at))
            if moved or since is None:
                since, told = _ms(at), False
            state[run_id] = (wanted if self.recorded else after, since, told)
        rest = held[len(due) :]
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.appendList([tuple(w) for w in rest])
        wakes = [_ms(rest[0][3])] if rest else []
        for run_id, (status, since, told) in state.items():
            if status not in OPEN or told:
                continue
            if since + self.stuck_ms <= now:
                state[run_id] = (status, since, True)
                out.append(Row(kind=STUCK, run_id=run_id, seq=None, from_status=status, to_status=None, status=status, moved=False, occurred_us=since * 1000))
            else:
                wakes.append(since + self.stuck_ms)
        if state:
            self.runs.put([(run_id, *s) for run_id, s in state.items()])
        if wakes:
            self._wake_at(min(wakes))
        else:
            self.wake.clear()
        return iter(out)

    def close(self) -> None:
        pass


def _ms(us: int) -> int:
    """The first millisecond that isn't before a time in microseconds."""
    return -(-us // 1000)


def machine(requests: DataFrame, lateness: str, stuck_ms: int = 7 * 86_400_000, recorded: bool = False, shards: int = SHARDS) -> DataFrame:
    """A stream of OUTCOMES of a stream of requests; the session needs RocksDB as its state store (:func:`start` sees to it). A stream keeps its
    number of ``shards`` for life."""
    rows = requests.withWatermark("occurred_at", lateness)
    rows = rows.select(F.pmod(F.xxhash64("run_id"), F.lit(shards)).alias("shard"), "run_id", "seq", "to_status", "occurred_at", F.unix_micros("occurred_at").alias("at_us"))
    return rows.groupBy("shard").transformWithState(RunMachine(stuck_ms, recorded), OUTCOMES, "Append", "EventTime")


def start(outcomes: DataFrame, out: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Write outcomes to the folder ``out``, a folder in it for each kind, and take what there is."""
    spark = outcomes.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = outcomes.writeStream.format("parquet").partitionBy("kind").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return (writer.queryName(name) if name else writer).start()
    finally:
        spark.conf.set(PROVIDER, before)


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    """What was written to ``out`` so far, all kinds together."""
    return spark.read.schema(OUTCOMES).parquet(out)


def clock(spark: SparkSession, at: Any) -> DataFrame:
    """One request that moves no run: after it, the watermark is at ``at`` less the lateness, and what waits until then is taken."""
    return spark.createDataFrame([(CLOCK, 0, None, at)], "run_id string, seq long, to_status string, occurred_at timestamp")
