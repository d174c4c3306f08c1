"""Job events as a stream: current state (T1), transition audit (T2) and
interrupted-job detection by event-time timeout (T4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tuneframe import constants as K
from tuneframe.operators.jobs import fold_state

def event_schema(id_type: T.DataType | None = None) -> T.StructType:
    """Progress events; job and model ids are strings unless told otherwise."""
    id_type = id_type or T.StringType()
    return T.StructType([
        T.StructField("job_id", id_type), T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()), T.StructField("status", T.StringType()),
        T.StructField("step", T.IntegerType()), T.StructField("total_steps", T.IntegerType()),
        T.StructField("loss", T.DoubleType()), T.StructField("loss_named", T.BooleanType()),
        T.StructField("error", T.StringType()), T.StructField("model_id", id_type),
    ])


EVENT_SCHEMA = event_schema(T.LongType())


def stream_job_state(events: DataFrame) -> DataFrame:
    """The batch fold (``fold_state``) over a streaming DataFrame: run it with
    output mode ``update`` or ``complete``; aggregation state lives in the
    state store and is checkpointed."""
    return fold_state(events)


def _id_type(events: DataFrame) -> str:
    return events.schema["job_id"].dataType.simpleString()


def _rocksdb(events: DataFrame) -> None:
    """Stateful processors keep lists and timers, which only the RocksDB state
    store holds; a session that chose another provider keeps its choice."""
    conf = events.sparkSession.conf
    if not conf.get(_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _millis(times) -> list[int]:
    import pandas as pd
    return [pd.Timestamp(t).value // 1_000_000 for t in times]


class TransitionAudit(StatefulProcessor):
    """Per job the last ``(seq, status)``, and a list of the events that wait
    for the watermark, one entry each. A timer stands at the earliest waiting
    event's time; when the watermark passes it, the events that are due are
    taken in ``seq`` order."""

    def __init__(self, allowed):
        self.allowed = {f"{a}>{b}" for a, b in allowed}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, status string")
        self.timer = handle.getValueState("timer", "millis long")
        self.waiting = handle.getListState("waiting", "seq long, status string, millis long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        earliest = None
        for pdf in rows:
            millis = _millis(pdf["ts"])
            self.waiting.appendList(list(zip(pdf["seq"].tolist(), pdf["status"].tolist(), millis)))
            earliest = min([earliest, *millis] if earliest is not None else millis)
        if earliest is not None:
            self._wake(earliest)
        yield pd.DataFrame(columns=_TRANSITION)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd
        passed = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for seq, status, millis in self.waiting.get():
            (due if millis <= passed else later).append((seq, status, millis))
        last = self.last.get() if self.last.exists() else None
        rows = []
        for seq, status, _ in sorted(due, key=lambda e: (e[0], str(e[1]))):
            if last is not None and seq <= last[0]:
                continue
            if last is not None:
                rows.append((key[0], last[1], status, f"{last[1]}>{status}" in self.allowed))
            last = (seq, status)
        if last is not None:
            self.last.update(tuple(last))
        self.timer.clear()
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self._wake(min(e[2] for e in later))
        yield pd.DataFrame(rows, columns=_TRANSITION)

    def _wake(self, millis: int) -> None:
        """One timer a job, at the earliest time asked for."""
        if self.timer.exists():
            (set_to,) = self.timer.get()
            if set_to <= millis:
                return
            self.handle.deleteTimer(set_to)
        self.handle.registerTimer(millis)
        self.timer.update((millis,))

    def close(self) -> None:
        pass


_TRANSITION = ["job_id", "from_status", "to_status", "allowed"]


def stream_transitions(events: DataFrame, allowed=K.ALLOWED_TRANSITIONS, watermark: str = "10 minutes") -> DataFrame:
    """Each consecutive status pair of a job in ``seq`` order, flagged against
    the allowed pairs. Events wait in the job's list state until the watermark
    has passed their time and are then taken in ``seq`` order, so events may
    arrive in any order within ``watermark``; Spark drops those that come
    later. The state is the last ``(seq, status)`` and the waiting events, at
    most those of one watermark delay."""
    _rocksdb(events)
    rows = events.withWatermark("ts", watermark).select("job_id", "seq", "status", "ts")
    schema = f"job_id {_id_type(events)}, from_status string, to_status string, allowed boolean"
    return rows.groupBy("job_id").transformWithStateInPandas(TransitionAudit(allowed), schema, "Append", "EventTime")


class SilenceWatch(StatefulProcessor):
    """Per job the event of the highest ``seq`` and one timer, ``timeout``
    after that event."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, status string, ts string, timer long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        known = self.last.get() if self.last.exists() else None
        best = known
        for pdf in rows:
            top = pdf.loc[pdf["seq"].idxmax()]
            if best is None or int(top["seq"]) > best[0]:
                best = (int(top["seq"]), top["status"], str(top["ts"]), 0)
        if best is not known:
            if known is not None:
                self.handle.deleteTimer(known[3])
            # The deadline of an event that arrives behind it is the next batch.
            due = max(_millis([best[2]])[0] + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
            self.last.update((*best[:3], due))
        yield pd.DataFrame(columns=_SILENT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd
        rows = []
        if self.last.exists():
            _, status, ts, _ = self.last.get()
            self.last.clear()
            if status in K.ACTIVE_STATUSES:
                rows.append((key[0], "failed", K.INTERRUPTED_ERROR, K.INTERRUPTED_MESSAGE, ts))
        yield pd.DataFrame(rows, columns=_SILENT)

    def close(self) -> None:
        pass


_SILENT = ["job_id", "status", "error", "message", "last_event"]


def stream_interrupted(events: DataFrame, timeout: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Active jobs that stay silent for ``timeout`` of event time are reported
    failed with the fixed interruption error. Per job the state is the event of
    the highest ``seq``, so an older event that arrives late changes nothing; a
    finished job keeps its state as long, so that no late event revives it. An
    event-time timer fires once the watermark passes ``last event + timeout``
    and removes the state; a newer event moves the timer."""
    import pandas as pd
    _rocksdb(events)
    rows = events.withWatermark("ts", watermark).select("job_id", "seq", "status", "ts")
    schema = f"job_id {_id_type(events)}, status string, error string, message string, last_event string"
    watch = SilenceWatch(int(pd.Timedelta(timeout).total_seconds() * 1000))
    return rows.groupBy("job_id").transformWithStateInPandas(watch, schema, "Append", "EventTime")


def sink_job_state(events: DataFrame, table_dir: str, checkpoint: str, available_now: bool = True):
    """Run ``stream_job_state`` into the last-write-wins job table (T1 + B2).

    In ``update`` mode every micro-batch emits the complete current state of
    each job it touched (the state store keeps the rest); the rows are appended
    under the query's and the batch's id. The row with the highest ``last_seq``
    is a job's current one, so a batch that is replayed after a failure, or a
    new checkpoint over an old table, changes nothing that is newer."""
    from tuneframe.sinks import append_rows

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]
        append_rows(batch, table_dir, query, batch_id)

    w = stream_job_state(events).writeStream.outputMode("update").foreachBatch(write) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
