"""Per-key state over rows that arrive out of order: they wait until the watermark has passed them, then go in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: step(key, state or None, row) -> (new state, output rows)
Step = Callable[[tuple, "tuple | None", Row], "tuple[tuple | None, list[tuple]]"]
MICROS = "_micros"


class InOrder(StatefulProcessor):
    """Keeps rows in a list state and the result so far in a value state; a timer at the
    earliest row that waits wakes it up. The store is asked a few times a key and batch, not for each row."""

    def __init__(self, step: Step, rows: StructType, state: str, order: list[str], out: list[str]):
        self.step, self.rows, self.state, self.order, self.out = step, rows, state, order, Row(*out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.rows)
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        self.open.appendList([tuple(r) for r in rows])
        self.handle.registerTimer(min(r[MICROS] // 1000 for r in rows))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs()
        names = self.rows.names
        at = names.index(MICROS)
        held = [Row(*names)(*r) for r in self.open.get()] if self.open.exists() else []
        due = sorted((r for r in held if r[MICROS] // 1000 <= upto), key=lambda r: tuple(r[c] for c in self.order))
        if not due:
            return
        wait = [tuple(r) for r in held if r[MICROS] // 1000 > upto]
        if wait:
            self.open.put(wait)
            self.handle.registerTimer(min(r[at] // 1000 for r in wait))
        else:
            self.open.clear()
        state = self.last.get() if self.last.exists() else None
        state = None if state is None else tuple(state)
        for row in due:
            state, out = self.step(key, state, row)
            for r in out:
                yield self.out(*r)
        if state is not None:
            self.last.update(state)

    def close(self) -> None:
        pass


def in_order(df: DataFrame, key: str, ts: str, late: str, step: Step, state: str, schema: str, first: tuple[str, ...] = ()) -> DataFrame:
    """Output rows of step over the rows of each key in the order of ts; at equal times rows for which `first` is true come
    first, then the order is that of all columns.

    Rows later than the watermark (late behind the newest ts) are dropped, as Spark does. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass) when the query starts.
    """
    x = df.withWatermark(ts, late).withColumn(MICROS, F.unix_micros(ts))
    order = [MICROS, *(f"_last_{c}" for c in first), "_place"]
    x = x.withColumns({f"_last_{c}": ~F.col(c) for c in first} | {"_place": F.to_json(F.struct(*[c for c in df.columns if c != ts]))})
    names = [field.split()[0] for field in schema.split(", ")]
    return x.groupBy(key).transformWithState(InOrder(step, x.schema, state, order, names), schema, "append", "EventTime")
