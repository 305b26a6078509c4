"""A key asks its state store a few times a batch, and a replay is written by every task."""

import types

from pyspark.sql.types import LongType, StructField, StructType

from tidepanel.plans import queries_decisions
from tidepanel.streaming.ordered import MICROS, InOrder


class _Handle:
    def __init__(self):
        self.timers, self.calls, self.rows, self.value = set(), 0, [], None

    def getListState(self, name, schema):  # noqa: N802
        def count(f):
            def call(*a):
                self.calls += 1
                return f(*a)

            return call

        put = lambda rows: setattr(self, "rows", list(rows))
        return types.SimpleNamespace(appendValue=count(self.rows.append), appendList=count(lambda r: put(self.rows + list(r))), get=lambda: iter(self.rows), exists=lambda: bool(self.rows), put=put, clear=lambda: put([]))

    def getValueState(self, name, schema):  # noqa: N802
        return types.SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def registerTimer(self, t):  # noqa: N802
        self.calls += 1
        self.timers.add(t)


def test_rows_of_a_key_go_to_the_store_together_and_come_in_order():
    schema = StructType([StructField(MICROS, LongType()), StructField("x", LongType())])
    p = InOrder(lambda key, state, row: ((row.x,), [(state[0] if state else None, row.x)]), schema, "x long", [MICROS], ["before", "x"])
    h = _Handle()
    p.init(h)
    row = __import__("pyspark.sql", fromlist=["Row"]).Row(MICROS, "x")
    list(p.handleInputRows((1,), iter([row(t * 1000, t) for t in range(50, 0, -1)]), None))
    assert h.calls <= 2
    got = []
    for mark in (20, 50):
        while due := [t for t in h.timers if t <= mark]:
            h.timers.discard(due[0])
            got += [r.x for r in p.handleExpiredTimer((1,), types.SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m), None)]
    assert got == list(range(1, 51)) and not h.rows


def test_a_replay_is_not_written_by_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_decisions, "folder", lambda v: str(tmp_path / "run"))
    source = spark.range(0, 1000, numPartitions=4)
    out = queries_decisions.replay(types.SimpleNamespace(spark=spark), source, lambda s: s)
    assert out.count() == 1000
    assert len(list((tmp_path / "run" / "in").glob("*.parquet"))) == 4
