"""Workers give back what a task has freed."""

from __future__ import annotations

import pyarrow as pa

from docquarry.llm import common


def test_trimmed(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common.gc, "collect", lambda: calls.append(1))
    batches = [pa.record_batch({"a": [i]}) for i in range(3)]
    assert list(common.trimmed(lambda some: (b for b in some))(iter(batches))) == batches and calls == [1]
    frame = spark.range(5)
    assert frame.mapInArrow(common.trimmed(lambda some: some), frame.schema).count() == 5
