"""Rounds over few edges: their tasks follow the edges, not the shuffle partitions."""

from __future__ import annotations

import pytest

from factmill.llm.components import components
from factmill.llm.simhash import near_duplicates

from .corpus import frame, rows_of


@pytest.fixture
def dealt(spark):
    """Many shuffle partitions that aren't put together afterwards; gives the number of tasks since it was asked last."""
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    sc = spark.sparkContext
    sc.setJobGroup("dealt", "")

    def tasks():
        now = sc.statusTracker()
        stages = {s for j in now.getJobIdsForGroup("dealt") for s in now.getJobInfo(j).stageIds}
        return sum(info.numTasks for s in stages if (info := now.getStageInfo(s)) and info.numCompletedTasks)

    yield tasks
    sc.setLocalProperty("spark.jobGroup.id", None)
    for k, v in old.items():
        spark.conf.set(k, v)


def test_few_edges_take_few_tasks(spark, dealt):
    chain = [(i + 1, i) for i in range(1, 30)] + [(100, 101), (102, 100), (7, 7)]
    got = dict(rows_of(components(spark.createDataFrame(chain, "u long, v long")), "node", "root"))
    assert got == {i: 1 for i in range(1, 31)} | {100: 100, 101: 100, 102: 100}
    assert dealt() < 2000


def test_rows_that_share_an_id_still_join_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (4, a), (5, b), (9, b), (6, c), (8, c)]
    assert dict(rows_of(near_duplicates(frame(spark, rows)), "doc_id", "root")) == {4: 4, 5: 4, 9: 4, 6: 6, 8: 6}
