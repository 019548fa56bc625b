import random

import pytest

from lumora.llm import jobs

from ..conftest import rows


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return sorted((x, root(x)) for x in up)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 230)] + [(300, 300), (None, 4), (5, None), (7, 8), (7, 8)]
    assert rows(jobs.components(spark.createDataFrame(edges, "a long, b long"))) == brute(edges)


def test_components_of_nothing(spark):
    assert jobs.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("alone", [0, 60, 115])
def test_components_by_rounds(spark, monkeypatch, alone):
    """Rounds to the end, until the list is short enough, and from a list that is so but for its repeats."""
    monkeypatch.setattr(jobs, "ALONE", alone)
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(90)] + [(i + 1, i) for i in range(200, 230)] + [(300, 300), (None, 4), (5, None)] + [(7, 8)] * 9
    assert rows(jobs.components(spark.createDataFrame(edges, "a long, b long"))) == brute(edges)
    assert jobs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_short_list_take_no_rounds(spark):
    """A chain, which takes the most rounds: a few small jobs, whatever the number of shuffle partitions."""
    edges = [(i, i + 1) for i in range(1000)]
    sc = spark.sparkContext
    sc.setJobGroup("short list", "components")
    try:
        assert rows(jobs.components(spark.createDataFrame(edges, "a long, b long"))) == [(i, 0) for i in range(1001)]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("short list")) <= 6


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_without(spark, monkeypatch, bits):
    monkeypatch.setattr(jobs, "MARK_BITS", (bits, bits))
    df = spark.createDataFrame([(i if i % 7 else None, str(i)) for i in range(100)] + [(3, "again")], "k long, t string")
    keys = spark.createDataFrame([(3,), (4,), (4,), (99999,)], "k long")
    assert rows(jobs.without(df, keys, "k")) == rows(df.where("k is null or k not in (3, 4)"))
    assert rows(jobs.without(df, keys.limit(0), "k")) == rows(df)
    assert rows(jobs.without(df.selectExpr("cast(k as int) k", "t"), keys, "k")) == rows(df.where("k is null or k not in (3, 4)"))
    assert set(rows(jobs.marked(df, "k", jobs.marks(keys, "k")))) >= set(rows(df.where("k in (3, 4)")))


def test_stored(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "k long, t string")
    assert rows(jobs.stored(df)) == rows(df) and jobs.stored(df.limit(0)).schema == df.schema
