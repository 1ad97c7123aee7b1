"""Quantiles by selection are the built-in ones, for hot groups, ties, few values and none."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from quantloom.functions.selection import PARTS, grouped

ASKED = {"q0": 0.0, "q25": 0.25, "median": 0.5, "q90": 0.9, "q1": 1.0, "odd": 0.3337}


def near(df):
    return sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    hot = [("hot", 1, rng.gauss(0, 1000)) for _ in range(6000)]
    tied = [(None, 1, float(rng.choice((-5, -5, -5, 0, 7)))) for _ in range(3000)]
    mixed = [("mixed", 2, 3.5 if rng.random() < 0.9 else rng.uniform(3, 4)) for _ in range(3000)] + [("mixed", 2, None)] * 50
    few = [("few", k % 3, float(k)) for k in range(40)] + [("none", 1, None)] * 3
    return spark.createDataFrame(hot + tied + mixed + few, "a string, b int, v double").repartition(6)


def test_groups_of_every_size(rows):
    want = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *(F.percentile("v", p).alias(k) for k, p in ASKED.items()))
    for limit in (20, 500, 100_000):
        got = grouped(rows, ["a", "b"], F.col("v"), ASKED, [F.count(F.lit(1)).alias("n")], limit)
        assert got.columns == want.columns
        assert near(got) == near(want)


def test_without_keys(rows):
    want = rows.agg(*(F.percentile("v", p).alias(k) for k, p in ASKED.items()))
    assert near(grouped(rows, [], F.col("v"), ASKED, limit=100)) == near(want)
    assert near(grouped(rows.where("false"), [], F.col("v"), ASKED, limit=100)) == near(want.select(*(F.lit(None).alias(k) for k in ASKED)))


def test_values_of_every_size(spark):
    rng = random.Random(5)
    wide = [rng.choice((-1, 1)) * 2 ** rng.uniform(-1074, 1023) for _ in range(1500)]
    ends = [float("inf"), float("-inf"), float("nan"), 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, 0.0] * 5
    beside = [1 + k * 2.0**-52 for k in range(900)] + [1e300] * 3 + [-1.0]
    sums = [2.0**53 + 2 * k for k in range(700)] + [-(2.0**53) - 2 * k for k in range(700)]
    data = [(a, v) for a, values in (("wide", wide + ends), ("beside", beside), ("sums", sums)) for v in values]
    df = spark.createDataFrame(data, "a string, v double").repartition(5)
    want = df.groupBy("a").agg(*(F.percentile("v", p).alias(k) for k, p in ASKED.items()))
    for limit in (3, 200):
        assert sorted(map(str, grouped(df, ["a"], F.col("v"), ASKED, limit=limit).collect())) == sorted(map(str, want.collect()))


def test_no_task_reads_more_than_counts_of_parts(spark):
    asked, n, maps, keys = {"q10": 0.1, "median": 0.5}, 400_000, 4, 2
    df = spark.range(0, n, 1, maps).select((F.col("id") % keys).alias("a"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 7).alias("v"))
    want = df.groupBy("a").agg(*(F.percentile("v", p).alias(k) for k, p in asked.items()))
    assert most_read(spark, lambda: grouped(df, ["a"], F.col("v"), asked, limit=1000), near(want)) <= maps * keys * 2 * len(asked) * (PARTS + 1)


def test_one_buffer_serves_all_quantiles(spark):
    df = spark.range(0, 40_000, 1, 4).select((F.col("id") % 2).alias("a"), (F.pmod(F.col("id") * 7919, F.lit(40_000)) / 7).alias("v"))
    read = {}
    for asked in ({"q25": 0.25}, ASKED):
        want = near(df.groupBy("a").agg(*(F.percentile("v", p).alias(k) for k, p in asked.items())))
        read[len(asked)] = most_read(spark, lambda: grouped(df, ["a"], F.col("v"), asked), want, "localBytesRead")  # noqa: B023
    assert read[len(ASKED)] <= 1.5 * read[1]


def most_read(spark, query, want, what="recordsRead"):
    """Of all stages of a query with the rows `want`, the most rows that a task reads from shuffles, or their bytes."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "most_read")
    try:
        assert near(query()) == want
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    store, seen = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds if seen.getStageInfo(s).numCompletedTasks}
    tasks = [store.taskList(s, 0, 1000) for s in stages]
    return max(getattr(t.apply(i).taskMetrics().get().shuffleReadMetrics(), what)() for t in tasks for i in range(t.size()))
