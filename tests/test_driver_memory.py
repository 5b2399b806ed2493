"""Neither reference sequences nor large tables of blocks pass through the driver, whatever Spark takes them to weigh."""

import re

import pytest
from pyspark.sql import functions as F

from locusloom.operators import intervals
from locusloom.plans import registry

NAMES = ("consequence_worst", "lift_extend", "lift_longer", "lift_ref_snp", "munge_harmonise", "consequences", "lift_counts", "lift_left_align", "lift_records")


def executions(spark):
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(i) for i in range(found.size())]


@pytest.mark.parametrize("name", NAMES)
def test_sequences_are_not_broadcast(spark, small, name):
    before = {e.executionId() for e in executions(spark)}
    registry.queries()[name](spark, small).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [e.physicalPlanDescription() for e in executions(spark) if e.executionId() not in before]
    assert any("_seq#" in p for p in plans)
    assert not [x for p in plans for x in re.findall(r"BroadcastExchange\nInput \[\d+\]: \[[^\]]*_seq#[^\]]*\]", p)]


def test_many_blocks_are_not_broadcast(spark):
    """A plan with several such tables took more than the driver had."""
    blocks = spark.range(300_000).select(F.lit("c").alias("b_chrom"), (F.col("id") * 10).alias("b_start"), (F.col("id") * 10 + 4).alias("b_end"), "id")
    points = spark.createDataFrame([("c", 2_999_993), ("c", 7)], "chrom string, pos long")
    found = intervals.join_points(points, blocks, [("chrom", "b_chrom")], F.col("pos"), "b_start", "b_end")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan
    assert [(r.pos, r.id) for r in found.collect()] == [(2_999_993, 299_999)]
