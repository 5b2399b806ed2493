from pyspark.sql import functions as F

from locusloom.operators import liftover, score
from locusloom.streaming import stateless
from tests.test_liftover import blocks


def test_point_liftover_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k, "c", 10 * k) for k in range(1, 30)], "k int, chrom string, pos long")
    rows.write.parquet(f"{tmp_path}/in")
    b = blocks(spark, [(0, 0, "c", 0, 99, 7, "d", 1000, 0), (0, 1, "c", 150, 250, 900, "d", 1000, 1)])
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    stateless.write(stream, f"{tmp_path}/out", f"{tmp_path}/cp", lambda s: stateless.lift_stream(s, b)).awaitTermination()
    got = {r.k: r.q_pos for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.k: r.q_pos for r in liftover.lift_points(rows, b).collect()}


def test_overlapping_blocks_of_a_stream(spark, tmp_path):
    """A position in two blocks is lifted once, by the later one, and an unmapped row stays."""
    rows = spark.createDataFrame([(k, "c", 20 * k) for k in range(1, 12)], "k int, chrom string, pos long")
    rows.write.parquet(f"{tmp_path}/in")
    b = blocks(spark, [(0, 0, "c", 0, 119, 7, "d", 1000, 0), (1, 0, "c", 80, 150, 600, "e", 1000, 1)])
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    stateless.write(stream, f"{tmp_path}/out", f"{tmp_path}/cp", lambda s: stateless.lift_stream(s, b)).awaitTermination()
    at = lambda df: sorted((r.k, r.q_chrom, r.q_pos, r.q_strand) for r in df.collect())
    assert at(spark.read.parquet(f"{tmp_path}/out")) == at(liftover.lift_points(rows, b))


def test_running_scores(spark, tmp_path):
    each = spark.createDataFrame([(s, "p", 0.5 * s, float(d)) for s in range(3) for d in range(4)], "sample int, prs string, es double, dosage double")
    each.write.parquet(f"{tmp_path}/in")
    stream = stateless.score_stream(spark.readStream.schema(each.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {r["sample"]: r.score for r in score.sums(each.withColumn("lp", F.lit(1.0))).collect()}
    assert {r["sample"]: r.score for r in spark.table("running").collect()} == want
