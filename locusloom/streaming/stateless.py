"""Row-wise operators on streams: a stream of rows goes through the same functions as a table.

Munging without a reference, point liftover against static blocks and score sums need no state but sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def lift_stream(rows: DataFrame, blocks: DataFrame, bin_size: int = 1 << 16) -> DataFrame:
    """Point liftover of a stream: a row for each row, by the last block in file order that holds its position, as for a table."""
    kept = F.struct("chain_ind", "block_ind", "b_start", "b_end", "b_q", "q_chrom", "q_size", "q_strand")
    every = F.sequence(F.floor(F.col("b_start") / bin_size), F.floor(F.col("b_end") / bin_size))
    bins = blocks.select("b_chrom", kept.alias("_block"), F.explode(every).alias("_bin"))
    bins = bins.groupBy("b_chrom", "_bin").agg(F.array_sort(F.collect_list("_block")).alias("_blocks"))  # no more than a bin has bases, but for overlaps
    at = F.col("pos") - 1
    joined = rows.join(bins, (F.col("chrom") == F.col("b_chrom")) & (F.floor(at / bin_size) == F.col("_bin")), "left")
    hits = F.filter("_blocks", lambda b: at.between(b["b_start"], b["b_end"]))
    off = at - F.col("_at.b_start")
    q = F.when(F.col("_at.q_strand") == 0, F.col("_at.b_q") + off + 1).otherwise(F.col("_at.q_size") - F.col("_at.b_q") - off)
    own = [F.col(c) for c in rows.columns]
    return joined.select(*own, F.get(F.reverse(hits), F.lit(0)).alias("_at")).select(*own, "_at.q_chrom", q.alias("q_pos"), "_at.q_strand")


def score_stream(each: DataFrame) -> DataFrame:
    """Running scores of a stream of (sample, prs, es, dosage)."""
    return each.groupBy("sample", "prs").agg(F.sum(F.col("es") * F.col("dosage")).alias("score"))


def write(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append a stream to Parquet, all that is there in one go."""
    out = transform(stream) if transform else stream
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
