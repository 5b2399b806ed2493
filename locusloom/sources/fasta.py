"""Reference sequences as a table of chunks: (contig, chunk, seq).

A chunk's seq goes on into the next chunk by ``overlap`` bases, so that a fetch of up to that length from any
position needs one chunk: an equi-join on contig and chunk number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.sources.lines import AT, SPLIT, split_lines, with_running

CHUNK, OVERLAP = 1 << 16, 1024
#: Bases of chunks that leave a Python worker together.
BATCH = 1 << 24


def chunked(contigs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of a table (contig, seq) with a row for each contig; bases beyond ACGT become N."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for contig, seq in zip(batch.contig, batch.seq, strict=True):
                for first in range(0, len(seq), chunk):
                    held.append((contig, first // chunk, seq[first : first + chunk + overlap]))
                    size += len(held[-1][2])
                    if size >= BATCH:
                        yield pd.DataFrame(held, columns=["contig", "chunk", "seq"])
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["contig", "chunk", "seq"])

    clean = F.regexp_replace(F.upper("seq"), "[^ACGT]", "N")
    return contigs.select("contig", clean.alias("seq")).mapInPandas(cut, "contig string, chunk int, seq string")


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of a file's sequences. Each line is placed in its contig by sums over the splits before it, so that no task or row
    holds a contig; a line is a row, so sequences should be in lines, as they usually are.
    """
    head = F.startswith("value", F.lit(">"))
    bases = F.regexp_replace(F.upper("value"), r"\s", "")
    lines = split_lines(spark, path).select(*SPLIT, AT, head.alias("_head"), F.when(head, F.regexp_extract("value", r"^>\s*(\S+)", 1)).alias("_name"), F.when(~head, F.regexp_replace(bases, "[^ACGT]", "N")).alias("_seq"))
    length = F.coalesce(F.length("_seq"), F.lit(0)).cast("long")
    placed = with_running(lines, _contig=F.col("_head").cast("long"), _end=length)
    names = placed.where("_head").select("_contig", F.col("_name").alias("contig"), F.col("_end").alias("_from"))  # a row for each contig
    placed = placed.where("not _head").select("_contig", "_seq", "_end").join(names, "_contig").withColumn("_start", F.col("_end") - F.length("_seq") - F.col("_from"))
    # A chunk's overlap is the next one's beginning: the line goes to all chunks that hold some of it.
    first = F.greatest(F.floor((F.col("_start") - overlap) / chunk), F.lit(0))
    last = F.floor((F.col("_start") + F.length("_seq") - 1) / chunk)
    pieces = placed.where(F.length("_seq") > 0).withColumn("chunk", F.explode(F.sequence(first, last)))
    low, high = F.col("chunk") * chunk, F.col("chunk") * chunk + chunk + overlap
    at = F.greatest(low, F.col("_start"))
    piece = F.substr("_seq", (at - F.col("_start") + 1).cast("int"), (F.least(high, F.col("_start") + F.length("_seq")) - at).cast("int"))
    pieces = pieces.where((F.col("_start") < high) & (F.col("_start") + F.length("_seq") > low)).select("contig", F.col("chunk").cast("int").alias("chunk"), at.alias("_at"), piece.alias("_piece"))
    held = pieces.groupBy("contig", "chunk").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_x"))  # a chunk's bases
    return held.select("contig", "chunk", F.array_join(F.transform("_x", lambda p: p["_piece"]), "").alias("seq"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length) of a FASTA index."""
    return spark.read.csv(path, sep="\t", schema="contig string, length long, offset long, line_bases int, line_width int").select("contig", "length")


def with_reference(rows: DataFrame, fasta: DataFrame, start: Column, length: Column, out: str, chunk: int = CHUNK, contig: str = "chrom", short: bool = False) -> DataFrame:
    """Add ``out``: ``length`` bases from 1-based ``start``; null where the sequence doesn't reach, or, if ``short``, what there is.

    Both sides are shuffled by chunk: what chunks weigh can't be told from the rows that they are made of, so no estimate may send them through the driver.
    """
    seqs = fasta.select(F.col("contig").alias("_contig"), F.col("chunk").alias("_chunk"), F.col("seq").alias("_seq")).hint("merge")
    keyed = rows.withColumn("_start", start).withColumn("_len", length)
    joined = keyed.join(seqs, (F.col(contig) == F.col("_contig")) & (F.floor((F.col("_start") - 1) / chunk).cast("int") == F.col("_chunk")), "left")
    # Bases are a byte each: of bytes a piece is cut at once, of text the whole chunk is walked through.
    piece = F.substring(F.col("_seq").cast("binary"), ((F.col("_start") - 1) % chunk + 1).cast("int"), F.col("_len").cast("int")).cast("string")
    return joined.withColumn(out, piece if short else F.when(F.length(piece) == F.col("_len"), piece)).drop("_contig", "_chunk", "_seq", "_start", "_len")
