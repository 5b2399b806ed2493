r"""WARC archives written and read with Spark's own text source.

Writing: one record per page, the payload its html in UTF-8. Among records with equal payloads of at
least ``min_dedup_bytes`` bytes the one with the least page_id is a response and the others are
revisits with an empty block, which refer to it.

Reading: the text source cuts files at the magic ``WARC/1.0\r\n``, so that tasks see every place
where a record may begin, in blocks of any file that can be split. These fragments are written to the shared folder
once and read from there, as another scan might cut the files into other blocks. A payload may hold the magic too.
So each candidate tells its successor's offset from its Content-Length, and the boundary chain is
verified: candidates whose successor is the very next one are contracted into runs, and pointer jumping
over the runs, from the start of each file, keeps those that the chain reaches and the offset where it
enters them. Whatever lies within payloads isn't reached.

Defined results: a null html is empty, a null url too; rows that share a page_id and a payload
are all responses if theirs is the least page_id; a null page_id counts as larger than any and is
read back as null; a record whose block is not as long as its header tells, as in an archive that was cut short, is returned
with ``sound`` false and no digest; CR and LF in urls are percent-encoded; an empty table gives an archive without
records; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusloom.llm.common import cut, shared_dir

MAGIC = "WARC/1.0\r\n"
_URN = "urn:page:"
#: Digests that repeat are broadcast up to this number.
BROADCAST_ROWS = 1_000_000


def base32_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the payload's SHA-1."""
    digits = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _with_first(rows: DataFrame) -> DataFrame:
    """Add ``first``, the least page_id of the records with an equal payload, to those that have any.

    What is shuffled are digests; pages are only where more digests repeat than can be broadcast, and then by page_id too, so
    that a payload of many pages is no hot key.
    """
    keys = rows.where("dedup").groupBy(F.col("digest").alias("_d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    keys = cut(keys.where("n > 1").drop("n"))
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), (F.col("digest") == F.col("_d")) & F.col("dedup"), "left")
    pairs = rows.where("dedup").select(F.col("page_id").alias("_i"), F.col("digest").alias("_d")).distinct().join(keys, "_d")
    return rows.join(pairs, F.col("page_id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d")) & F.col("dedup"), "left")


def write_warc(
    pages: DataFrame,
    path: str,
    min_dedup_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
    records_per_file: int = 20_000,
    compression: str = "gzip",
) -> None:
    """Write an archive of records into the folder ``path``; with ``compression`` "none" its files can be split."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_digest(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    rows = _with_first(rows.withColumn("dedup", F.col("bytes") >= min_dedup_bytes))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path, compression=compression)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, ord, value) of what stands between magics, from one scan that is written down."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    found = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ord"),
        "value",
    )
    at = f"{shared_dir(spark)}/fragments-{uuid.uuid4().hex}"
    found.write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


def _parsed(df: DataFrame) -> DataFrame:
    """Header fields of ``value`` (what follows a magic), its bytes and payload."""
    df = df.withColumn("_p", F.instr("value", "\r\n\r\n")).withColumn("_head", F.when(F.col("_p") > 0, F.concat(F.lit("\r\n"), F.expr("substring(value, 1, _p - 1)"))))
    field = lambda name: F.nullif(F.regexp_extract("_head", rf"(?i)\r\n{name}: *([^\r\n]*)", 1), F.lit(""))
    df = df.withColumn("_body", F.expr("substring(value, _p + 4)"))
    return (
        df.withColumn("length", F.expr("try_cast(nullif(regexp_extract(_head, '(?i)\\r\\nContent-Length: *([0-9]+)', 1), '') as bigint)"))
        .withColumn("head_bytes", F.octet_length("_head").cast("long") + 2)
        .withColumn("whole", F.coalesce((F.octet_length("_body") == F.col("length") + 4) & F.endswith("value", F.lit("\r\n\r\n")), F.lit(False)))
        .withColumn("payload", F.when(F.col("whole"), F.expr("left(_body, length(_body) - 4)")))
        .withColumn("type", field("WARC-Type"))
        .withColumn("id", field("WARC-Record-ID"))
        .withColumn("url", field("WARC-Target-URI"))
        .withColumn("told_digest", F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""))
        .withColumn("told_bytes", F.expr("try_cast(nullif(regexp_extract(_head, '(?i)\\r\\nX-Payload-Length: *([0-9]+)', 1), '') as bigint)"))
        .withColumn("refers", field("WARC-Refers-To"))
        .drop("_p", "_head", "_body")
    )


def _reached(nodes: DataFrame) -> DataFrame:
    """Those nodes (file, block, at, next) that the chain from each file's start reaches."""
    order = Window.partitionBy("file", "block").orderBy("at")
    ends = ~F.coalesce(F.lead("at").over(order) == F.col("next"), F.lit(False))
    runs = nodes.withColumn("_ends", ends.cast("int"))
    runs = runs.withColumn("_run", F.coalesce(F.sum("_ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = cut(runs.withColumn("lo", F.min("at").over(Window.partitionBy("file", "block", "_run"))))
    exits = runs.where("_ends = 1").select("file", "lo", F.col("next").alias("entry"))
    entries = runs.select("file", F.col("at").alias("entry"), F.col("lo").alias("to"))
    jumps = exits.join(entries, ["file", "entry"]).where("entry > lo").select("file", "lo", "to", "entry")
    reach = runs.where("at = 0").select("file", "lo", F.col("at").alias("entry"))
    n = -1
    while True:
        jumps, reach = cut(jumps), cut(reach)
        if (now := reach.count()) == n:
            break
        n = now
        step = reach.select("file", "lo").join(jumps, ["file", "lo"]).select("file", F.col("to").alias("lo"), "entry")
        reach = reach.unionByName(step).groupBy("file", "lo").agg(F.min("entry").alias("entry"))
        jumps = jumps.alias("a").join(jumps.select("file", F.col("lo").alias("to"), F.col("to").alias("_to"), F.col("entry").alias("_entry")), ["file", "to"])
        jumps = jumps.select("file", "lo", F.col("_to").alias("to"), F.col("_entry").alias("entry"))
    return runs.join(reach, ["file", "lo"]).where("at >= entry").select("file", "block", "at", "next")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: file, at, type, id, url, refers, told_digest, told_bytes, length, payload_digest, payload_bytes, sound.

    The digest is of the block as it was read; ``sound`` tells whether that is as long as the header says.
    """
    fragments = _fragments(spark, path)
    skinny = _parsed(fragments).select(
        "file", "block", "ord", (F.octet_length("value") + len(MAGIC)).cast("long").alias("size"),
        "length", "head_bytes", "whole", "type", "id", "url", "told_digest", "told_bytes", "refers",
        F.when(F.col("whole"), base32_digest(F.col("payload"))).alias("payload_digest"),
    )
    skinny = cut(skinny)
    # Offsets: sizes before a fragment within its block, and those of the blocks before.
    within = Window.partitionBy("file", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    blocks = skinny.groupBy("file", "block").agg(F.sum("size").alias("_size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    placed = skinny.withColumn("_local", F.coalesce(F.sum("size").over(within), F.lit(0))).join(blocks, ["file", "block"])
    placed = placed.withColumn("at", F.col("_before") + F.col("_local") - len(MAGIC)).where("at >= 0")  # what precedes the first magic is none
    placed = cut(placed.withColumn("next", F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("length") + 4).drop("_local", "_before"))
    reached = cut(_reached(placed.where("next is not null").select("file", "block", "at", "next")))
    fields = ["file", "at", "type", "id", "url", "refers", "told_digest", "told_bytes", "length", "payload_digest"]
    found = placed.join(reached.select("file", "at"), ["file", "at"])
    out = found.where("whole").select(*fields, F.lit(True).alias("sound"))
    split = cut(found.where("not whole").select("file", "at", "next"))
    if not split.isEmpty():
        # Payloads that hold the magic are put together from their fragments.
        marked = placed.select("file", "block", "ord", "at").join(split.select("file").distinct(), "file", "left_semi")
        marked = marked.join(reached.select("file", "at", F.col("at").alias("_r"), "next"), ["file", "at"], "left")
        so_far = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        marked = marked.withColumn("owner", F.last("_r", ignorenulls=True).over(so_far)).withColumn("end", F.last("next", ignorenulls=True).over(so_far))
        marked = marked.join(split.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi").where("at < end")
        pieces = fragments.join(marked.select("file", "block", "ord", "at", "owner"), ["file", "block", "ord"])
        joined = pieces.groupBy("file", F.col("owner")).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_x"))
        joined = joined.select("file", F.col("owner").alias("at"), F.array_join(F.transform("_x", lambda x: x["value"]), MAGIC).alias("value"))
        again = _parsed(joined).withColumn("payload_digest", F.when(F.col("whole"), base32_digest(F.col("payload"))))
        out = out.unionByName(again.select(*fields, F.col("whole").alias("sound")))
    return out.withColumn("payload_bytes", F.col("length"))


def archive_digest(pages: DataFrame, path: str | None = None, min_dedup_bytes: int = 0) -> DataFrame:
    """Write ``pages`` and read them back: a row for each record.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to; sound is whether a
    response's payload has the digest and length that its header tells.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_dedup_bytes)
    records = read_warc(spark, path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<{_URN}(-?[0-9]+)>', 1) as bigint)")
    response = F.col("type") == "response"
    return records.select(
        number("id").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.when(response, F.col("payload_bytes")).otherwise(F.col("told_bytes")).alias("payload_bytes"),
        F.when(response, F.col("payload_digest")).otherwise(F.col("told_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers").alias("refers_to"),
        (F.col("sound") & (~response | F.coalesce((F.col("payload_digest") == F.col("told_digest")) & (F.col("payload_bytes") == F.col("told_bytes")), F.lit(False)))).alias("sound"),
    )
