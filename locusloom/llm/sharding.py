"""Sharding by size-tiered compaction under a versioned manifest.

A store is a folder with ``data``, whose Parquet files (shards) never change, and ``manifest``, with a
file for each version that names the shards in force. Appending writes an arrival as small shards,
one for each task or a few, without a shuffle, and commits a version that adds them. Compaction
looks at the shards below half of the target size, by tiers of similar size; in each it merges runs
of consecutive shards, as many as make up the target, into one file each, and commits a version that names
the new instead of the old. It reads the files of those runs and no others. A version is written aside and put in place
without overwriting: of writers that make the same version all but one fail with :class:`Conflict` and nothing of them is
seen. Readers see one version, and read the files that it names.

A shard is never larger than about the target, whatever the rows' keys are, so hot sources don't matter; each run is a task of its
own. Shards are named by version, tier and number, and the same arrivals in the same files give the same names.

Defined results: rows are kept as they are, nulls, empty texts and repeated rows included; an
empty arrival commits a version without new shards. Each version holds the store's schema: that of all arrivals together. A column
that an arrival lacks is null in its rows, whatever is merged later; one that comes with another type than before is an error, and nothing
of that arrival is seen. Columns may have any names and types: :func:`read` adds ``shard`` and ``tier``,
with underscores before them where the store has such columns itself; :func:`sharded` leaves out columns of documents
that are named ``shard``, ``tier`` or ``version``, as it leaves out the text.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from locusloom.llm.common import broadcast_if_small, cut, fresh, own_columns, shared_dir

MANIFEST = "shard string, path string, docs long, bytes long, tier int, added int"
#: A version's file has one more row, without a shard, that holds the schema.
STORED = f"{MANIFEST}, schema string"
BROADCAST_ROWS = 1_000_000


class Conflict(RuntimeError):
    """Another writer has committed the version meanwhile."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def version(spark: SparkSession, root: str) -> int:
    """The latest committed version, 0 for a new store."""
    fs, p = _fs(spark, f"{root}/manifest")
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(p)]
    return max([0, *(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())])


def manifest(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    at = version(spark, root) if at is None else at
    if at == 0:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(STORED).parquet(f"{root}/manifest/v{at}.parquet").where(F.col("shard").isNotNull()).drop("schema")


def schema_of(spark: SparkSession, root: str, at: int | None = None) -> StructType:
    """The columns of a version: those of all arrivals up to it."""
    at = version(spark, root) if at is None else at
    if at == 0:
        return StructType()
    one = spark.read.schema(STORED).parquet(f"{root}/manifest/v{at}.parquet").where("shard is null").first()
    return StructType.fromJson(json.loads(one["schema"]))


def _together(stored: StructType, arrival: StructType) -> StructType:
    """The columns of both, or an error where one has two types."""
    out = {f.name.lower(): StructField(f.name, f.dataType) for f in stored.fields}
    for f in arrival.fields:
        known = out.setdefault(f.name.lower(), StructField(f.name, f.dataType))
        if known.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {f.dataType.simpleString()}, but {known.dataType.simpleString()} in the store")
    return StructType(list(out.values()))


def _placed(spark: SparkSession, source: str, target: str) -> bool:
    """Give the file ``source`` the name ``target``, unless that exists."""
    fs, folder = _fs(spark, target.rsplit("/", 1)[0])
    fs.mkdirs(folder)
    folder = fs.resolvePath(folder)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    one, other = fs.resolvePath(_fs(spark, source)[1]), spark._jvm.org.apache.hadoop.fs.Path(folder, target.rsplit("/", 1)[1])
    try:
        if fs.getUri().getScheme() != "file":
            return fs.rename(one, other)  # a file never replaces a file
        # Local renames do replace; a hard link doesn't.
        path = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        spark._jvm.java.nio.file.Files.createLink(path(other), path(one))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def _commit(spark: SparkSession, root: str, rows: DataFrame, base: int, schema: StructType) -> int:
    """Make ``rows`` version base + 1."""
    aside = f"{root}/aside/{uuid.uuid4().hex}"
    head = spark.createDataFrame([(schema.json(),)], "schema string")
    rows.select("shard", "path", "docs", "bytes", "tier", "added").unionByName(head, allowMissingColumns=True).coalesce(1).write.parquet(aside)
    fs, folder = _fs(spark, aside)
    (part,) = [s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    done = _placed(spark, part, f"{root}/manifest/v{base + 1}.parquet")
    fs.delete(folder, True)
    if not done:
        raise Conflict(f"version {base + 1} exists")
    return base + 1


def _file(rows: DataFrame):
    return rows.metadataColumn("_metadata")["file_path"]


def _written(spark: SparkSession, root: str, commit: str, unit: int, added: int, run: str | None) -> DataFrame:
    """Manifest rows of the files of one commit, from the files' metadata; ``run`` is the folders' name."""
    files = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data/{commit}")
    files = files.select(_file(files).alias("file"), files.metadataColumn("_metadata")["file_size"].alias("bytes"))
    sizes = files.groupBy("file", "bytes").agg(F.count("*").alias("docs"))
    path = F.regexp_extract("file", "/data/([^/]*/.*)$", 1)
    part = F.regexp_extract("file", r"/part-([0-9]+)-[^/]*?(-c[0-9]+)?[^/]*$", 1)
    piece = F.regexp_extract("file", r"-(c[0-9]+)\.[^/]*$", 1)
    name = F.concat_ws("-", F.regexp_extract("file", f"/{run}=([^/]*)/", 1), piece) if run else F.concat_ws("-", part, piece)
    tier = F.floor(F.log(4.0, F.greatest(F.col("bytes") / unit, F.lit(1.0)))).cast("int")
    return sizes.select(F.concat(F.lit(f"v{added}-"), name).alias("shard"), path.alias("path"), "docs", "bytes", tier.alias("tier"), F.lit(added).alias("added"))


def append(spark: SparkSession, root: str, arrival: DataFrame, unit: int = 1 << 20, rows_per_shard: int = 200_000) -> int:
    """Write an arrival as small shards and commit it; ``unit`` is the size from which tiers count."""
    base, commit = version(spark, root), uuid.uuid4().hex
    schema = _together(schema_of(spark, root, base), arrival.schema)
    arrival.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard).parquet(f"{root}/data/{commit}")
    old = manifest(spark, root, base)
    return _commit(spark, root, old.unionByName(_written(spark, root, commit, unit, base + 1, None)), base, schema)


def _runs(shards: DataFrame, target: int, fan_in: int) -> DataFrame:
    """(path, run, name) of the shards to be merged: numbers from 0 and names of their runs."""
    order = Window.partitionBy("tier").orderBy("added", "shard")  # rows are shards, not documents
    sums = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    small = shards.where(F.col("bytes") * 2 < target).withColumn("_run", F.floor((sums - 1) / target).cast("long"))
    size = small.groupBy("tier", "_run").agg(F.count("*").alias("_n"), F.sum("bytes").alias("_b"))
    chosen = size.where((F.col("_n") >= fan_in) | ((F.col("_n") > 1) & (F.col("_b") * 2 >= target)))
    number = F.row_number().over(Window.orderBy("tier", "_run")).cast("int") - 1
    chosen = chosen.select("tier", "_run", number.alias("run"), F.concat_ws("-", F.lit("t"), "tier", "_run").alias("name"))
    return small.join(chosen, ["tier", "_run"]).select("path", "run", "name")


def _rows(spark: SparkSession, root: str, shards: DataFrame, schema: StructType, *told: str) -> DataFrame:
    """The rows of ``shards`` (path and ``told``), read from these files alone: a struct ``row`` and the columns told."""
    paths = [f"{root}/data/{r[0]}" for r in shards.select("path").toLocalIterator()]  # names of files
    files = spark.read.schema(schema).parquet(*paths)
    found = files.select(F.regexp_extract(_file(files), "/data/([^/]*/.*)$", 1).alias("path"), F.struct(*own_columns(files.columns)).alias("row"))
    return found.join(broadcast_if_small(shards, BROADCAST_ROWS), "path").select("row", *told)


def compact(spark: SparkSession, root: str, target: int = 256 << 20, fan_in: int = 4, unit: int = 1 << 20) -> int:
    """Merge runs of similarly sized shards into files of about ``target`` bytes and commit them.

    A run shorter than the target is merged if it has ``fan_in`` shards at least.
    """
    base, commit = version(spark, root), uuid.uuid4().hex
    old = cut(manifest(spark, root, base))
    plan = cut(_runs(old, target, fan_in))
    n = (plan.agg(F.max("run")).first()[0] or 0) + 1
    if plan.isEmpty():
        return base
    schema = schema_of(spark, root, base)
    rows = _rows(spark, root, plan, schema, "run", "name").repartitionById(n, "run")
    (run,) = fresh(spark.createDataFrame([], schema), "run")
    rows.select("row.*", F.col("name").alias(run)).write.partitionBy(run).option("compression", "zstd").parquet(f"{root}/data/{commit}")
    kept = old.join(plan, "path", "left_anti")
    return _commit(spark, root, kept.unionByName(_written(spark, root, commit, unit, base + 1, run)), base, schema)


def read(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """The documents of a version, with ``shard`` and ``tier``."""
    at = version(spark, root) if at is None else at
    shards, schema = manifest(spark, root, at).select("path", "shard", "tier"), schema_of(spark, root, at)
    empty = spark.createDataFrame([], schema)
    names = fresh(empty, "shard", "tier")
    if shards.isEmpty():
        return empty.withColumn(names[0], F.lit("")).withColumn(names[1], F.lit(0))
    rows = _rows(spark, root, cut(shards), schema, "shard", "tier")
    return rows.select("row.*", F.col("shard").alias(names[0]), F.col("tier").alias(names[1]))


def vacuum(spark: SparkSession, root: str, older_than: float = 7 * 86_400.0) -> None:
    """Delete the data of commits of which the latest version names no shard.

    Data newer than ``older_than`` seconds stay, as a writer may be about to commit them.
    """
    fs, p = _fs(spark, f"{root}/data")
    live = {r[0] for r in manifest(spark, root).select(F.split("path", "/")[0]).distinct().collect()}  # one for each commit
    until = (time.time() - older_than) * 1000
    for s in fs.listStatus(p):
        if s.getPath().getName() not in live and s.getModificationTime() <= until:
            fs.delete(s.getPath(), True)


def sharded(docs: DataFrame, root: str | None = None, target: int = 256 << 20, arrivals: int = 2, unit: int = 1 << 20) -> DataFrame:
    """Store ``docs`` in ``arrivals`` arrivals, compact the store and read it back.

    A row for each document, without its text: its other columns, shard (version, tier and number of the
    run, or of the arrival's file), tier and version.
    """
    spark = docs.sparkSession
    own = root is None
    root = root or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    for k in range(arrivals):
        append(spark, root, docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals)) == k), unit)
    last = compact(spark, root, target, unit=unit)
    if own:
        vacuum(spark, root, 0)  # nobody else writes here
    stored = read(spark, root, last)
    shard, tier = stored.columns[-2:]
    kept = own_columns([c for c in docs.columns if c.lower() not in ("text", "shard", "tier", "version")])
    return stored.select(*kept, F.col(shard).alias("shard"), F.col(tier).alias("tier"), F.lit(last).alias("version"))
