"""Text VCF as tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
#: Numeric FORMAT fields of association files, a value for each alternative.
NUMBERS = ("NS", "EZ", "SI", "NC", "ES", "SE", "LP", "AF", "AC", "NE", "I2", "CQ")


def samples_of(spark: SparkSession, path: str) -> list[str]:
    head = spark.read.text(path).where(F.startswith("value", F.lit("#CHROM"))).first()
    return head[0].split("\t")[9:] if head else []


def read_associations(spark: SparkSession, path: str) -> DataFrame:
    """Tidy association rows of a VCF whose samples are studies: one for each alternative and study.

    A field has a value for each alternative, or one that holds for all; other numbers of values are an error.
    """
    samples = samples_of(spark, path)
    records = read_records(spark, path)
    alts = F.slice("alleles", F.lit(2), F.greatest(F.size("alleles") - 1, F.lit(0)))
    studies = F.arrays_zip(F.lit(samples).alias("study"), F.slice("cells", 1, len(samples)).alias("values"))
    rows = records.select("chrom", "pos", "id", "ref", "filters", "keys", F.size(alts).alias("_n"), studies.alias("_studies"), F.posexplode_outer(alts).alias("_i", "alt"))
    rows = rows.select("*", F.explode("_studies").alias("_s")).withColumn("_v", F.split("_s.values", ":"))

    def value(key: str) -> Column:
        text = F.get("_v", (F.array_position("keys", key) - 1).cast("int"))
        parts = F.split(text, ",")
        wrong = F.raise_error(F.concat(F.lit(f"{key}: not as many values as alternatives at "), "chrom", F.lit(":"), F.col("pos").cast("string")))
        one = F.when(F.size(parts) == F.greatest("_n", F.lit(1)), F.get(parts, F.coalesce("_i", F.lit(0)))).when(F.size(parts) == 1, F.get(parts, F.lit(0)))
        return _missing(F.when(text.isNotNull(), F.coalesce(one, wrong)))

    columns = ["chrom", "pos", "id", "ref", F.coalesce("alt", F.lit(".")).alias("alt"), "filters", F.col("_s.study").alias("study")]
    return rows.select(*columns, *[value(k).try_cast("double").alias(k.lower()) for k in NUMBERS], value("ED").alias("ed"))


#: FORMAT fields of genotypes and their element types; AS is a column as_.
GENOTYPE_FIELDS = {"GT": "int", "DS": "double", "HDS": "double", "AP1": "double", "AP2": "double", "GP": "double", "AS": "int"}
#: INFO fields of LD tables, their columns and types.
LD_FIELDS = {
    "AA": ("aa", "int"),
    "AF": ("af", "double"),
    "LD_block": ("ld_block", "int"),
    "LD_node": ("ld_node", "int"),
    "LD_diagonal": ("ld_diagonal", "double"),
    "LD_neighbors": ("ld_neighbors", "array<int>"),
    "LD_weights": ("ld_weights", "array<double>"),
}


def declared(spark: SparkSession, path: str) -> dict[str, set[str]]:
    """The INFO, FORMAT and FILTER names that the header declares."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("##")))
    kind, name = (F.regexp_extract("value", r"^##(INFO|FORMAT|FILTER)=<ID=([^,>]+)", i) for i in (1, 2))
    out: dict[str, set[str]] = {"INFO": set(), "FORMAT": set(), "FILTER": set()}
    for k, n in lines.select(kind, name).where("value like '##%=<ID=%'").distinct().collect():  # a header's lines
        if k:
            out[k].add(n)
    return out


def numbers(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """The Number that the header declares for each INFO and FORMAT tag."""
    out: dict[str, dict[str, str]] = {"INFO": {}, "FORMAT": {}}
    for line in header(spark, path):
        if found := re.match(r"##(INFO|FORMAT)=<ID=([^,>]+),Number=([^,>]+)", line):
            out[found[1]].setdefault(found[2], found[3])
    return out


def header(spark: SparkSession, path: str) -> list[str]:
    """The header's lines, in order, without that of the columns."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("##"))).withColumn("_at", F.monotonically_increasing_id())
    return [r[0] for r in lines.groupBy("value").agg(F.min("_at").alias("_at")).orderBy("_at").select("value").collect()]  # a header


def check_associations(spark: SparkSession, path: str, sizes_given: bool = False) -> None:
    """Fail unless the header declares effects (EZ, or ES with SE or LP) and, unless they are given, sample sizes (NE or NS)."""
    have = declared(spark, path)["FORMAT"]
    if "EZ" not in have and not ("ES" in have and {"SE", "LP"} & have):
        raise ValueError(f"{path}: FORMAT has neither EZ, nor ES and SE, nor ES and LP")
    if not sizes_given and not {"NE", "NS"} & have:
        raise ValueError(f"{path}: FORMAT has neither NE nor NS, and no sample sizes are given")


def check_ld(spark: SparkSession, path: str) -> None:
    """Fail unless the header declares the INFO fields of an LD table."""
    if missing := sorted(set(LD_FIELDS) - declared(spark, path)["INFO"]):
        raise ValueError(f"{path}: INFO lacks {', '.join(missing)}")


def _missing(c: Column) -> Column:
    return F.when(c != ".", c)


def _numbers(text: Column, kind: str, by: str = ",") -> Column:
    """An array of a field's values; null without the field, "." gives a null element, or null if it stands alone."""
    values = F.transform(F.split(text, by), lambda x: x.try_cast(kind))
    return F.when(text.isNotNull() & (text != "."), values)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as they are: chrom, pos, id, ref, alleles, qual, filters, info (a map; flags are ""), keys and cells."""
    f = F.split("value", "\t")
    get = lambda i: F.get(f, F.lit(i))
    pair = lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("key"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("").alias("value"))
    entries = F.transform(F.filter(F.split(get(7), ";"), lambda x: ~x.isin("", ".")), pair)
    names = F.transform(entries, lambda e: e["key"])
    info = F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1))  # of a repeated key the first counts
    alleles = F.concat(F.array(get(3)), F.when(get(4) == ".", F.array().cast("array<string>")).otherwise(F.split(get(4), ",")))
    filters = F.when(get(6).isin(".", "PASS"), F.array().cast("array<string>")).otherwise(F.split(get(6), ";"))
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0))
    return lines.select(
        get(0).alias("chrom"),
        get(1).cast("long").alias("pos"),
        _missing(get(2)).alias("id"),
        get(3).alias("ref"),
        alleles.alias("alleles"),
        get(5).try_cast("double").alias("qual"),
        filters.alias("filters"),
        info.alias("info"),
        F.split(F.coalesce(get(8), F.lit("")), ":").alias("keys"),
        F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))).alias("cells"),
    )


def read_genotypes(spark: SparkSession, path: str, fields: Sequence[str] = tuple(GENOTYPE_FIELDS), phase: bool = False) -> DataFrame:
    """Records with ``samples``: structs of sample and of those ``fields`` that the header declares.

    Missing values are null; alleles of GT that are "." are null elements; a field that a record lacks is null. With
    ``phase`` samples tell whether their alleles are in order.
    """
    names = samples_of(spark, path)
    have = declared(spark, path)["FORMAT"]
    fields = [x for x in fields if x in have]

    def cell(values: Column, key: str) -> Column:
        text = F.get(values, (F.array_position("keys", key) - 1).cast("int"))
        return _numbers(text, "int", r"[/|]") if key == "GT" else text.try_cast("int") if key == "AS" else _numbers(text, GENOTYPE_FIELDS[key])

    column = lambda k: "as_" if k == "AS" else k.lower()
    order = lambda text: [F.contains(F.split_part(text, F.lit(":"), F.lit(1)), F.lit("|")).alias("phased")] if phase and "GT" in fields else []
    one = lambda name, text: F.struct(name.alias("sample"), *[cell(F.split(text, ":"), k).alias(column(k)) for k in fields], *order(text))
    samples = F.zip_with(F.lit(names), "cells", one)
    return read_records(spark, path).select("chrom", "pos", "id", "alleles", "qual", "filters", "info", samples.alias("samples"))


def read_ld(spark: SparkSession, path: str, pop: str) -> DataFrame:
    """The LD table of one population: pop, chrom, pos, ref, alt and the LD fields. Rows are checked by ``ld.checked``."""
    check_ld(spark, path)
    value = lambda k: F.try_element_at("info", F.lit(k))
    array = lambda k, kind: F.coalesce(_numbers(value(k), kind), F.array().cast(f"array<{kind}>"))
    columns = []
    for name, (out, kind) in LD_FIELDS.items():
        columns.append((array(name, kind[6:-1]) if kind.startswith("array") else value(name).try_cast(kind)).alias(out))
    return read_records(spark, path).select(F.lit(pop).alias("pop"), "chrom", "pos", "ref", F.get("alleles", F.lit(1)).alias("alt"), *columns)


def vcf_lines(rows: DataFrame, studies: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(chrom, pos, ref, alt, line): a VCF line for each variant of tidy rows."""
    text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("."))
    cells = rows.withColumn("_cell", F.concat_ws(":", *[text(f) for f in fields]))
    held = cells.groupBy("chrom", "pos", "ref", "alt").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("study", "_cell")))).alias("_m"), F.max("id").alias("_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("filters")))).alias("_f")
    )
    empty = ":".join("." for _ in fields)
    filters = F.when(F.size("_f") > 0, F.array_join("_f", ";")).otherwise("PASS")
    columns = [F.coalesce(F.try_element_at("_m", F.lit(s)), F.lit(empty)) for s in studies]
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.coalesce("_id", F.lit(".")), "ref", "alt", F.lit("."), filters, F.lit("."), F.lit(":".join(f.upper() for f in fields)), *columns)
    return held.select("chrom", "pos", "ref", "alt", line.alias("line"))


def write_vcf(rows: DataFrame, path: str, studies: Sequence[str], fields: Sequence[str], contigs: dict[str, int], program: str | None = "locusloom") -> None:
    """Sorted text VCF in parts; the header, with ``program`` as its provenance, is the first."""
    head = ["##fileformat=VCFv4.2", *([f"##source={program}"] if program else []), *(f"##contig=<ID={c},length={n}>" for c, n in contigs.items())]
    head += [f'##FORMAT=<ID={f.upper()},Number=A,Type={"String" if f == "ed" else "Float"},Description="{f}">' for f in fields]
    head.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *studies]))
    _write(vcf_lines(rows, studies, fields), head, list(contigs), path)


def _write(body: DataFrame, head: Sequence[str], contigs: Sequence[str], path: str) -> None:
    """Lines (chrom, pos, ref, alt, line) in order of contig and place, in parts, behind the header's."""
    spark = body.sparkSession
    order = F.array_position(F.lit(list(contigs)), F.col("chrom")).cast("long")
    body = body.select(F.when(order == 0, len(contigs) + 1).otherwise(order).alias("_o"), "pos", "ref", "alt", "line")
    top = spark.createDataFrame([(-1, i, "", "", h) for i, h in enumerate(head)], "_o long, pos long, ref string, alt string, line string")
    body.unionByName(top).orderBy("_o", "pos", "ref", "alt").select("line").write.text(path, compression="none")


def record_lines(records: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, line): a VCF line for each record as :func:`read_genotypes` gives it, with INFO, filters and samples."""
    told = lambda c: F.coalesce(c, F.lit("."))
    entry = lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))
    info = F.array_join(F.transform(F.map_entries("info"), entry), ";")
    alt = F.array_join(F.slice("alleles", F.lit(2), F.greatest(F.size("alleles") - 1, F.lit(0))), ",")
    filters = F.when(F.size("filters") > 0, F.array_join("filters", ";")).otherwise("PASS")
    qual = F.col("qual").cast("float").cast("string") if "qual" in records.columns else F.lit(None).cast("string")
    fields = [f for f in records.schema["samples"].dataType.elementType.fields if f.name not in ("sample", "phased")] if "samples" in records.columns else []
    ordered = "phased" in [f.name for f in records.schema["samples"].dataType.elementType.fields] if fields else False

    def cell(x: Column) -> Column:
        out = []
        for f in fields:
            value = x[f.name]
            if f.dataType.typeName() == "array":
                texts = F.transform(value, lambda v: F.coalesce(v.cast("string"), F.lit(".")))
                by = F.when(x["phased"], "|").otherwise("/") if ordered and f.name == "gt" else F.lit("/" if f.name == "gt" else ",")
                # array_join takes a fixed separator
                value = F.when(by == "|", F.array_join(texts, "|")).when(by == "/", F.array_join(texts, "/")).otherwise(F.array_join(texts, ","))
            out.append(told(value.cast("string")))
        return F.concat_ws(":", *out)

    columns = ["chrom", F.col("pos").cast("string"), told(F.col("id")) if "id" in records.columns else F.lit("."), F.get("alleles", F.lit(0)), F.when(alt == "", ".").otherwise(alt), told(qual), filters, F.when(info == "", ".").otherwise(info)]
    if fields:
        names = ":".join("AS" if f.name == "as_" else f.name.upper() for f in fields)
        columns += [F.lit(names), F.array_join(F.transform("samples", cell), "\t")]
    return records.select("chrom", "pos", F.get("alleles", F.lit(0)).alias("ref"), alt.alias("alt"), F.concat_ws("\t", *columns).alias("line"))


#: What liftover adds to INFO.
LIFT_LINES = (
    '##INFO=<ID=FLIP,Number=0,Type=Flag,Description="Alleles are those of the other strand">',
    '##INFO=<ID=SWAP,Number=1,Type=Integer,Description="Which alternative became the reference, -1 for a new one">',
    '##INFO=<ID=SRC_CHROM,Number=1,Type=String,Description="Contig before liftover">',
    '##INFO=<ID=SRC_POS,Number=1,Type=Integer,Description="Position before liftover">',
    '##INFO=<ID=SRC_REF_ALT,Number=.,Type=String,Description="Alleles before liftover">',
    '##INFO=<ID=FAIL5,Number=0,Type=Flag,Description="The first anchor needed a pad">',
    '##INFO=<ID=FAIL3,Number=0,Type=Flag,Description="The last anchor needed a pad">',
)
#: Reasons for which liftover rejects records.
REASONS = ("MissingContig", "UnmappedAnchors", "UnmappedAnchor5", "UnmappedAnchor3", "MismatchAnchors", "ApartAnchors", "MissingFasta")


def write_records(records: DataFrame, path: str, lines: Sequence[str], samples: Sequence[str], contigs: dict[str, int], program: str | None = "locusloom") -> None:
    """Records with INFO, filters, several alternatives and samples as sorted text VCF in parts.

    ``lines`` is the header to go on from: its contigs are replaced, what liftover adds is declared, and so are filters that the records have.
    """
    known = [h for h in lines if not h.startswith(("##contig=", "##source="))]
    known = known or ["##fileformat=VCFv4.2"]
    declared_ = {m[0] for h in known if (m := re.match(r"##(INFO|FORMAT|FILTER)=<ID=[^,>]+", h))}
    wanted = [*LIFT_LINES, *(f'##FILTER=<ID={r},Description="{r}">' for r in REASONS)]
    added = [h for h in wanted if re.match(r"##(INFO|FORMAT|FILTER)=<ID=[^,>]+", h)[0] not in declared_]
    head = [*known, *added, *([f"##source={program}"] if program else []), *(f"##contig=<ID={c},length={n}>" for c, n in contigs.items())]
    head.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]))
    _write(record_lines(records), head, list(contigs), path)
