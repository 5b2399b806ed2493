"""Delimited summary statistics with headers of many dialects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The codes that headers are turned into.
CANONICAL = ("SNP", "BP", "CHR", "A1", "A2", "P", "Z", "OR", "BETA", "N", "N_CAS", "N_CON", "INFO", "FRQ", "A*", "SE", "LP", "AC", "NEFF", "NEFFDIV2", "HET_I2", "HET_P", "HET_LP", "DIRE")

#: Headers of known programs and what they mean.
PRESETS: dict[str, dict[str, str]] = {
    "PLINK": {"SNP": "SNP", "BP": "BP", "CHR": "CHR", "A1": "A1", "A2": "A2", "P": "P", "OR": "OR", "BETA": "BETA", "INFO": "INFO", "F_U": "FRQ", "FRQ": "FRQ", "SE": "SE"},
    "PLINK2": {"ID": "SNP", "POS": "BP", "CHROM": "CHR", "A1": "A1", "AX": "A2", "P": "P", "Z_STAT": "Z", "OR": "OR", "BETA": "BETA", "MACH_R2": "INFO", "A1_FREQ": "FRQ", "SE": "SE", "LOG(OR)_SE": "SE", "LOG10_P": "LP"},
    "REGENIE": {"ID": "SNP", "GENPOS": "BP", "CHROM": "CHR", "ALLELE1": "A1", "BETA": "BETA", "N": "N", "N_CASES": "N_CAS", "N_CONTROLS": "N_CON", "INFO": "INFO", "A1FREQ": "FRQ", "ALLELE0": "A2", "SE": "SE", "LOG10P": "LP", "AC_ALLELE1": "AC"},
    "SAIGE": {"SNPID": "SNP", "markerID": "SNP", "POS": "BP", "CHR": "CHR", "Allele2": "A1", "Allele1": "A2", "p.value": "P", "BETA": "BETA", "N": "N", "N_case": "N_CAS", "N_ctrl": "N_CON", "imputationInfo": "INFO", "AF_Allele2": "FRQ", "SE": "SE", "AC_Allele2": "AC"},
    "BOLT": {"SNP": "SNP", "BP": "BP", "CHR": "CHR", "ALLELE1": "A1", "P_LINREG": "P", "P_BOLT_LMM_INF": "P", "P_BOLT_LMM": "P", "BETA": "BETA", "A1FREQ": "FRQ", "ALLELE0": "A2", "SE": "SE"},
    "METAL": {"MarkerName": "SNP", "Position": "BP", "Chromosome": "CHR", "Allele1": "A1", "Allele2": "A2", "P-value": "P", "Zscore": "Z", "Effect": "BETA", "N": "N", "Freq1": "FRQ", "StdErr": "SE", "log(P)": "LP", "Weight": "NEFF", "HetISq": "HET_I2", "HetPVal": "HET_P", "logHetP": "HET_LP", "Direction": "DIRE"},
    "PGS": {"chr_name": "CHR", "chr_position": "BP", "rsID": "SNP", "effect_allele": "A1", "other_allele": "A2", "OR": "OR", "HR": "OR", "effect_weight": "BETA", "allelefrequency_effect": "FRQ"},
    "SSF": {"chromosome": "CHR", "base_pair_location": "BP", "variant_id": "SNP", "rsid": "SNP", "rs_id": "SNP", "effect_allele": "A1", "other_allele": "A2", "p_value": "P", "odds_ratio": "OR", "hazard_ratio": "OR", "beta": "BETA", "n": "N", "info": "INFO", "effect_allele_frequency": "FRQ", "standard_error": "SE"},
}
PRESETS["GWAS-SSF"] = PRESETS["SSF"]


def synonyms(preset: str | None = None, path: str | None = None) -> dict[str, str]:
    """Header synonyms in lower case, of a preset or of a file of header-tab-canonical lines."""
    if (preset is None) == (path is None):
        raise ValueError("give a preset or a file of synonyms")
    if preset is not None:
        if preset.upper() not in PRESETS:
            raise ValueError(f"unknown preset {preset}")
        return {k.lower(): v for k, v in PRESETS[preset.upper()].items()}
    out = {}
    lines = SparkSession.builder.getOrCreate().read.text(path).collect()  # a line for each header name
    for (line,) in lines:
        name, tab, code = line.partition("\t")
        if not tab:
            raise ValueError(f"no tab in the line {name!r}")
        if code in CANONICAL:
            out[name.lower()] = code
    return out


def listed(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small list file: names of inputs, or of samples."""
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]


def sample_choice(names: str) -> tuple[list[str], bool]:
    """A comma-separated list of samples, and whether a leading ^ excludes them."""
    return [n for n in names.removeprefix("^").split(",") if n], names.startswith("^")


def header_fields(line: str, strip_suffix: bool = True) -> tuple[list[str], str]:
    """Column names and the delimiter (a regular expression) of a header line."""
    if line.startswith("#"):
        line = line[1:]
    if strip_suffix:
        line = re.sub(r"_\d+(?=\s|,|$)", "", line)
    delimiter = "\t" if "\t" in line else "," if "," in line else r"\s+"
    return re.split(delimiter, line.strip("\r\n") if delimiter != r"\s+" else line.strip()), delimiter


def read_summary(spark: SparkSession, path: str, strip_suffix: bool = True) -> DataFrame:
    """All columns of a summary file as strings, in file order; see :func:`parse_lines`."""
    return parse_lines(spark.read.text(path), strip_suffix)


def parse_lines(lines: DataFrame, strip_suffix: bool = True) -> DataFrame:
    """All columns of the lines (value) of a summary file as strings; short rows have nulls.

    The header is the first line that is no comment; #CHROM and #ID begin headers too. A column named ``-`` and
    repeated names but the last are left out.
    """
    is_header = ~F.startswith("value", F.lit("#")) | F.col("value").rlike("^#(CHR|ID)")
    head = lines.where(is_header & (F.length(F.trim("value")) > 0)).first()
    if head is None:
        raise ValueError("no header")
    names, delimiter = header_fields(head[0], strip_suffix)
    row = F.trim("value") if delimiter == r"\s+" else F.col("value")
    fields = F.split(row, delimiter)
    last = {n: i for i, n in enumerate(names) if n != "-"}
    body = lines.where(~F.startswith("value", F.lit("#")) & (F.col("value") != head[0]) & (F.length(F.trim("value")) > 0))
    return body.select(*[F.get(fields, F.lit(i)).alias(n) for n, i in last.items()])


def bind(columns: list[str], codes: dict[str, str]) -> dict[str, str]:
    """Canonical code to column; the rightmost column of a code counts."""
    out = {codes[c.lower()]: c for c in columns if c.lower() in codes}
    if not out:
        raise ValueError("no column is known")
    return out
