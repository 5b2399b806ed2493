"""Row filters: expressions, FILTER gates, samples."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A literal in either kind of quotes, and what is written otherwise in Spark SQL.
LITERAL = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
NOTATION = ((r"\b(?:FORMAT|FMT|INFO)/", ""), (r"&&?", " and "), (r"\|\|?", " or "), (r"\bN_ALT\b", "(size(alleles) - 1)"))


def condition(expression: str) -> Column:
    """A filter in the usual notation (&&, ||, ==, FORMAT/ES, INFO/AF, N_ALT) as a Column; the rest is Spark SQL.

    Literals are left as they are. ``SUM(x)`` adds up an array.
    """
    pieces = re.split(f"({LITERAL})", expression)
    for i in range(0, len(pieces), 2):
        for old, new in NOTATION:
            pieces[i] = re.sub(old, new, pieces[i])
        pieces[i] = re.sub(r"(?i)\bsum\((\w+)\)", r"aggregate(\1, 0d, (a, x) -> a + coalesce(x, 0))", pieces[i])
    return F.expr("".join(pieces))


def select_rows(rows: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Rows where ``include`` holds, or where ``exclude`` doesn't (unknown counts as not holding)."""
    if include and exclude:
        raise ValueError("include and exclude exclude each other")
    if include:
        return rows.where(condition(include))
    return rows.where(~F.coalesce(condition(exclude), F.lit(False))) if exclude else rows


def apply_filters(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows whose filters hold one of ``names``; "." stands for none."""
    gate = F.arrays_overlap("filters", F.lit(list(names)))
    return rows.where(gate | (F.coalesce(F.size("filters"), F.lit(0)) == 0)) if "." in names else rows.where(gate)


def select_samples(rows: DataFrame, samples: Sequence[str], column: str = "sample", exclude: bool = False, force: bool = False, known: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``samples``, or of the others; unknown samples are an error unless forced."""
    if known is not None and not force and (missing := set(samples) - set(known)):
        raise ValueError(f"unknown samples {sorted(missing)}")
    own = F.col(column).isin(list(samples))
    return rows.where(~own if exclude else own)
