"""Formulas as SQL text, for the registered queries' counterparts in engines without the error function."""

from __future__ import annotations

import math

from locusloom.functions.stats import FRACTION_LEVELS, HALF_LN_2PI, SERIES_TERMS, SPLIT


def mills(z: str) -> str:
    centre = "1.0::double"
    for k in range(SERIES_TERMS, 0, -1):
        centre = f"({centre}*{z}*{z}/{2 * k + 1}+1)"
    tail = z
    for k in range(FRACTION_LEVELS, 0, -1):
        tail = f"({k}/{tail}+{z})"
    return f"(case when {z}<{SPLIT} then exp({z}*{z}/2)*{math.sqrt(math.pi / 2)!r}::double-{z}*{centre} else 1/{tail} end)"


def log_upper_tail(z: str) -> str:
    return f"(-{z}*{z}/2-{HALF_LN_2PI!r}::double+ln({mills(z)}))"


def two_sided_lp(z: str) -> str:
    return f"(-({log_upper_tail(z)}+ln(2::double))/ln(10::double))"


def chi2_lp(x: str, df: str, root: str) -> str:
    """For one to three degrees."""
    one = f"(-{x}/2-{HALF_LN_2PI!r}::double+ln(2*{mills(root)}))"
    three = f"(-{x}/2-{HALF_LN_2PI!r}::double+ln(2*{mills(root)}+2*{root}))"
    return f"(-(case {df} when 1 then {one} when 2 then -{x}/2 when 3 then {three} end)/ln(10::double))"
