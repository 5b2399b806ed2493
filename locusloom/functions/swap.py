"""What becomes of allele-indexed values when the reference allele changes.

``s`` > 0 exchanges the reference with alternative s; ``s`` = -1 puts a new reference before the old alleles; ``s`` = 0
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _by(s: Column, exchanged: Column, prepended: Column, same: Column) -> Column:
    return F.when(s > 0, exchanged).when(s == -1, prepended).otherwise(same)


def _pi(i: Column, s: Column) -> Column:
    """An allele's index after 0 and s are exchanged."""
    return F.when(i == 0, s).when(i == s, F.lit(0)).otherwise(i)


def per_alt(a: Column, s: Column) -> Column:
    """Values of each alternative that don't depend on the reference."""
    return _by(s, a, F.array_prepend(a, F.lit(None)), a)


def per_allele(a: Column, s: Column) -> Column:
    """Values of each allele: those of 0 and s are exchanged."""
    return _by(s, F.transform(a, lambda x, i: F.get(a, _pi(i, s))), F.array_prepend(a, F.lit(None)), a)


def complement(a: Column, s: Column, total: Column) -> Column:
    """Values of each alternative that with the reference's add up to ``total``: counts, frequencies, dosages."""
    rest = total - F.aggregate(a, (total - total), lambda acc, x: acc + x)
    return _by(s, F.transform(a, lambda x, i: F.when(i == s - 1, rest).otherwise(x)), F.array_prepend(a, rest), a)


def effect(a: Column, s: Column) -> Column:
    """Effects against the reference: that of s is negated."""
    return _by(s, F.transform(a, lambda x, i: F.when(i == s - 1, -x).otherwise(x)), F.array_prepend(a, F.lit(None)), a)


def direction(a: Column, s: Column) -> Column:
    """Direction strings, as effects."""
    return _by(s, F.transform(a, lambda x, i: F.when(i == s - 1, F.translate(x, "+-", "-+")).otherwise(x)), F.array_prepend(a, F.lit(None)), a)


def allele_codes(a: Column, s: Column) -> Column:
    """Allele numbers, as in genotypes."""
    return _by(s, F.transform(a, lambda g: _pi(g, s)), F.transform(a, lambda g: g + 1), a)


def per_genotype(a: Column, n_alleles: Column, s: Column) -> Column:
    """Values of each genotype (a, b), a <= b, at b (b + 1) / 2 + a."""
    at = lambda x, y: (F.greatest(x, y) * (F.greatest(x, y) + 1) / 2 + F.least(x, y)).cast("int")
    pairs = lambda n: F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.transform(F.sequence(F.lit(0), b), lambda x: F.struct(x.alias("a"), b.alias("b")))))
    n = n_alleles.cast("int")
    exchanged = F.transform(pairs(n), lambda g: F.get(a, at(_pi(g["a"], s), _pi(g["b"], s))))
    prepended = F.transform(pairs(n + 1), lambda g: F.when(g["a"] > 0, F.get(a, at(g["a"] - 1, g["b"] - 1))))
    return F.when(a.isNotNull(), _by(s, exchanged, prepended, a))


#: Rules by the tags that they hold for unless told otherwise; a later rule wins where a tag has several.
DEFAULT_RULES = {"AC": ("AC",), "AF": ("AF", "AP1", "AP2"), "DS": ("DS",), "GT": ("ALLELE_A", "ALLELE_B"), "ES": ("EZ", "ES", "ED"), "DROP": (".",)}
ORDER = ("AGR", "AC", "AF", "DS", "GT", "ES", "DROP")


def assign_rules(tags: dict[str, str], rules: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """The rule of each tag; ``tags`` maps names to their Number (A, R, G or other)."""
    rules = DEFAULT_RULES | (rules or {})
    out = {t: "AGR" for t, number in tags.items() if number in ("A", "G", "R")}
    for rule in ORDER[1:]:
        out |= {t: rule for t in rules.get(rule, ()) if t in tags}
    return out


#: Tags that some imputation servers declare with a number of values where it depends on the alleles.
FIXED_NUMBERS = {"AC": ("1", "A"), "AF": ("1", "A"), "GP": ("3", "G"), "DS": ("1", "A")}


def fix_numbers(df: DataFrame, tags: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` and ``tags`` (name to Number) with wrongly declared tags made per alternative or genotype; single values become arrays."""
    wrong = {t: right for t, (old, right) in FIXED_NUMBERS.items() if tags.get(t) == old}
    single = [t for t in wrong if t in df.columns and df.schema[t].dataType.typeName() != "array"]
    return df.withColumns({t: F.when(F.col(t).isNotNull(), F.array(t)) for t in single}), tags | wrong


def _of_length(a: Column, number: str, n_alleles: Column, s: Column, tag: str) -> Column:
    """``a``, an error where the reference changes and ``a`` hasn't as many values as its Number asks for."""
    n = n_alleles.cast("int")
    asked = {"A": n - 1, "R": n, "G": (n * (n + 1) / 2).cast("int")}[number]
    missing = a.isNull() | ((F.size(a) == 1) & F.get(a, F.lit(0)).isNull())
    return F.when((s == 0) | missing | (F.size(a) == asked), a).otherwise(F.raise_error(F.lit(f"{tag}: not as many values as alleles; drop the tag or mend its Number")))


def with_swapped(
    df: DataFrame, tags: dict[str, str], s: Column, n_alleles: Column, rules: dict[str, tuple[str, ...]] | None = None, strict: bool = False
) -> DataFrame:
    """``df`` with the array columns ``tags`` (name to Number) rewritten by their rules.

    With ``strict`` an array of a wrong length is an error, unless its rule is DROP; else values that aren't there are null.
    """
    for tag, rule in assign_rules(tags, rules).items():
        a = F.col(tag)
        if strict and rule != "DROP" and tags[tag] in ("A", "R", "G"):
            a = _of_length(a, tags[tag], n_alleles, s, tag)
        total = F.col("AN") if "AN" in df.columns else None
        df = df.withColumn(tag, by_rule(rule, tags[tag], tag, a, s, n_alleles, total, F.lit(2.0)))
    return df


def by_rule(rule: str, number: str, tag: str, a: Column, s: Column, n_alleles: Column, total: Column | None, ploidy: Column) -> Column:
    """The values ``a`` of one tag by its rule; ``total`` is the number of alleles called, where it is known."""
    if rule == "DROP":
        return F.when(s == 0, a)
    if rule == "AC":
        return per_alt(a, s) if total is None else complement(a, s, total)
    if rule in ("AF", "DS"):
        return complement(a, s, F.lit(1.0) if rule == "AF" else ploidy)
    if rule == "GT":
        return allele_codes(a, s)
    if rule == "ES":
        return direction(a, s) if tag == "ED" else effect(a, s)
    return {"A": per_alt, "R": per_allele}[number](a, s) if number in ("A", "R") else per_genotype(a, n_alleles, s)


def _negated(x: Column) -> Column:
    """A number's text with the other sign; the number stays as precise as it was written."""
    bare = F.when(F.startswith(x, F.lit("-")), F.substring(x, 2, 1 << 30)).when(F.startswith(x, F.lit("+")), F.concat(F.lit("-"), F.substring(x, 2, 1 << 30)))
    return F.when(x.try_cast("double") == 0, x).otherwise(F.coalesce(bare, F.concat(F.lit("-"), x)))


def rewritten_info(info: Column, tags: dict[str, str], s: Column, n_alleles: Column, rules: dict[str, tuple[str, ...]] | None = None, strict: bool = False) -> Column:
    """A map of INFO texts by the rules of its tags (name to Number), in one pass over its entries.

    Values keep their text unless they are computed: the rest of a count or of a frequency. A value that is missing as a whole
    stays so; a tag whose rule is DROP goes where the reference changes. With ``strict`` a wrong number of values is an error.
    """
    assigned = assign_rules(tags, rules)
    total = F.try_element_at(info, F.lit("AN")).try_cast("long")
    texts = lambda a: F.transform(a, lambda x: x.cast("string"))

    def new(tag: str, rule: str, v: Column) -> Column:
        a = F.transform(F.split(v, ","), lambda x: F.when(x != ".", x))
        if strict and tags[tag] in ("A", "R", "G"):
            a = _of_length(a, tags[tag], n_alleles, s, tag)
        if rule == "AC":
            counts = F.transform(a, lambda x: x.try_cast("long"))
            a = F.when(total.isNull(), per_alt(a, s)).otherwise(texts(complement(counts, s, total)))
        elif rule in ("AF", "DS"):  # in single precision, as such files hold
            numbers = complement(F.transform(a, lambda x: x.try_cast("double")), s, F.lit(1.0 if rule == "AF" else 2.0))
            a = F.transform(numbers, lambda x: x.cast("float").cast("string"))
        elif rule == "GT":
            a = texts(allele_codes(F.transform(a, lambda x: x.try_cast("int")), s))
        elif rule == "ES" and tag != "ED":
            exchanged = F.transform(a, lambda x, i: F.when(i == s - 1, _negated(x)).otherwise(x))
            a = _by(s, exchanged, F.array_prepend(a, F.lit(None)), a)
        else:
            a = by_rule(rule, tags[tag], tag, a, s, n_alleles, None, F.lit(2.0))
        return F.when(v == ".", v).otherwise(F.array_join(a, ",", "."))

    def value(k: Column, v: Column) -> Column:
        out = F.when(F.lit(False), v)
        for tag, rule in assigned.items():
            if rule != "DROP":
                out = out.when(k == tag, new(tag, rule, v))
        return out.otherwise(v)

    gone = [t for t, r in assigned.items() if r == "DROP"]
    kept = F.map_filter(info, lambda k, v: ~k.isin(gone)) if gone else info
    return F.when(F.coalesce(s, F.lit(0)) == 0, info).otherwise(F.transform_values(kept, value))


def rewritten_samples(samples: Column, fields: dict[str, str], tags: dict[str, str], s: Column, n_alleles: Column, rules: dict[str, tuple[str, ...]] | None = None) -> Column:
    """An array of sample structs by the rules of their fields. ``fields`` names each field's tag, or "" where it has none.

    Genotypes are renumbered; their number of alleles is the ploidy that dosages add up to, 2 without genotypes.
    """
    assigned = assign_rules({t: tags.get(t, ".") for t in fields.values() if t}, rules)
    by_tag = {t: f for f, t in fields.items()}

    def one(x: Column) -> Column:
        gt = x[by_tag["GT"]] if "GT" in by_tag else None
        ploidy = F.coalesce(F.size(gt).cast("double"), F.lit(2.0)) if gt is not None else F.lit(2.0)
        total = x[by_tag["AN"]].cast("long") if "AN" in by_tag else None
        out = []
        for field, tag in fields.items():
            rule = assigned.get(tag)
            if tag == "GT":
                out.append(allele_codes(x[field], s).alias(field))
            elif rule is None or (rule == "AGR" and tags.get(tag) not in ("A", "R", "G")):
                out.append(x[field].alias(field))
            else:
                out.append(by_rule(rule, tags.get(tag, "."), tag, x[field], s, n_alleles, total, ploidy).alias(field))
        return F.struct(*out)

    return F.when(F.coalesce(s, F.lit(0)) == 0, samples).otherwise(F.transform(samples, one))
