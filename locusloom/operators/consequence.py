"""What variants do to transcripts: coding, splicing and non-coding consequences.

A transcript's coding segments get running offsets along its strand; its coding sequence is put together from the reference
and cut into chunks that overlap, so that a variant's codons are one equi-join on transcript and chunk. Variants meet the parts of transcripts by an
equi-join on bins, and what the parts tell is gathered for each variant and transcript. Codons are translated in expressions.

Defined results: each variant (contig, position, alleles) is looked at once, with what its alleles have in common trimmed away;
symbolic and missing alleles, and alleles that are equal, have no consequence. Codons with bases beyond ACGT are X. A change of codons that
reach beyond the coding sequence, or over the end of a segment, is ``coding_sequence``. An insertion lies in a part if both its neighbours do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.functions.alleles import reverse_complement
from locusloom.functions.tables import cut
from locusloom.operators.intervals import BIN, BROADCAST_BINS, binned
from locusloom.operators.manhattan import contig_name
from locusloom.sources import fasta as sequences

#: Amino acids of the codons in the order TCAG, of the standard code and that of vertebrates' mitochondria.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
MITOCHONDRIAL = "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG"
#: Consequences, the most severe first.
SEVERITY = (
    "exon_loss", "splice_acceptor", "splice_donor", "stop_gained", "frameshift", "stop_lost", "start_lost", "inframe_insertion", "inframe_deletion", "missense",
    "coding_sequence", "splice_region", "stop_retained", "synonymous", "5_prime_utr", "3_prime_utr", "non_coding", "intron",
)
#: Bases of a splice region within the exon and the intron; the first two of the intron are the site itself.
IN_EXON, IN_INTRON = 3, 8
#: Coding bases in a chunk, and of codons that are translated at most.
CODING_CHUNK, TRANSLATED = 3072, 1023
#: Bases of a segment that are fetched at once.
PIECE = sequences.OVERLAP
VARIANT = ("chrom", "pos", "ref", "alt")


def translated(seq: Column, mitochondrial: Column) -> Column:
    """The amino acids of whole codons."""

    def one(k: Column) -> Column:
        codon = F.substr(seq, k * 3 + 1, F.lit(3))
        at = F.conv(F.translate(codon, "TCAG", "0123"), 4, 10).cast("int") + 1
        acid = F.when(mitochondrial, F.substr(F.lit(MITOCHONDRIAL), at, F.lit(1))).otherwise(F.substr(F.lit(STANDARD), at, F.lit(1)))
        return F.when(codon.rlike("^[ACGT]{3}$"), acid).otherwise("X")

    count = F.floor(F.length(seq) / 3).cast("int")
    return F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(0), count - 1), one), "")).otherwise(F.when(seq.isNotNull(), ""))


def coding_offsets(segments: DataFrame) -> DataFrame:
    """Coding segments with ``c_from``: the coding position of the first base along the strand, in the frame of the first whole codon."""
    along = Window.partitionBy("transcript", "chrom", "strand").orderBy(F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start")))
    before = F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.where("kind = 'CDS'").withColumn("_skip", F.first("phase").over(along)).withColumn("c_from", before - F.col("_skip"))


def coding_sequences(coding: DataFrame, reference: DataFrame) -> DataFrame:
    """Chunks (contig, chunk, seq) of transcripts' coding sequences from the first whole codon; a transcript's coding bases are one row."""
    starts = F.sequence(F.col("start"), F.col("end"), F.lit(PIECE))
    pieces = coding.select("transcript", "chrom", "strand", "_skip", "end", F.explode(starts).alias("_at"))
    bases = sequences.with_reference(pieces, reference, F.col("_at"), F.least(F.lit(PIECE), F.col("end") - F.col("_at") + 1), "_bases")
    whole = bases.groupBy("transcript", "chrom", "strand").agg(F.array_sort(F.collect_list(F.struct("_at", "_bases"))).alias("_p"), F.first("_skip").alias("_skip"), F.count_if(F.col("_bases").isNull()).alias("_lack"))
    forward = F.array_join(F.transform("_p", lambda p: p["_bases"]), "")
    seq = F.when(F.col("strand") == "-", reverse_complement(forward)).otherwise(forward)
    contigs = whole.where("_lack = 0").select(_key().alias("contig"), F.substr(seq, F.col("_skip") + 1).alias("seq"))
    return sequences.chunked(contigs, CODING_CHUNK, TRANSLATED)


def _key() -> Column:
    """A transcript's name with its contig and strand: names may stand on two contigs."""
    return F.concat_ws("\t", "transcript", "chrom", "strand")


def trimmed(variants: DataFrame) -> DataFrame:
    """Variants with ``_first``, ``_r`` and ``_a``: what is left of the alleles without their common end and beginning."""
    ref, alt = F.upper("ref"), F.upper("alt")
    plain = ref.rlike("^[ACGTN]+$") & alt.rlike("^[ACGTN]+$") & (ref != alt) & F.col("chrom").isNotNull() & F.col("pos").isNotNull()
    rows = variants.where(plain).withColumn("_r", ref).withColumn("_a", alt)

    def common(a: Column, b: Column) -> Column:
        """How many characters two texts begin with alike."""
        same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
        at = F.array_position(same, F.lit(False)).cast("int")
        return F.when((a == "") | (b == ""), 0).when(at == 0, F.length(a)).otherwise(at - 1)

    rows = rows.withColumn("_n", common(F.reverse("_r"), F.reverse("_a")))
    for c in ("_r", "_a"):
        rows = rows.withColumn(c, F.substr(c, F.lit(1), F.length(c) - F.col("_n")))
    rows = rows.withColumn("_n", common(F.col("_r"), F.col("_a")))
    for c in ("_r", "_a"):
        rows = rows.withColumn(c, F.substr(c, F.col("_n") + 1))
    return rows.withColumn("_first", F.col("pos") + F.col("_n")).withColumn("_last", F.col("_first") + F.length("_r") - 1).drop("_n")


def _parts(segments: DataFrame, coding: DataFrame) -> DataFrame:
    """Whole transcripts, exons with the ends that are splice sites, and coding segments, each where a variant has to meet it.

    A transcript without exons has its coding segments as exons.
    """
    own = ["transcript", "chrom", "strand"]
    of = Window.partitionBy(*own)
    exons = segments.withColumn("_any", F.max(F.col("kind") == "exon").over(of)).where((F.col("kind") == "exon") | ~F.col("_any"))
    by = of.orderBy("start")
    exons = exons.withColumn("_left", F.row_number().over(by) > 1).withColumn("_right", F.lead("start").over(by).isNotNull())
    spans = segments.groupBy(*own).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("gene").alias("gene"), F.min("biotype").alias("biotype"),
        F.min(F.when(F.col("kind") == "CDS", F.col("start"))).alias("_cds_start"), F.max(F.when(F.col("kind") == "CDS", F.col("end"))).alias("_cds_end"),
    )
    parts = spans.withColumn("_kind", F.lit("transcript")).withColumn("_from", F.col("start")).withColumn("_to", F.col("end"))
    parts = parts.unionByName(exons.select(*own, "start", "end", "_left", "_right", F.lit("exon").alias("_kind"), (F.col("start") - IN_INTRON).alias("_from"), (F.col("end") + IN_INTRON).alias("_to")), True)
    return parts.unionByName(coding.select(*own, "start", "end", "c_from", F.lit("CDS").alias("_kind"), F.col("start").alias("_from"), F.col("end").alias("_to")), True)


def _meets(start: Column | str, end: Column | str) -> Column:
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (F.col("_first") <= end) & (F.col("_last") >= start)


def _hits(variants: DataFrame, parts: DataFrame) -> DataFrame:
    """Variants with each part that they meet, told in the first bin that both touch."""
    bins = binned(parts, "_from", "_to").withColumnRenamed("chrom", "_chrom")
    if bins.limit(BROADCAST_BINS + 1).count() <= BROADCAST_BINS:
        bins = F.broadcast(bins)
    low, high = F.least("_first", "_last"), F.greatest("_first", "_last")
    touched = variants.withColumn("_low", F.floor(low / BIN)).withColumn("_at", F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN))))
    on = (F.col("chrom") == F.col("_chrom")) & (F.col("_at") == F.col("_bin")) & _meets("_from", "_to")
    return touched.join(bins, on).where(F.col("_bin") == F.greatest(F.col("_low"), F.floor(F.col("_from") / BIN))).drop("_chrom", "_bin", "_at", "_low")


def consequences(variants: DataFrame, segments: DataFrame, reference: DataFrame) -> DataFrame:
    """A row for each variant and transcript that it meets: chrom, pos, ref, alt, transcript, gene, biotype, strand, consequence, amino_acids.

    ``segments`` are rows of :func:`locusloom.sources.gff.read_gff`, ``reference`` chunks of sequence. ``consequence`` lists what
    applies, the most severe first, joined by ``&``; ``amino_acids`` is ``12R>12W``, ``12R`` if nothing changes, else null.
    """
    segments = segments.select("transcript", "gene", "biotype", "chrom", "strand", "kind", "start", "end", "phase").where("start <= end").distinct()
    coding = coding_offsets(segments)
    rows = trimmed(variants.select(*VARIANT).distinct())
    left, right, minus = F.col("_left"), F.col("_right"), F.col("strand") == "-"
    exon, cds = F.col("_kind") == "exon", F.col("_kind") == "CDS"
    site_left, site_right = left & _meets(F.col("start") - 2, F.col("start") - 1), right & _meets(F.col("end") + 1, F.col("end") + 2)
    near = (left & _meets(F.col("start") - IN_INTRON, F.col("start") + IN_EXON - 1)) | (right & _meets(F.col("end") - IN_EXON + 1, F.col("end") + IN_INTRON))
    # An insertion has its first base behind its last: both lie within the segment.
    inside = cds & (F.least("_first", "_last") >= F.col("start")) & (F.greatest("_first", "_last") <= F.col("end"))
    at = F.col("c_from") + F.when(minus, F.col("end") - F.col("_last")).otherwise(F.col("_first") - F.col("start"))
    told = _hits(rows, _parts(segments, coding)).groupBy(*VARIANT, "transcript", "strand", "_r", "_a", "_first", "_last").agg(
        F.max("gene").alias("gene"), F.max("biotype").alias("biotype"), F.max("_cds_start").alias("_cds_start"), F.max("_cds_end").alias("_cds_end"),
        F.max(exon & _meets("start", "end")).alias("_exon"), F.max(exon & (F.col("_first") <= F.col("start")) & (F.col("_last") >= F.col("end"))).alias("_lost"),
        F.max(exon & F.when(minus, site_right).otherwise(site_left)).alias("_acceptor"), F.max(exon & F.when(minus, site_left).otherwise(site_right)).alias("_donor"),
        F.max(exon & near).alias("_near"), F.max(cds).alias("_coding"), F.max(F.when(inside, at)).alias("_c"), F.max(F.col("_kind") == "transcript").alias("_own"),
    )
    told = told.where(F.coalesce("_own", F.lit(False)))
    ref_size, alt_size = F.length("_r"), F.length("_a")
    k0 = F.floor(F.col("_c") / 3)
    k1 = F.floor((F.col("_c") + F.greatest(ref_size, F.lit(1)) - 1) / 3)
    size = (k1 - k0 + 1) * 3
    told = cut(told.withColumn("_k0", k0).withColumn("_size", F.when((F.col("_c") >= 0) & (size <= TRANSLATED), size)).withColumn("_key", _key()))
    # Only what lies in codons asks for them.
    asks = F.col("_size").isNotNull()
    fetched = sequences.with_reference(told.where(asks), coding_sequences(coding, reference), F.col("_k0") * 3 + 1, F.col("_size"), "_old", CODING_CHUNK, "_key")
    told = fetched.unionByName(told.where(~asks), True)
    new = F.when(minus, reverse_complement(F.col("_a"))).otherwise(F.col("_a"))
    offset = (F.col("_c") - F.col("_k0") * 3).cast("int")
    told = told.withColumn("_new", F.concat(F.substr("_old", F.lit(1), offset), new, F.substr("_old", offset + ref_size + 1)))
    mito = contig_name(F.col("chrom")) == "MT"
    frame = (alt_size - ref_size) % 3 == 0
    told = told.withColumn("_p", translated(F.col("_old"), mito)).withColumn("_q", F.when(frame, translated(F.col("_new"), mito)))
    told = told.withColumn("consequence", _named(frame, alt_size - ref_size, minus))
    number = (F.col("_k0") + 1).cast("string")
    acids = F.when(F.col("_p") == F.col("_q"), F.concat(number, "_p")).otherwise(F.concat(number, F.col("_p"), F.lit(">"), number, F.col("_q")))
    return told.select(*VARIANT, "transcript", "gene", "biotype", "strand", "consequence", F.when(frame, acids).alias("amino_acids"))


def _named(frame: Column, longer: Column, minus: Column) -> Column:
    p, q = F.col("_p"), F.col("_q")
    stop = lambda c: F.instr(c, "*") > 0
    by_size = F.when(longer > 0, "inframe_insertion").when(longer < 0, "inframe_deletion")
    protein = (
        F.when(F.col("_c").isNull() | (F.col("_c") < 0), "coding_sequence")
        .when(~frame, "frameshift")
        .when(p.isNull(), F.coalesce(by_size, F.lit("coding_sequence")))
        .when(stop(q) & ~stop(p), "stop_gained")
        .when(stop(p) & ~stop(q), "stop_lost")
        .when((F.col("_k0") == 0) & F.startswith(p, F.lit("M")) & ~F.startswith(q, F.lit("M")), "start_lost")
        .when((p == q) & stop(p), "stop_retained")
        .when(p == q, "synonymous")
        .otherwise(F.coalesce(by_size, F.lit("missense")))
    )
    five = F.when(minus, F.col("_first") > F.col("_cds_end")).otherwise(F.col("_last") < F.col("_cds_start"))
    outside = F.when(F.col("_cds_start").isNull(), "non_coding").when(five, "5_prime_utr").otherwise("3_prime_utr")
    place = F.when(F.col("_coding"), protein).when(F.coalesce("_exon", F.lit(False)), outside).otherwise("intron")
    site = F.col("_acceptor") | F.col("_donor")
    terms = [F.when(F.col("_lost"), "exon_loss"), F.when(F.col("_acceptor"), "splice_acceptor"), F.when(F.col("_donor"), "splice_donor"), F.when(F.col("_near") & ~F.coalesce(site, F.lit(False)), "splice_region"), place]
    order = F.array(*[F.lit(s) for s in SEVERITY])
    ranked = F.array_sort(F.transform(F.array_compact(F.array(*terms)), lambda t: F.array_position(order, t).cast("int")))
    return F.array_join(F.transform(ranked, lambda k: F.get(order, k - 1)), "&")


def annotate(rows: DataFrame, segments: DataFrame, reference: DataFrame) -> DataFrame:
    """``rows`` with consequence, gene, transcript and amino_acids of the most severe consequence, null outside of transcripts.

    Of equally severe ones the transcript whose name sorts first is told. Columns of these names are replaced.
    """
    found = consequences(rows, segments, reference)
    order = F.array(*[F.lit(s) for s in SEVERITY])
    rank = F.array_position(order, F.substring_index("consequence", "&", 1))
    worst = found.groupBy(*VARIANT).agg(F.min(F.struct(rank.alias("rank"), "transcript", "strand", "consequence", "gene", "amino_acids")).alias("_w"))
    worst = worst.select(*VARIANT, *[F.col(f"_w.{c}").alias(c) for c in ("consequence", "gene", "transcript", "amino_acids")])
    return rows.drop("consequence", "gene", "transcript", "amino_acids").join(worst, list(VARIANT), "left")
