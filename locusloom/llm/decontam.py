"""Benchmark decontamination with DataFrame functions only.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased. A
benchmark item has a window for each run of ``window`` consecutive words; an item of fewer words, but
not none, is one window itself. Documents are scanned at strides: a window of n words holds n - k + 1
runs of k words, so a run at every (n - k + 1)th word meets all its occurrences. The hash set of the
items' runs is broadcast while it is small (else the join shuffles). Documents that meet it are looked at
in full: the fingerprints of all their windows meet the windows' hash set, and every hit is verified word
by word before it counts.

Defined results: a null or wordless text has no words and no hits; repeated rows are each
answered; rows that share a doc_id but not a text are told apart; an empty benchmark hits nothing;
null item texts give no windows and null item_ids are left out of the digest; further columns are
ignored by :func:`contamination` and kept by :func:`decontaminate`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import ascii_lower, broadcast_if_small, cut, own_columns

#: The class before A-Z is lower-cased, told by what it has: Java matches that faster than its complement.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _with_window_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``_h{n}`` for each n of ``lengths``: fingerprints of all runs of n of ``_words``.

    Fingerprints of long runs are put together from two shorter ones, so the work for each word
    is logarithmic in the window. Words are folded with ``lower`` here, which never separates
    words that are equal after A-Z is lower-cased; the verification is exact.
    """
    done = {1}
    df = df.withColumn("_n", F.size("_words")).withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(F.lower(w))))

    def build(n: int) -> None:
        nonlocal df
        if n in done:
            return
        a = 1 << ((n - 1).bit_length() - 1)
        b = n - a
        build(a)
        build(b)
        m = F.greatest(F.col("_n") - n + 1, F.lit(0))
        df = df.withColumn(f"_h{n}", F.zip_with(F.slice(f"_h{a}", 1, m), F.slice(f"_h{b}", a + 1, m), lambda x, y: F.xxhash64(x, y)))
        done.add(n)

    for n in lengths:
        build(n)
    return df


def _windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """(item_id, length, fingerprint, words) of each distinct window of each item; the lengths."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    size = F.least(F.size("_words"), F.lit(window))
    lengths = sorted(r[0] for r in items.select(size).distinct().collect())  # at most `window` values
    items = _with_window_hashes(items, lengths)
    exact = F.transform("_words", ascii_lower)
    parts = [
        items.where(F.least("_n", F.lit(window)) == n)
        .select("item_id", exact.alias("_w"), F.posexplode(f"_h{n}").alias("_i", "fingerprint"))
        .select("item_id", F.lit(n).alias("length"), "fingerprint", F.array_join(F.slice("_w", F.col("_i") + 1, n), " ").alias("words"))
        for n in lengths
    ]
    none = items.select("item_id", F.lit(0).alias("length"), F.lit(0).cast("long").alias("fingerprint"), F.lit("").alias("words")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts, none).distinct(), lengths


def _verified(text: Column, hits: Column) -> Column:
    """The hits whose words are those of the text. The words are bound once, as a lambda's argument."""
    words = F.transform(_words(text), ascii_lower)
    kept = F.transform(F.array(words), lambda w: F.filter(hits, lambda h: F.array_join(F.slice(w, h["at"] + 1, h["n"]), " ") == h["words"]))
    return F.get(kept, F.lit(0))


def _strides(lengths: list[int]) -> dict[int, int]:
    """The stride for each run length that together meet all windows of these lengths."""
    out: dict[int, int] = {}
    for n in sorted(lengths):
        k = (n + 1) // 2
        out[k] = min(out.get(k, n), n - k + 1)
    return out


def _folded(text: Column) -> Column:
    """Lower case that never separates words that are equal after A-Z is lower-cased, and looks at no neighbours."""
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def _runs(words: str, k: int, stride: int) -> Column:
    """Fingerprints of the runs of k words at every ``stride``-th word."""
    starts = F.sequence(F.lit(1), F.size(words) - k + 1, F.lit(stride))
    return F.when(F.size(words) >= k, F.transform(starts, lambda i: F.xxhash64(F.lit(k), F.slice(words, i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))


def _scanned(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(_id, _th, n_words, _met) of each document: whether it holds a run that an item holds.

    A document's runs are rows of its own task and are summed up there, before anything is shuffled.
    """
    strides = _strides(lengths)
    own = windows.select(F.split(_folded(F.col("words")), " ").alias("_words"))
    items = cut(own.select(F.explode(F.concat(*[_runs("_words", k, 1) for k in strides])).alias("_run")).distinct())
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), _words(_folded(F.col("text"))).alias("_words"))
    sampled = [_runs("_words", k, s) for k, s in strides.items()]
    rows = keyed.select("_id", "_th", F.size("_words").cast("long").alias("n_words"), F.explode_outer(F.concat(*sampled)).alias("_run"))
    met = rows.join(broadcast_if_small(items.withColumn("_hit", F.lit(True)), BROADCAST_ROWS), "_run", "left")
    return met.groupBy("_id", "_th").agg(F.max("n_words").alias("n_words"), F.coalesce(F.max("_hit"), F.lit(False)).alias("_met"))


def _verified_hits(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified hits (_hid, _hth, _hits) of each document that has any; the items of each window; what was scanned."""
    windows, lengths = _windows(benchmark, window)
    windows = cut(windows)
    lengths = lengths or [window]
    scanned = cut(_scanned(docs, windows, lengths))
    distinct = windows.select("fingerprint", "length", "words").distinct()
    wanted = cut(scanned.where("_met").select(F.col("_id").alias("_wid"), F.col("_th").alias("_wth")))
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), F.col("text").alias("_text"))
    wanted = broadcast_if_small(wanted, BROADCAST_ROWS)
    keyed = cut(keyed.join(wanted, F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_th") == F.col("_wth")), "left_semi"))
    scan = _with_window_hashes(keyed.select("_id", "_th", _words(F.col("_text")).alias("_words")), lengths)
    scan = scan.select("_id", "_th", "_n", F.posexplode(F.concat(*[f"_h{n}" for n in lengths])).alias("_p", "fingerprint"))
    before, skip = F.lit(0), F.lit(0)
    for n in lengths:  # fingerprints of shorter windows stand before those of longer ones
        skip = F.when(F.col("length") == n, before).otherwise(skip)
        before = before + F.greatest(F.col("_n") - n + 1, F.lit(0))
    hits = (
        scan.join(broadcast_if_small(distinct, BROADCAST_ROWS), "fingerprint")
        .withColumn("_at", F.col("_p") - skip)
        .where((F.col("_at") >= 0) & (F.col("_at") + F.col("length") <= F.col("_n")))
        .groupBy(F.col("_id").alias("_hid"), F.col("_th").alias("_hth"))
        .agg(F.collect_set(F.struct(F.col("_at").alias("at"), F.col("length").alias("n"), "words")).alias("_hits"))
    )
    found = (
        hits.join(keyed, F.col("_hid").eqNullSafe(F.col("_id")) & (F.col("_hth") == F.col("_th")))
        .groupBy("_hid", "_hth")
        .agg(F.first("_hits").alias("_hits"), F.first("_text").alias("_text"))
        .withColumn("_hits", F.array_sort(_verified(F.col("_text"), F.col("_hits"))))
        .where(F.size("_hits") > 0)
        .select("_hid", "_hth", "_hits")
    )
    return cut(found), windows.select("words", "item_id"), scanned


def _covered(hits: Column) -> Column:
    """How many words lie in any of the hits, which are sorted by their starts."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc: Column, h: Column) -> Column:
        end = h["at"].cast("long") + h["n"]
        new = F.greatest(end - F.greatest(h["at"].cast("long"), acc["end"]), F.lit(0).cast("long"))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits, items, scanned = _verified_hits(docs, benchmark, window)
    by_doc = hits.select("_hid", "_hth", F.explode(F.array_distinct(F.transform("_hits", lambda h: h["words"]))).alias("words"))
    named = (
        by_doc.join(broadcast_if_small(items, BROADCAST_ROWS), "words")
        .groupBy(F.col("_hid").alias("_iid"), F.col("_hth").alias("_ith"))
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    )
    digest = hits.select("_hid", "_hth", _covered(F.col("_hits")).alias("n_hit")).join(
        named, F.col("_hid").eqNullSafe(F.col("_iid")) & (F.col("_hth") == F.col("_ith")), "left"
    )
    # Rows that repeat a document are one in what was scanned.
    counted = scanned.select(F.col("_id").alias("_sid"), F.col("_th").alias("_sth"), "n_words")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_th")).join(counted, F.col("doc_id").eqNullSafe(F.col("_sid")) & (F.col("_th") == F.col("_sth")))
    none = F.array().cast("array<string>")
    return (
        rows.join(digest, F.col("doc_id").eqNullSafe(F.col("_hid")) & (F.col("_th") == F.col("_hth")), "left")
        .withColumn("_items", F.coalesce("_items", none))
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size("_items").cast("long").alias("n_items"),
            F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, mode: str = "document") -> DataFrame:
    """``docs`` with its own columns, without contaminated documents or (``mode="span"``) hit spans.

    A removed span runs from the first to the last hit word of a stretch of overlapping or
    adjacent hits, gaps between its words included.
    """
    if mode not in ("document", "span"):
        raise ValueError("mode is 'document' or 'span'")
    hits, *_ = _verified_hits(docs, benchmark, window)
    # The documents' own columns travel in one, whatever their names are.
    keyed = docs.select(F.struct(*own_columns(docs.columns)).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    on = F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_th") == F.col("_hth"))
    if mode == "document":
        return keyed.join(hits, on, "left_anti").select("row.*")
    piece, own = F.col("_piece"), F.col("row")["text"]
    pieces = F.when(F.size("_hits") > 0, F.regexp_extract_all(own, F.lit(f"{WORD}|{GAP}"), F.lit(0)))
    out = keyed.join(hits, on, "left").withColumn("_piece", pieces)
    first = F.when(F.element_at(piece, 1).rlike(f"^{WORD}$"), 0).otherwise(1)  # where the words start among the pieces
    inside = lambda i: F.exists("_hits", lambda h: (i - first >= 2 * h["at"]) & (i - first <= 2 * (h["at"] + h["n"] - 1)))
    text = F.array_join(F.filter(piece, lambda x, i: ~inside(i)), "")
    text = F.when(F.size("_hits") > 0, text).otherwise(own)
    return out.select(*[(text if c.lower() == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
