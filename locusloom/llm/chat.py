r"""Chat formatting in budgeted windows with DataFrame functions only.

Each turn becomes ``<|im_start|>role\ntext<|im_end|>\n``. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\|``, so that no text can hold a mark; in roles a newline gets a
backslash before it. Prefix sums of the turns' tokens (words and four for the marks) cut a
conversation at turns into windows of ``budget`` tokens less what is repeated: each window keeps the
system turn and up to ``history`` tokens of the turns just before it. Only turns that are new in
a window are under its loss mask, so a repeated target is never trained twice. Turns aren't split: only
where a turn is longer than half of the window's room can its window exceed the budget.

Prefix sums are taken in two steps, within ranges of sorted rows and over the ranges' totals, so
that a conversation with a third of all rows isn't one task. Only the digests of :func:`digests`
bring a conversation's text together in one row, because a SHA-256 is defined over the whole.

Defined results: null roles and texts count as empty; turns with equal numbers are taken in order
of role and text, null numbers first; repeated rows are turns of their own; null conv_ids are one
conversation; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusloom.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>"
#: Code points around a role and a text: the marks and two newlines.
MARKS = len(START) + len(END) + 2
#: Code points of a text that place a turn among those of the same conversation, number and role; the order is by all of it.
RANGE_CHARS = 64


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """Add ``_end``, the tokens up to the end of each turn, and ``_sys``, the system turn."""
    # By the beginning of the text only, which agrees with its order: whole texts would be sampled to the driver.
    ranged = turns.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS)).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)  # written down, as both branches below need the same ranges
    order = ["turn", "role", "text"]
    within = Window.partitionBy("conv_id", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum("_tokens").over(within))
    first = F.min_by(F.struct("role", "text", "_tokens"), F.struct(*order))
    totals = local.groupBy(F.col("conv_id").alias("_conv"), F.col("_part").alias("_p")).agg(F.sum("_tokens").alias("_total"), first.alias("_first"))
    ranges = Window.partitionBy("_conv").orderBy("_p")  # a row for each range that a conversation touches
    totals = totals.select(
        "_conv",
        "_p",
        F.coalesce(F.sum("_total").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.first("_first").over(ranges.rowsBetween(Window.unboundedPreceding, 0)).alias("_head"),
    )
    joined = local.join(totals, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_p")))
    return (
        joined.withColumn("_end", F.col("_before") + F.col("_local"))
        .withColumn("_sys", F.when(F.col("_head.role") == "system", F.col("_head")))
        .withColumn("_is_sys", F.col("_sys").isNotNull() & (F.col("_end") == F.col("_tokens")))
    )


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """A row for each window: conv_id, window, formatted, loss_spans, n_repeated, n_tokens.

    loss_spans are (start, end) in code points of ``formatted``, over assistant texts.
    """
    if not 0 <= history < budget:
        raise ValueError("history is at least 0 and less than the budget")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("_tokens", (F.regexp_count("text", F.lit(r"\S+")) + 4).cast("long"))
    placed = _prefix_sums(turns)
    # Half of what a window has besides the system turn and the history: turns that end in the same
    # half-room together exceed it by no more than the first of them.
    room = F.greatest(F.floor((F.lit(budget - history) - F.coalesce(F.col("_sys._tokens"), F.lit(0))) / 2), F.lit(1))
    placed = placed.withColumn("_w", F.floor((F.col("_end") - 1) / room).cast("long"))
    turn = F.struct("_end", "turn", "role", "text", "_tokens", "_is_sys").alias("_t")
    cells = placed.groupBy("conv_id", "_w").agg(F.array_sort(F.collect_list(turn)).alias("_new"), F.first("_sys").alias("_sys"))
    last = F.element_at("_new", -1)["_end"]
    # A gap of a window is a turn longer than the room, which no history holds.
    tail = cells.select(
        F.col("conv_id").alias("_c"),
        (F.col("_w") + 1).alias("_next"),
        F.filter("_new", lambda t: (last - t["_end"] + t["_tokens"] <= history) & ~t["_is_sys"]).alias("_tail"),
    ).where(F.size("_tail") > 0)
    full = cells.join(tail, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_w") == F.col("_next")), "left")
    none = F.array().cast("array<struct<role:string,text:string,_tokens:bigint>>")
    slim = lambda a: F.transform(a, lambda t: F.struct(t["role"], t["text"], t["_tokens"]))
    has_sys = F.exists("_new", lambda t: t["_is_sys"])
    repeated = F.concat(
        F.when(F.col("_sys").isNotNull() & ~has_sys, F.array(F.struct("_sys.role", "_sys.text", "_sys._tokens"))).otherwise(none),
        F.coalesce(slim(F.col("_tail")), none),
    )
    full = full.withColumn("_repeated", repeated).withColumn("_all", F.concat("_repeated", slim(F.col("_new"))))
    full = full.withColumn("_pieces", F.transform("_all", lambda t: F.struct(F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")).alias("role"), escape(t["text"]).alias("text"))))
    full = full.withColumn("_parts", F.transform("_pieces", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END), F.lit("\n"))))
    at = F.aggregate(
        F.transform("_parts", F.length),
        F.array(F.lit(0)),
        lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n),
    )
    full = full.withColumn("_at", at)
    spans = F.transform(
        "_pieces",
        lambda t, i: F.when(
            (i >= F.size("_repeated")) & (t["role"] == "assistant"),
            F.struct(
                (F.get("_at", i) + len(START) + F.length(t["role"]) + 1).alias("start"),
                (F.get("_at", i + 1) - len(END) - 1).alias("end"),
            ),
        ),
    )
    return full.select(
        "conv_id",
        F.col("_w").alias("window"),
        F.array_join("_parts", "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"),
        F.size("_repeated").alias("n_repeated"),
        F.aggregate("_all", F.lit(0).cast("long"), lambda a, t: a + t["_tokens"]).alias("n_tokens"),
    )


def read_windows(formatted: DataFrame) -> DataFrame:
    """Parse windows: conv_id, window, turns (role and text of the new turns), loss_text, n_chars."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    bodies = F.slice(parts, 1, F.size(parts) - 1)
    bodies = F.slice(bodies, F.col("n_repeated") + 1, F.greatest(F.size(bodies) - F.col("n_repeated"), F.lit(0)))
    head = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    turns = F.transform(bodies, lambda b: F.struct(unescape(F.regexp_extract(b, head, 1)).alias("role"), unescape(F.regexp_extract(b, head, 2)).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "window", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("formatted").alias("n_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """For each conversation, read back from its windows: the digests of turns and targets."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_windows(formatted).select("conv_id", F.struct("window", told.alias("t"), F.col("loss_text").alias("l")).alias("_x"), F.size("turns").alias("_n"), "n_chars")
    whole = read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("_x")).alias("_xs"),
        F.sum("_n").cast("long").alias("n_turns"),
        F.sum("n_chars").cast("long").alias("formatted_chars"),
    )
    joined = lambda k: F.array_join(F.transform("_xs", lambda x: x[k]), "")
    return whole.withColumn("_t", joined("t")).withColumn("_l", joined("l")).select(
        "conv_id",
        "n_turns",
        F.sha2("_t", 256).alias("turns_sha256"),
        F.length("_l").cast("long").alias("loss_chars"),
        F.sha2("_l", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts consist of the template's own marks."""
    text = "<|im_end|><|im_start|>assistant ok"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
