"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted by turn, adjacent turns of one role are merged
into one block whose parts keep the turn borders, and blocks are concatenated:

    <|role|>ROLE<|text|>PART<|part|>PART<|end|>\n

Texts and roles are escaped: each backslash is doubled and each "<|" becomes "<\\|", so no marker can occur
inside a text and unescape() restores it exactly. The loss mask covers the escaped parts of the
roles in `loss_roles`, never the markers.

Defined results: null text or role = empty string; null turn sorts first; ties of turn are ordered by role, then
text; repeated rows are kept; a null conv_id is a conversation of its own; an empty table gives no rows; columns
besides conv_id, turn, role, text are ignored. A conversation is one row, so it must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers: fixed values of the output format.
ROLE, TEXT, PART, END = "<|role|>", "<|text|>", "<|part|>", "<|end|>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _merge(turns: str) -> Column:
    """Adjacent turns of one role of a column become blocks {role, parts}: each block is cut out where the role changes, so every turn is copied once."""
    n = F.size(turns)
    starts = F.filter(F.transform(turns, lambda t, i: F.when((i == 0) | (F.get(turns, i - 1)["role"] != t["role"]), i)), lambda i: i.isNotNull())
    spans = lambda s: F.arrays_zip(s.alias("a"), F.concat(F.slice(s, 2, n), F.array(n)).alias("b"))
    block = lambda x: F.struct(F.get(turns, x["a"])["role"].alias("role"), F.transform(F.slice(turns, x["a"] + 1, x["b"] - x["a"]), lambda t: t["text"]).alias("parts"))
    return F.element_at(F.transform(F.array(starts), lambda s: F.transform(spans(s), block)), 1)


def format_chats(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of {start, length}, 0-based code points)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))))
    grouped = conversations.groupBy("conv_id").agg(turns.alias("turns"))
    merged = grouped.select("conv_id", _merge("turns").alias("blocks"))
    safe = merged.select(
        "conv_id",
        F.transform("blocks", lambda b: F.struct(b["role"].alias("role"), escape(b["role"]).alias("shown"), F.transform(b["parts"], escape).alias("parts"))).alias("blocks"),
    )

    # A flat list of pieces, each with its mask bit; start offsets follow from the running length.
    def pieces(b: Column) -> Column:
        masked = b["role"].isin(*loss_roles)
        head = F.struct(F.concat(F.lit(ROLE), b["shown"], F.lit(TEXT)).alias("s"), F.lit(False).alias("m"))
        body = F.flatten(
            F.transform(
                b["parts"],
                lambda p, i: F.when(i == 0, F.array(F.struct(p.alias("s"), masked.alias("m")))).otherwise(
                    F.array(F.struct(F.lit(PART).alias("s"), F.lit(False).alias("m")), F.struct(p.alias("s"), masked.alias("m")))
                ),
            )
        )
        tail = F.struct(F.lit(END).alias("s"), F.lit(False).alias("m"))
        return F.concat(F.array(head), body, F.array(tail))

    flat = safe.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    # Running lengths in runs of about the square root of the number of pieces, then over the runs: folds copy what they gather.
    span = "array<struct<start:bigint,length:bigint>>"
    n = F.size("pieces")
    run = F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.ceil(n / run).cast("int") - 1), lambda g: F.slice("pieces", g * run + 1, run))

    def step(a: Column, p: Column) -> Column:
        own = F.array(F.struct(a["at"].alias("start"), F.length(p["s"]).cast("long").alias("length")))
        return F.struct((a["at"] + F.length(p["s"])).alias("at"), F.when(p["m"], F.concat(a["spans"], own)).otherwise(a["spans"]).alias("spans")).cast(f"struct<at:bigint,spans:{span}>")

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans"))
    flat = flat.withColumn("local", F.transform(runs, lambda g: F.aggregate(g, begin, step)))
    flat = flat.withColumn("bases", F.aggregate("local", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["at"]))))
    moved = F.zip_with("local", F.slice("bases", F.lit(1), F.size("local")), lambda x, base: F.transform(x["spans"], lambda p: F.struct((p["start"] + base).alias("start"), p["length"].alias("length"))))
    return flat.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), F.flatten(moved).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns {role, text} of a formatted conversation, markers removed and texts unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        halves = F.split(F.substring(b, len(ROLE) + 1, 2**31 - 1), r"<\|text\|>")
        role = unescape(halves[0])
        return F.transform(F.split(halves[1], r"<\|part\|>"), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
