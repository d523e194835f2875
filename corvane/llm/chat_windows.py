"""Chat formatting in budgeted windows, in DataFrame expressions alone.

Prefix sums of turn tokens cut each conversation into spans of ``budget`` less the history
and the system turn. A turn that lies within a span belongs to that span's window. A turn
that crosses a span's end joins the window too if all still fits the span, and otherwise
has a window of its own. So windows are turn-aligned and found without walking a
conversation turn by turn, and none exceeds ``budget`` tokens unless it has one own turn
only (besides the system turn), one that is itself too long.

A window is led by the conversation's system turn (if it opens with one) and by a limited
history: the turns that begin within ``history`` tokens before it. The loss mask of a
window covers the texts of its own assistant turns, so a turn repeated as system or history
is never a target twice.

A turn reads ``<|im_start|>role newline text<|im_end|>newline``. Backslashes inside roles
and texts are doubled and every control string there gets a backslash after its first
character, so marks can't be forged and ``unescaped`` gives back what was there.

Prefix sums come in two levels: within blocks of ``BLOCK`` turn numbers, and over the
block sums of a conversation; so a conversation with most of the rows is shared out.
Windows are chosen from turn numbers and token counts alone; texts move to their rows'
places and then to their windows.

Defined cases: a null text or role is empty; turns are taken by turn, role, md5 of the text (null
turns first), repeated rows each count; a very long text is a window of its own; a null
conv_id is a conversation of its own; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import written

BUDGET, HISTORY = 512, 64
#: Turn numbers of one prefix-sum block.
BLOCK = 64
#: Tokens that a turn's marks and role count for.
MARK_TOKENS = 4
#: What ``n_tokens`` counts.
PIECES = r"\p{L}{1,6}|\p{N}{1,3}|[^\p{L}\p{N}\s]"
START, END = "<|im_start|>", "<|im_end|>\n"
# Control strings of public chat templates, which may not survive inside a text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    """``text`` with backslashes doubled and control strings broken by a backslash."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def n_tokens(text: Column) -> Column:
    """Tokens that a text is charged without a tokenizer: runs of up to six letters or three digits, and other marks."""
    return F.regexp_count(text, F.lit(PIECES)).cast("long")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """``conv_id, window, text, n_repeats, n_tokens, loss`` of every window of ``turns(conv_id, turn, role, text)``.

    ``tokens`` names a column with each text's token count (null: 0), where a tokenizer
    made one; without it ``n_tokens`` counts. ``MARK_TOKENS`` are added for a turn's marks
    and role. ``window`` orders a conversation's windows and may skip numbers.
    ``n_repeats`` is the number of leading turns that an earlier window held first;
    ``loss`` lists the masked spans of ``text`` as code points ``(start, end)``.
    """
    counted = n_tokens(F.col("text")) if tokens is None else F.coalesce(F.col(tokens).cast("long"), F.lit(0))
    rows = turns.withColumn("text", F.coalesce("text", F.lit(""))).select(
        F.monotonically_increasing_id().alias("row"), "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), "text", (counted + MARK_TOKENS).alias("n"), F.md5("text").alias("tie"),
    )
    cut = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    rows = written(rows.select("row", "conv_id", "conv", "turn", "role", "tie", "n", F.length(cut).cast("long").alias("lead"), F.concat(cut, escaped(F.col("text")), F.lit(END)).alias("turn_text")), "chat-turns")

    # numbers and token counts alone: no text is read until the parts are put together
    blocked = rows.select("row", "conv", "turn", "role", "tie", "n", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))).alias("block"))
    inner = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "tie")
    ordered = blocked.select("row", "conv", "block", "role", "n", (F.row_number().over(inner).cast("long") - 1).alias("at"), (F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ordered = written(ordered, "chat-order")
    outer = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    system = F.max(F.when((F.col("at") == 0) & (F.col("role") == "system"), F.col("n")))
    blocks = ordered.groupBy("conv", "block").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"), system.alias("opens"))
    first = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "conv", "block", F.coalesce(F.sum("rows").over(outer), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("tokens").over(outer), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.first("opens").over(first), F.lit(0)).alias("system_n"),
    )
    at, before = F.col("at") + F.col("rows_before"), F.col("before") + F.col("tokens_before") - F.col("system_n")
    placed = ordered.join(blocks, ["conv", "block"]).select("row", "conv", "n", at.alias("at"), before.alias("before"), F.greatest(budget - history - F.col("system_n"), F.lit(1)).alias("span"), ((at == 0) & (F.col("system_n") > 0)).alias("is_system"))
    cell = F.when(F.col("is_system"), 0).otherwise(F.floor(F.col("before") / F.col("span")))
    placed = placed.withColumn("cell", cell).withColumn("crosses", ~F.col("is_system") & (F.floor((F.col("before") + F.col("n") - 1) / F.col("span")) > F.col("cell")))
    placed = written(placed, "chat-places")

    # of each span: where its inner turns begin, and where its crossing turn begins and ends
    cells = placed.groupBy("conv", "cell").agg(
        F.first("span").alias("span"), F.min(F.when(~F.col("crosses") & ~F.col("is_system"), F.col("before"))).alias("lo"), F.max(F.when(F.col("crosses"), F.col("before"))).alias("across"),
        F.max(F.when(F.col("crosses"), F.col("before") + F.col("n"))).alias("end"), F.max("is_system").alias("opens"),
    )
    begins = F.when(F.col("opens"), F.lit(0)).otherwise(F.col("lo"))
    apart = F.coalesce(F.col("end") - begins > F.col("span"), F.lit(False))
    cells = written(cells.select("conv", "cell", "across", apart.alias("apart"), F.coalesce(begins, "across").alias("begins")), "chat-spans")
    number = lambda late: 2 * F.col("cell") + F.when(late, 1).otherwise(0)
    starts = cells.select("conv", "cell", number(F.lit(False)).alias("window"), "begins").unionByName(cells.where("apart").select("conv", "cell", number(F.lit(True)).alias("window"), F.col("across").alias("begins")))

    # where each turn goes: to its own window, and to those that begin within ``history`` tokens after it begins
    own = placed.join(cells.select("conv", "cell", "apart"), ["conv", "cell"]).select("row", "at", number(F.col("apart") & F.col("crosses")).alias("window"), F.lit(False).alias("again"))
    near = placed.where(~F.col("is_system") & (F.col("n") <= history))
    near = near.select("row", "conv", "at", "before", F.explode(F.sequence(F.floor((F.col("before") + 1) / F.col("span")), F.floor((F.col("before") + history) / F.col("span")))).alias("cell"))
    repeats = near.join(starts, ["conv", "cell"]).where((F.col("begins") > F.col("before")) & (F.col("begins") <= F.col("before") + history)).select("row", "at", "window", F.lit(True).alias("again"))
    heads = placed.where("is_system").select("row", "conv", "at").join(starts.where("window > 0").select("conv", "window"), "conv").select("row", "at", "window", F.lit(True).alias("again"))
    goes = own.unionByName(repeats).unionByName(heads)
    parts = rows.select("row", "conv", "conv_id", "role", "n", "lead", "turn_text").join(goes, "row")
    part = F.struct("at", "turn_text", (~F.col("again") & (F.col("role") == "assistant")).alias("target"), "lead")
    made = parts.groupBy("conv", "conv_id", "window").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum(F.col("again").cast("long")).alias("n_repeats"), F.sum("n").alias("n_tokens"))
    size = lambda p: F.length(p["turn_text"]).cast("long")
    begin = F.aggregate("parts", F.array(F.lit(0).cast("long")), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + size(p))))
    made = made.withColumn("begin", begin)
    span = F.zip_with("parts", F.slice("begin", 1, F.size("parts")), lambda p, b: F.struct(p["target"].alias("target"), (b + p["lead"]).alias("start"), (b + size(p) - len(END)).alias("end")))
    return made.select(
        "conv_id", "window", F.array_join(F.transform("parts", lambda p: p["turn_text"]), "").alias("text"), "n_repeats", "n_tokens",
        F.transform(F.filter(span, lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss"),
    )


def turns_of(text: Column, n_repeats: Column) -> Column:
    """A window's own turns as (role, text), parsed from its text."""
    parts = F.filter(F.split(text, r"<\|im_start\|>"), lambda p: p != "")
    inner = F.transform(F.slice(parts, (n_repeats + 1).cast("int"), F.greatest(F.size(parts), F.lit(1))), lambda p: F.substring(p, F.lit(1), F.length(p) - len(END)))
    pattern = r"(?s)^((?:[^\\\n]|\\.)*)\n(.*)$"
    return F.transform(inner, lambda p: F.struct(unescaped(F.regexp_extract(p, pattern, 1)).alias("role"), unescaped(F.regexp_extract(p, pattern, 2)).alias("text")))


def loss_of(text: Column, loss: Column) -> Column:
    """All text of a window under its loss mask, in order."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(made: DataFrame) -> DataFrame:
    """Per conversation: turns and loss texts as read back from the windows, hashed.

    A hash over a whole conversation needs its windows together; they come as formatted,
    once, and are parsed there.
    """
    told = lambda x: F.array_join(F.transform(turns_of(x["text"], x["n_repeats"]), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "text", "n_repeats", "loss"))).alias("w"), F.sum(F.length("text").cast("long")).alias("formatted_chars"))
    n_turns = F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + F.size(turns_of(x["text"], x["n_repeats"])))
    joined = whole.select("conv_id", "formatted_chars", n_turns.alias("n_turns"), F.array_join(F.transform("w", told), "").alias("told"), F.array_join(F.transform("w", lambda x: loss_of(x["text"], x["loss"])), "").alias("masked"))
    return joined.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")
