"""Chat formatting: one training example for each assistant turn, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that mark something here or in other common templates; none is a prefix of another.
CONTROLS = ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")


def escape(text: Column) -> Column:
    r"""Double each backslash, then put one behind the first character of each control string.

    After the first step runs of backslashes are even, so a single one behind that character can
    only come from the second: ``unescape`` gives every text back, and no control string is left.
    """
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    for c in CONTROLS:
        text = F.replace(text, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def prefix_examples(turns: DataFrame) -> DataFrame:
    """Every assistant turn as an example of its own, with all turns before it as context.

    turns: conv_id, turn, role, text; other columns are ignored.  Returns a row per example:
    conv_id, example (1-based), n_turns, final (it holds the whole conversation), formatted,
    loss_start and loss_chars (code points; the reply's escaped text is all that is trainable).
    Turns behind the last reply, or of a conversation without one, come in a final row with an
    empty loss mask, so that no turn is lost.

    Null role or text is empty.  Turns are ordered by turn (null first), ties by role and text;
    repeated rows are repeated turns; a null conv_id is a conversation; an empty table gives none.
    An example is one string with its whole context, so a conversation is the least unit of work.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def marked(t: Column) -> Column:
        return F.struct(
            (t["role"] == "assistant").alias("reply"),
            F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY)).alias("head"),
            escape(t["text"]).alias("body"),
        )

    talks = talks.select("conv_id", F.transform("turns", marked).alias("marked"))
    whole = F.transform("marked", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    talks = talks.select("conv_id", "marked", whole.alias("whole"), F.size("marked").alias("n"))
    each = talks.select("conv_id", "whole", "n", F.posexplode("marked").alias("pos", "t"))
    each = each.where(F.col("t.reply") | (F.col("pos") == F.col("n") - 1))
    context = F.array_join(F.slice("whole", F.lit(1), F.col("pos")), "")
    each = each.select(
        "conv_id",
        (F.col("pos") + 1).cast("long").alias("n_turns"),
        (F.col("pos") == F.col("n") - 1).alias("final"),
        F.concat(context, F.col("t.head")).alias("lead"),
        F.when(F.col("t.reply"), F.length("t.body")).otherwise(0).cast("long").alias("loss_chars"),
        F.col("t.reply").alias("trainable"),
        F.concat(F.col("t.body"), F.lit(CLOSE)).alias("tail"),
    )
    return each.select(
        "conv_id", "n_turns", "final", "trainable",
        F.length("lead").cast("long").alias("loss_start"), "loss_chars", F.concat("lead", "tail").alias("formatted"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its formatted examples say: turns, loss text and sizes.

    Columns: conv_id, n_turns, turns_sha256 (role, newline, text, newline for each turn),
    loss_chars and loss_sha256 (all text under the loss masks, unescaped, in order),
    formatted_chars (over all its examples), n_examples.
    """
    masked = F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int"))
    pieces = F.split("formatted", r"<\|turn\|>")  # the first is what stands before the first turn
    parts = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def said(part: Column) -> Column:
        role = F.substring_index(part, BODY, 1)
        rest = F.substring(part, F.length(role) + len(BODY) + 1, F.length(part) - F.length(role) - len(BODY + CLOSE))
        return F.concat(unescape(role), F.lit("\n"), unescape(rest), F.lit("\n"))

    turns = F.when(F.col("final"), F.struct(F.size(parts).alias("n"), F.sha2(F.array_join(F.transform(parts, said), ""), 256).alias("sha")))
    read = examples.select(
        "conv_id", "n_turns", "trainable", unescape(masked).alias("reply"), turns.alias("turns"), F.length("formatted").cast("long").alias("chars"),
    )
    talks = read.groupBy("conv_id").agg(
        F.max("turns").alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("n_turns", "reply")))).alias("replies"),
        F.sum("chars").alias("formatted_chars"),
        F.sum(F.col("trainable").cast("long")).alias("n_examples"),
    )
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    return talks.select(
        "conv_id",
        F.col("turns.n").cast("long").alias("n_turns"),
        F.col("turns.sha").alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
