"""Chat formatting by Spark expressions alone.

Turns are collected as structs, sorted, and adjacent turns of one role are
merged into one segment. A conversation becomes

    <|turn|>ROLE<|text|>TEXT<|end|>            one turn
    <|turn|>ROLE<|text|>TEXT<|more|>TEXT<|end|>  two turns of one role

and a list of pieces with a loss flag, whose concatenation is that string.
Control strings inside roles and texts are escaped by one backslash after
their first character, one more if some stand there already, so that reading
back is exact.

Defined cases: a null role or text is an empty one; rows sort by turn (null
first), then role, then text; repeated rows are turns of their own; rows whose
conv_id is null form one conversation; no rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
#: The head of a control string, backslashes, and what makes it one: markers of
#: this template and of other common ones.
CONTROL = r"([<\[])(\\*)(\||/s>|s>|<SYS>>|/SYS>>|/?INST\])"
CONTROL_ESCAPED = r"([<\[])\\(\\*)(\||/s>|s>|<SYS>>|/SYS>>|/?INST\])"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_ESCAPED, "$1$2$3")


def _literal(marker: str) -> str:
    return rf"\Q{marker}\E"


def format_chats(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """conv_id, formatted string, pieces array<struct<piece string, loss boolean>>."""
    turn = F.struct(
        "turn",
        escape(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    turns = (
        conversations.select("conv_id", turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("ts"))
        .withColumn("starts", F.expr("filter(sequence(0, size(ts) - 1), i -> i = 0 OR ts[i].role != ts[greatest(i - 1, 0)].role)"))
        .withColumn("ends", F.expr("concat(slice(starts, 2, size(starts)), array(size(ts)))"))
        .withColumn("runs", F.expr("transform(arrays_zip(starts, ends), r -> slice(ts, r.starts + 1, r.ends - r.starts))"))
    )
    learned = escape(F.lit(trained))

    def of_run(run: Column) -> Column:
        role = run[0]["role"]
        texts = F.transform(
            run,
            lambda t, i: F.array(
                F.struct(F.when(i == 0, F.concat(F.lit(TURN), role, F.lit(TEXT))).otherwise(F.lit(MORE)).alias("piece"), F.lit(False).alias("loss")),
                F.struct(t["text"].alias("piece"), (role == learned).alias("loss")),
            ),
        )
        return F.concat(F.flatten(texts), F.array(F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss"))))

    pieces = turns.select("conv_id", F.flatten(F.transform("runs", of_run)).alias("pieces"))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """The turns array<struct<role, text>> of a formatted string."""
    segments = F.filter(F.split(formatted, _literal(END), -1), lambda s: s != "")

    def of_segment(segment: Column) -> Column:
        role = F.regexp_replace(F.substring_index(segment, TEXT, 1), "^" + _literal(TURN), "")
        body = F.regexp_replace(segment, rf"(?s)^{_literal(TURN)}.*?{_literal(TEXT)}", "")
        return F.transform(
            F.split(body, _literal(MORE), -1),
            lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")),
        )

    return F.flatten(F.transform(segments, of_segment))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, as it stood before it was escaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["piece"])), "")
