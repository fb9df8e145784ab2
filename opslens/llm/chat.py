"""Chat formatting that a deterministic parser reads back exactly.

A turn is rendered as ``### role: body``, a line feed, ``</turn>`` and a line feed. The
grammar knows two control strings, a run of three or more ``#`` and ``</turn>``; both are
escaped by one backslash in front, and reading takes one backslash away. Every text is
first rendered as it is; where the parser does not give the text back (a control string
or an escaped one inside), the escaped form is taken, which always does.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "\n</turn>\n"
CONTROL = r"#{3,}|</turn>"
#: Characters that a role may not show, with their codes; the percent sign is decoded last.
ROLE_CODES = [("%", "%25"), (":", "%3A"), ("\n", "%0A"), ("#", "%23"), ("<", "%3C"), ("\\", "%5C")]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", "$1$2")


def read_body(body: Column) -> Column:
    """The text of a body; null where an unescaped control string breaks the grammar."""
    return F.when(body.rlike(r"(?<![\\#])#{3}|(?<!\\)</turn>"), F.lit(None)).otherwise(unescape(body))


def role_code(role: Column) -> Column:
    return reduce(lambda r, c: F.replace(r, F.lit(c[0]), F.lit(c[1])), ROLE_CODES, role)


def read_role(code: Column) -> Column:
    return reduce(lambda r, c: F.replace(r, F.lit(c[1]), F.lit(c[0])), reversed(ROLE_CODES), code)


def render(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, loss spans, and a digest of the source turns.

    Turns stand in the order of turn, then role and text where turns tie (repeated rows
    stay repeated). Null roles and texts count as empty; a null conv_id is one
    conversation. A conversation is one output row, so its turns meet in one task. A span
    gives start and end in code points, with the number and start of its turn.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    plain, escaped = F.col("text"), escape(F.col("text"))
    rows = rows.withColumn("body", F.when(read_body(plain).eqNullSafe(plain), plain).otherwise(escaped))
    rows = rows.withColumn("head", F.concat(F.lit("### "), role_code(F.col("role")), F.lit(": ")))
    rows = rows.withColumns({"h": F.length("head"), "b": F.length("body"),
                             "n": F.length("head") + F.length("body") + len(END)})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({"no": F.row_number().over(order), "stop": F.sum("n").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "no", "role", "text", "head", "body", "h", "b", "n", "stop"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["role"] == loss_role), lambda x: F.struct(
        (x["stop"] - x["n"] + x["h"]).alias("start"), (x["stop"] - len(END)).alias("end"),
        x["no"].alias("turn_no"), (x["stop"] - x["n"]).alias("turn_start")))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"), _digest(F.col("t")).alias("source_sha256"))


def _digest(turns: Column) -> Column:
    return F.sha2(F.array_join(F.transform(turns, lambda x: F.concat(
        x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)


def parse(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts read back from ``formatted`` and ``loss_spans``, and whether they match the source."""
    chunks = F.split(F.col("formatted"), END)
    rows = formatted.withColumn("chunks", F.slice(chunks, 1, F.size(chunks) - 1))
    colon = lambda c: F.instr(c, ": ")  # noqa: E731  a coded role has no colon
    rows = rows.withColumns({
        "turns": F.transform("chunks", lambda c: F.struct(
            read_role(c.substr(F.lit(5), colon(c) - 5)).alias("role"),
            read_body(c.substr(colon(c) + 2, F.length(c))).alias("text"))),
        "loss_text": F.array_join(F.transform("loss_spans", lambda s: unescape(F.get(F.col("chunks"), s["turn_no"] - 1).substr(
            (s["start"] - s["turn_start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""),
    })
    rows = rows.withColumn("turns_sha256", _digest(F.col("turns")))
    return rows.withColumn("identical", F.col("turns_sha256") == F.col("source_sha256")).drop("chunks")
