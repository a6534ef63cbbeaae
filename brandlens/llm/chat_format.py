"""Chat formatting with Spark expressions alone: no Python runs on the executors.

Template: ``<|role|>text<|end|>`` for each block of adjacent turns of one role, with ``<|next|>`` between the turns
of a block. Inside roles and texts ``&``, ``<``, ``|`` and ``[`` are written as entities, so no control string, neither the
template's nor another's such as ``</s>`` or ``[INST]``, can appear in them; the entities are undone on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("|", "&bar;"), ("[", "&lbr;"))
END, NEXT = "<|end|>", "<|next|>"


def escape(c: Column) -> Column:
    for plain, entity in ENTITIES:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def unescape(c: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_spans, what is under the loss mask: start and length in code
    points, byte_start and byte_length in UTF-8.

    Turns are ordered by turn (nulls first), ties by role, then text. A null role or text is empty; a null conv_id is
    a conversation of its own; repeated rows are turns of their own; other columns are ignored; an empty table gives
    no rows. A conversation is one record: its turns meet in one task, as its text must. Work grows with the turns and the
    text, not with their square: places in the text are running sums over the sorted turns.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    struct = F.struct(F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(struct)).alias("turns"))
    # the rows of a conversation stay where they are: nothing is shuffled from here on
    rows = sorted_turns.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", "pos", "t.role", "t.text")
    order = Window.partitionBy("conv_id").orderBy("pos")
    # adjacent turns of one role merge into one block
    before = F.lag("role").over(order)
    opens = F.concat(F.when(F.col("pos") > 0, F.lit(END)).otherwise(F.lit("")), F.lit("<|"), escape(F.col("role")), F.lit("|>"))
    pieces = rows.select("conv_id", "pos", (F.col("role") == loss_role).alias("loss"), F.when(before.isNull() | (before != F.col("role")), opens).otherwise(F.lit(NEXT)).alias("head"), escape(F.col("text")).alias("body"))
    measured = pieces.select("*", F.length("body").alias("length"), F.octet_length("body").alias("byte_length"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ends = lambda size: F.sum(size(F.col("head")) + size(F.col("body"))).over(upto)
    placed = measured.select("*", (ends(F.length) - F.col("length")).alias("start"), (ends(F.octet_length) - F.col("byte_length")).alias("byte_start"))
    span = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("start", "length", "byte_start", "byte_length")])
    said = F.array_sort(F.collect_list(F.struct("pos", F.concat("head", "body").alias("s"))))
    return (
        placed.groupBy("conv_id")
        .agg(said.alias("said"), F.array_sort(F.collect_list(F.when(F.col("loss"), span))).alias("loss_spans"))
        .select("conv_id", F.concat(F.array_join(F.transform("said", lambda x: x["s"]), ""), F.lit(END)).alias("formatted"), "loss_spans")
    )


def read_turns(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    read = F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.regexp_extract(b, r"^<\|([^|]*)\|>", 1)).alias("role"), F.split(F.regexp_extract(b, r"(?s)^<\|[^|]*\|>(.*)$", 1), r"<\|next\|>").alias("texts")
        ),
    )
    return F.flatten(F.transform(read, lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), unescape(x).alias("text")))))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped; cut by bytes, which needs no walk from the start of the text."""
    cut = lambda raw, s: F.substring(raw, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string")
    # as an element of an array the bytes are made once, not for each span
    return F.get(F.transform(F.array(formatted.cast("binary")), lambda raw: F.array_join(F.transform(spans, lambda s: unescape(cut(raw, s))), "")), F.lit(0))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation (and for -1, which holds control strings): lengths and digests read back from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    chats = format_chats(rows.unionByName(extra))
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP4_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '|', '&bar;'), '[', '&lbr;')) AS text_chars,
    length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&bar;'), '[', '&lbr;')) AS role_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before IS NULL OR before <> role THEN role_chars + 4 + 7 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
