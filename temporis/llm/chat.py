"""Chat formatting by Spark expressions: sort turn structs, join adjacent turns of a role, concatenate.

Template: each run of adjacent turns of one role is ``<|begin|>role<|text|>text<|turn|>text<|end|>``. Control strings
start with ``<|``; in roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so that no text can hold
one, and reading back is exact.

Defined cases: a null role or text is empty; a null turn sorts first; rows of equal turn sort by role, then text;
repeated rows are turns of their own; a null conv_id is one conversation; an empty table gives no rows; other columns
are ignored. A conversation is one output row, so its turns meet in one task by definition; all steps are linear in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BEGIN, TEXT, TURN, END = "<|begin|>", "<|text|>", "<|turn|>", "<|end|>"
PLANTED = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _split(text: Column, control: str) -> Column:
    return F.split(text, "\\Q" + control + "\\E", -1)


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, segments: array of (text, in_loss) whose texts, joined, are formatted.

    The segments are the loss mask: exactly the texts of loss_role carry in_loss.
    """
    turns = F.array_sort(
        F.collect_list(
            F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        )
    )
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))

    def segments(t: Column, i: Column) -> Column:
        last = F.size("turns") - 1
        first = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        ends = (i == last) | (F.get("turns", i + 1)["role"] != t["role"])
        head = F.when(first, F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(TEXT))).otherwise(F.lit(TURN))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("in_loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("in_loss")),
            F.struct(F.when(ends, F.lit(END)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("in_loss")),
        )

    out = grouped.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    runs = F.filter(_split(formatted, END), lambda r: r != "")

    def turns(run: Column) -> Column:
        parts = _split(F.substring(run, len(BEGIN) + 1, 2**31 - 1), TEXT)
        return F.transform(
            _split(F.get(parts, F.lit(1)), TURN),
            lambda x: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(x).alias("text")),
        )

    return F.flatten(F.transform(runs, turns))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED).alias("text"),
    )
    done = format_conversations(rows.unionByName(planted))
    read = done.select(
        "conv_id",
        read_back(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["in_loss"]), lambda s: unescape(s["text"])), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    newline = F.lit("\n")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         replace(replace(role, '\\', '\\\\'), '<|', '<\\|') AS erole, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS etext
  FROM c
), r AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY n) = role, false) AS goes_on FROM o
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n), '')) AS loss_sha256,
       CAST(sum(length(etext) + CASE WHEN goes_on THEN 8 ELSE length(erole) + 24 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
