"""The tool-call grammar: turns of a reasoning model -> one row for each call, with its arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temporis.functions import text as T

#: Tools in the order they run, with the results each asks for by default. An image query gets one more than is asked for, ten by default.
TOOLS = (
    ("video_reader", None),
    ("video_browser", None),
    ("video_segment_retriever_textual_query", 5),
    ("video_segment_retriever_image_query", 9),
    ("subtitle_retriever", 15),
    ("subtitle_extractor", None),
)
#: The reader's pair of tags, the browser's tag.
READER = r"<video_reader>([^<]+)</video_reader>\s*<video_reader_question>([^<]+)</video_reader_question>"
BROWSER_TAG = "video_browser_question"


def _located(text: Column, tag: str) -> Column:
    """array of (body, at): bodies of a tag with the number of characters before each."""
    bodies = T.tag_bodies(text, tag)
    gaps = F.split(text, f"(?s)<{tag}>.*?</{tag}>", -1)
    extra = 2 * len(tag) + 5
    before = lambda i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda s, g: s + F.length(g)) + F.aggregate(F.slice(bodies, F.lit(1), i), F.lit(0), lambda s, b: s + F.length(b) + extra)
    return F.transform(bodies, lambda b, i: F.struct(b.alias("body"), before(i).alias("at")))


def parse(turns: DataFrame, compat: str = "literal", subtitle_k: int = 15) -> DataFrame:
    """turns (conv_id, turn, text) -> conv_id, turn, priority, call_no, tool, body, question, topk.

    topk of retriever calls: literal takes the j-th <topk> of the turn for the j-th call of each tool; scoped takes the
    nearest <topk> that follows the call. What isn't a whole number counts as the tool's default.
    """
    clean = T.after_thinking(F.col("text"))
    topks = _located(clean, "topk")
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("int")

    def call(priority: int, tool: str, body: Column, question: Column, topk: Column, call_no: Column) -> Column:
        return F.struct(
            F.lit(priority).alias("priority"), call_no.alias("call_no"), F.lit(tool).alias("tool"), body.alias("body"), question.alias("question"), topk.alias("topk")
        )

    def of_tool(priority: int, tool: str, default: int | None) -> Column:
        if tool == "video_reader":
            pairs = F.arrays_zip(F.regexp_extract_all(clean, F.lit(READER), F.lit(1)).alias("b"), F.regexp_extract_all(clean, F.lit(READER), F.lit(2)).alias("q"))
            return F.transform(pairs, lambda p, j: call(priority, tool, p["b"], p["q"], no_number, j))
        if tool == "video_browser":
            first = F.slice(T.tag_bodies(clean, BROWSER_TAG, across_markup=False), 1, 1)
            return F.transform(first, lambda b, j: call(priority, tool, no_text, b, no_number, j))
        if default is None:
            return F.transform(T.tag_bodies(clean, tool), lambda b, j: call(priority, tool, b, no_text, no_number, j))
        k = F.lit(subtitle_k if tool == "subtitle_retriever" else default)

        def literal(b: Column, j: Column) -> Column:
            return call(priority, tool, b, no_text, F.coalesce(T.whole_number(F.get(topks, j)["body"]), k), j)

        def scoped(c: Column, j: Column) -> Column:
            nearest = F.get(F.filter(topks, lambda t: t["at"] > c["at"]), F.lit(0))["body"]
            return call(priority, tool, c["body"], no_text, F.coalesce(T.whole_number(nearest), k), j)

        return F.transform(T.tag_bodies(clean, tool), literal) if compat == "literal" else F.transform(_located(clean, tool), scoped)

    calls = [of_tool(priority, tool, default) for priority, (tool, default) in enumerate(TOOLS)]
    return turns.select("conv_id", "turn", F.explode(F.concat(*calls)).alias("c")).select("conv_id", "turn", "c.*")


def sub_calls(calls: DataFrame) -> DataFrame:
    """A row for each sub-query of retriever and extractor calls: sub_no, sub_query."""
    return calls.select("*", F.posexplode(T.sub_queries(F.col("body"))).alias("sub_no", "sub_query"))


def ranges(calls: DataFrame, several: bool = False) -> DataFrame:
    """begin_s, end_s of calls whose body is b:e (or several of them, separated by semicolons); malformed ones go."""
    out = calls.withColumn("part", F.explode(F.split("body", ";"))) if several else calls.withColumn("part", F.col("body"))
    ends = F.split("part", ":")
    number = lambda k: F.trim(F.get(ends, F.lit(k))).try_cast("double")
    return out.withColumn("begin_s", number(0)).withColumn("end_s", number(1)).where("begin_s is not null and end_s is not null").drop("part")


def results(rows: DataFrame) -> DataFrame:
    """conv_id, turn, tool_result, tools: the results of a turn's calls one after the other, in order of tool and call, and of sub-query
    where rows have sub_no."""
    order = [c for c in ("priority", "call_no", "sub_no") if c in rows.columns]
    ordered = F.array_sort(F.collect_list(F.struct(*order, "result")))
    return rows.groupBy("conv_id", "turn").agg(F.array_join(F.transform(ordered, lambda x: x["result"]), "").alias("tool_result"), F.array_sort(F.collect_set("tool")).alias("tools"))


#: How a call's result is told to the model, of the tools that ask a vision model and of those that search.
TOLD = {"video_reader": ("The tool result of <video_reader>", "</video_reader> is:\n "), "video_browser": ("The tool result of <video_browser_question>", "</video_browser_question> is:\n ")}
TOLD_SEARCH = ("The tool results for <", "> are:\n")


def result_text(tool: Column, body: Column, found: Column) -> Column:
    """How a call's result is told to the model. body is the question for the browser."""
    out = F.concat(F.lit(TOLD_SEARCH[0]), tool, F.lit(">"), body, F.lit("</"), tool, F.lit(TOLD_SEARCH[1]), found, F.lit("\n"))
    for name, (before, after) in TOLD.items():
        out = F.when(tool == name, F.concat(F.lit(before), body, F.lit(after), found, F.lit("\n"))).otherwise(out)
    return out


def quoted(text: Column) -> Column:
    """A string as the model is shown it within a list: in single quotes, or in double ones if it holds a single one only."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, said in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(said))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    in_single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(in_single)


def listed(parts: Column) -> Column:
    """Strings as one list; an empty one for null."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(parts, ", "), F.lit("")), F.lit("]"))


def answers_by_call(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Queries with their answers by (conv_id, turn, call_no), not by place in a list."""
    return queries.join(answers, ["conv_id", "turn", "call_no"], "left")
