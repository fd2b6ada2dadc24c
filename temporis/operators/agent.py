"""The conversation state machine: set-at-a-time rounds over all live conversations, and replay of recorded ones."""

from __future__ import annotations

import asyncio
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temporis.functions import text as T
from temporis.operators import calls

#: The most rounds, and what the host says to the model.
MAX_ROUNDS = 20
INVALID = "Invalid output format! Please use the provided XML format for tools or provide final answer in <answer></answer>."
FORCE = "Maximum rounds reached! Please provide your final answer in <answer></answer> format!"
NO_ANSWER = "No final answer provided within maximum rounds"
ROUNDS_LEFT = ("\nYou have ", " rounds remaining. Please make the most of each opportunity!")
TOOL_TAGS = ("<video_reader_question>", "<video_browser_question>", "<video_segment_retriever_textual_query>", "<video_segment_retriever_image_query>", "<subtitle_retriever>", "<subtitle_extractor>")


def has_answer(text: Column) -> Column:
    return F.contains(text, F.lit("<answer>"))


def has_tool(text: Column) -> Column:
    out = F.lit(False)
    for tag in TOOL_TAGS:
        out = out | F.contains(text, F.lit(tag))
    return out


def accepted(text: Column, evaluation: bool = False) -> Column:
    """A demo takes an answer at once; an evaluation only in a turn without tool calls."""
    return has_answer(text) & ~has_tool(text) if evaluation else has_answer(text)


def rounds_left(round_no: Column, most: int = MAX_ROUNDS) -> Column:
    return most - round_no - 1


def reply(text: Column, tool_result: Column, round_no: Column, most: int = MAX_ROUNDS, compat: str = "fixed") -> Column:
    """The host's message after a turn without an accepted answer. The call for a final answer comes in time for the model to
    see it (fixed), or in the last round, when it is never sent (literal)."""
    told = F.concat(tool_result, F.lit(ROUNDS_LEFT[0]), rounds_left(round_no, most).cast("string"), F.lit(ROUNDS_LEFT[1]))
    force_at = most - 1 if compat == "literal" else most - 2
    return F.when(F.coalesce(tool_result, F.lit("")) != "", told).when(round_no >= force_at, F.lit(FORCE)).otherwise(F.lit(INVALID))


def replay(turns: DataFrame, evaluation: bool = False, most: int = MAX_ROUNDS) -> DataFrame:
    """conv_id, rounds, answer, n_messages, tool_turns of recorded transcripts (conv_id, turn, role, text).

    The first accepted assistant turn ends a conversation; later turns don't count.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    is_assistant = F.col("role") == "assistant"
    numbered = turns.withColumn("round_no", F.sum(F.when(is_assistant, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    ends = is_assistant & accepted(F.col("text"), evaluation) & (F.col("round_no") < most)
    ended = numbered.withColumn("_end", F.when(ends, F.col("turn")))
    ended = ended.withColumn("_end", F.min("_end").over(Window.partitionBy("conv_id")))
    live = ended.where(F.col("_end").isNull() | (F.col("turn") <= F.col("_end"))).where(F.col("round_no") < most)
    final = F.max(F.when(F.col("turn") == F.col("_end"), T.answer_letter(F.col("text"), F.col("text"))))
    return live.groupBy("conv_id").agg(
        F.count_if(is_assistant).alias("rounds"),
        F.coalesce(final, F.lit(NO_ANSWER)).alias("answer"),
        F.count("*").alias("n_messages"),
        F.count_if(is_assistant & has_tool(F.col("text"))).alias("tool_turns"),
    )


def with_retry(call: calls.Model, tries: int = 3, wait: float = 0.0) -> Callable[[str], tuple[str | None, str]]:
    """One model call that is tried again; (text, status), and status "failed" when all tries fail."""

    def run(prompt: str) -> tuple[str | None, str]:
        async def once() -> tuple[str | None, str, int]:
            return await calls.Pool(call, 1, tries, wait).call(prompt)

        return asyncio.run(once())[:2]

    return run


def ask(prompts: DataFrame, model: calls.Model, tries: int = 3, wait: float = 0.0, **limits) -> DataFrame:
    """prompts (conv_id, prompt) -> conv_id, text, status; the plug-in runs inside the tasks, many conversations at once (see calls.py)."""
    return calls.ask(prompts.select(F.col("conv_id").cast("long"), "prompt"), model, "prompt", tries=tries, wait=wait, **limits).select("conv_id", "text", "status")


def run_rounds(
    start: DataFrame, model: calls.Model, tools: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, str], DataFrame], evaluation: bool = False, most: int = MAX_ROUNDS, drop: Callable[..., None] = lambda *_: None, **limits
) -> DataFrame:
    """conv_id, turn, role, text, status of all conversations that start (conv_id, text) opens.

    A round is one step over all live conversations: ask the model, run the tools (a function of conv_id, turn, text that returns
    conv_id, tool_result), answer. save(df, name) writes a table and reads it back, so plans stay short and rounds survive
    lost executors; each round adds its own two tables to the log, and none is written again. What a conversation's model is told grows by a round's
    turns: the prompts of the live ones are a table that the next round's takes the place of (drop deletes the old one); the log isn't
    read again. The driver only asks whether any conversation is live.
    """
    columns = ["conv_id", "turn", "role", "text", "status"]
    turn = lambda rows, k, role, status: rows.select("conv_id", F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.coalesce("text", F.lit("")).alias("text"), status)
    ok = F.lit("ok").alias("status")
    log = save(turn(start, 0, "user", ok), "rounds-log").select(*columns)
    prompts = save(log.select("conv_id", F.concat(F.lit("user: "), "text").alias("prompt")), "rounds-prompts")
    for round_no in range(most):
        said = save(ask(prompts, model, **limits), f"rounds-said-{round_no}")
        goes_on = said.where((F.col("status") == "ok") & ~accepted(F.coalesce("text", F.lit("")), evaluation))
        done = tools(goes_on.select("conv_id", F.lit(2 * round_no + 1).cast("long").alias("turn"), "text"))
        answered = goes_on.select("conv_id", "text").join(done.select("conv_id", "tool_result"), "conv_id", "left")
        host = answered.select("conv_id", reply(F.col("text"), F.col("tool_result"), F.lit(round_no), most).alias("text"))
        host = save(host, f"rounds-host-{round_no}")
        log = log.unionByName(turn(said, 2 * round_no + 1, "assistant", F.col("status"))).unionByName(turn(host, 2 * round_no + 2, "user", ok))
        if host.isEmpty():
            break
        told = goes_on.select("conv_id", F.col("text").alias("_said")).join(host.select("conv_id", F.col("text").alias("_host")), "conv_id")
        longer = F.concat("prompt", F.lit("\nassistant: "), "_said", F.lit("\nuser: "), "_host")
        before, prompts = prompts, save(prompts.join(told, "conv_id").select("conv_id", longer.alias("prompt")), "rounds-prompts")
        drop(before)
    drop(prompts)
    return log


def prompt_choice(has_subtitles: Column, dataset: Column, known: dict[str, str], with_subtitles: str, without: str) -> Column:
    """The prompt's name: by subtitles, then by dataset; an unknown dataset without subtitles is an error."""
    out = F.when(has_subtitles, F.lit(with_subtitles))
    for name, prompt in known.items():
        out = out.when(dataset == name, F.lit(prompt))
    return out.when(dataset.isNull(), F.lit(without)).otherwise(F.raise_error(F.concat(F.lit("no prompt for dataset "), dataset)).cast("string"))


def frame_content(frames: Column, times: Column, question: Column, timestamps: bool = True) -> Column:
    """The parts of a message to a vision model: each frame (after its time, if timestamps), then the question."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    said = lambda t: F.concat(F.lit("["), t.cast("string"), F.lit(" second]"))
    each = F.transform(F.arrays_zip(frames.alias("f"), times.alias("t")), lambda x: F.array(*([part("text", said(x["t"]))] if timestamps else []), part("image_url", x["f"])))
    return F.concat(F.flatten(each), F.array(part("text", question)))


def step_events(calls: DataFrame) -> DataFrame:
    """A started and a completed event for each call, numbered within the conversation."""
    both = calls.withColumn("status", F.explode(F.array(F.lit("started"), F.lit("completed"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "priority", "call_no", F.desc("status"))
    return both.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), F.lit("tool_call").alias("type"), "status", "tool", F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("attrs"))
