"""Conversations to prompt text, and model output back to reasoning and answer.

A conversation is a set of rows (conv_id, turn, role, content), optionally with
``reasoning_content``, ``tool_calls`` and, on its first turn, ``tools``.  What a turn needs to
know of its neighbours comes from per-block summaries of ``BLOCK`` turns, so no task sorts a
whole long conversation; only the final text of one conversation, a single value, is put
together in one place, from block texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphmill.fixed import DEFAULT_SYSTEM, TOOLS_INTRO, TOOLS_OUTRO
from glyphmill.functions.binding import let as _let
from glyphmill.model import BpeModel
from glyphmill.operators.codec import decoded, encode

BLOCK = 512
START, END = "<|im_start|>", "<|im_end|>"
_CALLS = "array<struct<name:string,arguments:string>>"


def strip_left(col: Column) -> Column:
    return F.regexp_replace(col, r"\A\n+", "")


def strip_right(col: Column) -> Column:
    return F.regexp_replace(col, r"\n+\z", "")


def strip_newlines(col: Column) -> Column:
    return strip_right(strip_left(col))


def _parts(reasoning: Column, answer: Column) -> Column:
    return F.struct(reasoning.alias("reasoning"), answer.alias("answer"))


def split_reasoning_text(col: Column) -> Column:
    """struct(reasoning, answer); text without a closing tag is all answer."""

    def cut(parts: Column) -> Column:
        before = strip_right(F.element_at(parts, 1))
        return _parts(strip_left(F.element_at(F.split(before, "<think>"), -1)), strip_left(F.element_at(parts, -1)))

    return F.when(col.contains("</think>"), _let(F.split(col, "</think>"), cut)).otherwise(_parts(F.lit(""), col))


def is_query(role: Column, content: Column) -> Column:
    """A user message that is not wholly a tool response."""
    wrapped = content.startswith("<tool_response>") & content.endswith("</tool_response>")
    return (role == "user") & content.isNotNull() & ~wrapped


def last_query_turn(turns: DataFrame) -> DataFrame:
    """(conv_id, last_query_turn): the last query, or the last turn when there is none."""
    query = F.when(is_query(F.col("role"), F.col("content")), F.col("turn"))
    return turns.groupBy("conv_id").agg(F.coalesce(F.max(query), F.max("turn")).alias("last_query_turn"))


def with_positions(turns: DataFrame) -> DataFrame:
    """Add first_turn, last_turn, last_query_turn, after_tool and before_tool to every turn.

    Neighbours matter only as tool or not, and a boolean keeps the summary a hash aggregate.
    """
    is_tool = F.coalesce(F.col("role") == "tool", F.lit(False))
    blocked = turns.withColumns({"block": F.floor(F.col("turn") / BLOCK), "_tool": is_tool})
    query = F.when(is_query(F.col("role"), F.col("content")), F.col("turn"))
    blocks = blocked.groupBy("conv_id", "block").agg(
        F.min("turn").alias("_from"),
        F.max("turn").alias("_to"),
        F.min_by("_tool", "turn").alias("_opens"),
        F.max_by("_tool", "turn").alias("_closes"),
        F.max(query).alias("_query"),
    )
    along = Window.partitionBy("conv_id").orderBy("block")
    whole = Window.partitionBy("conv_id")
    blocks = blocks.select(
        "conv_id",
        "block",
        F.lag("_closes", 1, False).over(along).alias("_before"),
        F.lead("_opens", 1, False).over(along).alias("_after"),
        F.min("_from").over(whole).alias("first_turn"),
        F.max("_to").over(whole).alias("last_turn"),
        F.coalesce(F.max("_query").over(whole), F.max("_to").over(whole)).alias("last_query_turn"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    joined = blocked.join(blocks, ["conv_id", "block"])
    return joined.withColumns(
        {
            "after_tool": F.coalesce(F.lag("_tool").over(inside), F.col("_before")),
            "before_tool": F.coalesce(F.lead("_tool").over(inside), F.col("_after")),
        }
    ).drop("_before", "_after", "_tool")


def _with_optional(turns: DataFrame) -> DataFrame:
    for name, kind in (("reasoning_content", "string"), ("tool_calls", _CALLS), ("tools", "array<string>")):
        if name not in turns.columns:
            turns = turns.withColumn(name, F.lit(None).cast(kind))
    return turns


def tool_calls(calls: Column, content: Column) -> Column:
    """Calls as tagged JSON; the arguments are JSON already and go in unchanged."""
    texts = F.transform(
        calls,
        lambda c, i: F.concat(
            F.when((i > 0) | (content != ""), "\n").otherwise(""),
            F.lit('<tool_call>\n{"name": "'),
            F.coalesce(c.getField("name"), F.lit("")),
            F.lit('", "arguments": '),
            F.coalesce(c.getField("arguments"), F.lit("null")),
            F.lit("}\n</tool_call>"),
        ),
    )
    return F.coalesce(F.array_join(texts, ""), F.lit(""))


def tools_header(tools: Column, first_role: Column, first_content: Column) -> Column:
    """The opening system block of a conversation that offers tools."""
    own = F.when(first_role == "system", F.concat(first_content, F.lit("\n\n"))).otherwise("")
    listed = F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), "")
    return F.concat(
        F.lit(f"{START}system\n"), own, F.lit(TOOLS_INTRO), listed, F.lit(TOOLS_OUTRO + f"{END}\n")
    )


def tool_results(content: Column, after_tool: Column, before_tool: Column) -> Column:
    """A tool turn; neighbouring tool turns share one user block."""
    opening = F.when(after_tool, "").otherwise(f"{START}user")
    closing = F.when(before_tool, "").otherwise(f"{END}\n")
    return F.concat(opening, F.lit("\n<tool_response>\n"), content, F.lit("\n</tool_response>"), closing)


def _message(role: Column, content: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), content, F.lit(f"{END}\n"))


def _assistant(content: Column, last: Column, after_query: Column) -> Column:
    given = F.col("reasoning_content")

    def shown(parts: Column) -> Column:
        reasoning, answer = parts["reasoning"], parts["answer"]
        thought = F.concat(F.lit("<think>\n"), strip_newlines(reasoning), F.lit("\n</think>\n\n"), strip_left(answer))
        text = F.when(after_query & (last | (reasoning != "")), thought).otherwise(answer)
        return F.concat(F.lit(f"{START}assistant\n"), text, tool_calls(F.col("tool_calls"), answer), F.lit(f"{END}\n"))

    parts = F.when(given.isNotNull(), _parts(given, content)).otherwise(split_reasoning_text(content))
    return _let(parts, shown)


def _prompt(add_generation_prompt: bool, enable_thinking: bool) -> str:
    if not add_generation_prompt:
        return ""
    return f"{START}assistant\n" + ("" if enable_thinking else "<think>\n\n</think>\n\n")


def render_parts(
    turns: DataFrame, add_generation_prompt: bool = False, enable_thinking: bool = True
) -> DataFrame:
    """(conv_id, block, turn, part): the text each turn contributes."""
    rows = with_positions(_with_optional(turns))
    role, content = F.col("role"), F.coalesce(F.col("content"), F.lit(""))
    first, last = F.col("turn") == F.col("first_turn"), F.col("turn") == F.col("last_turn")
    offers_tools = F.coalesce(F.size("tools") > 0, F.lit(False))
    opening = (
        F.when(first & offers_tools, tools_header(F.col("tools"), role, content))
        .when(first & (role == "system"), _message(role, content))
        .otherwise("")
    )
    body = (
        F.when((role == "user") | ((role == "system") & ~first), _message(role, content))
        .when(role == "assistant", _assistant(content, last, F.col("turn") > F.col("last_query_turn")))
        .when(role == "tool", tool_results(content, F.col("after_tool"), F.col("before_tool")))
        .otherwise("")
    )
    closing = F.when(last, _prompt(add_generation_prompt, enable_thinking)).otherwise("")
    return rows.select("conv_id", "block", "turn", F.concat(opening, body, closing).alias("part"))


def render_simple_parts(turns: DataFrame, add_generation_prompt: bool = False) -> DataFrame:
    """A null role or content counts as empty."""
    rows = with_positions(turns)
    role, content = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "content"))
    first, last = F.col("turn") == F.col("first_turn"), F.col("turn") == F.col("last_turn")
    opening = F.when(first & (role != "system"), f"{START}system\n{DEFAULT_SYSTEM}{END}\n").otherwise("")
    closing = F.when(last, _prompt(add_generation_prompt, True)).otherwise("")
    part = F.concat(opening, _message(role, content), closing)
    return rows.select("conv_id", "block", "turn", part.alias("part"))


def _joined(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    pieces = F.sort_array(F.collect_list(F.struct(order, text)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p.getField(text)), "").alias(text))


def assemble(parts: DataFrame, out: str = "prompt") -> DataFrame:
    """(conv_id, prompt): parts joined within blocks of bounded size, then blocks in order."""
    blocks = _joined(parts, ["conv_id", "block"], "turn", "part")
    return _joined(blocks, ["conv_id"], "block", "part").withColumnRenamed("part", out)


def render_chat(
    turns: DataFrame, add_generation_prompt: bool = False, enable_thinking: bool = True
) -> DataFrame:
    return assemble(render_parts(turns, add_generation_prompt, enable_thinking))


def render_chat_simple(turns: DataFrame, add_generation_prompt: bool = False) -> DataFrame:
    return assemble(render_simple_parts(turns, add_generation_prompt))


def encode_chat(
    turns: DataFrame, model: BpeModel, add_generation_prompt: bool = True, enable_thinking: bool = True
) -> DataFrame:
    """(conv_id, prompt, input_ids); the template's special texts become single ids."""
    return encode(render_chat(turns, add_generation_prompt, enable_thinking), model, "prompt")


def cut_reasoning_ids(df: DataFrame, think_end: int, prompt_length: Column, ids: str = "output_ids") -> DataFrame:
    """Add reasoning_ids and answer_ids: the prompt goes, the cut is after the last think-end id."""
    size = F.greatest(F.size(ids) - prompt_length, F.lit(0))
    rows = df.withColumn("_new", F.slice(F.col(ids), prompt_length + 1, size))
    ends = F.transform("_new", lambda x, i: F.when(x == think_end, i + 1).otherwise(0))
    rows = rows.withColumn("_cut", F.coalesce(F.array_max(ends), F.lit(0)))
    return rows.withColumns(
        {
            "reasoning_ids": F.slice("_new", 1, F.col("_cut")),
            "answer_ids": F.slice("_new", F.col("_cut") + 1, F.size("_new") - F.col("_cut")),
        }
    ).drop("_new", "_cut")


def split_reasoning_ids(
    df: DataFrame, model: BpeModel, think_end: int, prompt_length: Column, ids: str = "output_ids"
) -> DataFrame:
    """Cut, then decode both halves without specials and without surrounding newlines."""
    rows = cut_reasoning_ids(df, think_end, prompt_length, ids)
    return rows.withColumns(
        {
            "reasoning": strip_newlines(decoded(F.col("reasoning_ids"), model, skip_special=True)),
            "answer": strip_newlines(decoded(F.col("answer_ids"), model, skip_special=True)),
        }
    )
