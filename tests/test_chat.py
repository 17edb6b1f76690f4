import pytest
from pyspark.sql import functions as F
from test_training import texts

from glyphmill.model import Profile
from glyphmill.operators import chat
from glyphmill.operators.codec import encode
from glyphmill.operators.training import train_bpe

SCHEMA = (
    "conv_id long, turn long, role string, content string, reasoning_content string, "
    "tool_calls array<struct<name:string,arguments:string>>, tools array<string>"
)


def turns(spark, *messages, tools=None):
    rows = []
    for i, m in enumerate(messages):
        role, content, *rest = m
        extra = rest[0] if rest else {}
        rows.append((7, i, role, content, extra.get("reasoning"), extra.get("calls"), tools))
    return spark.createDataFrame(rows, SCHEMA)


def render(df, **kw):
    return chat.render_chat(df, **kw).first().prompt


U, A, E = "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>\n"


def test_generation_prompt(spark):
    df = turns(spark, ("user", "Hello!"))
    want = f"{U}Hello!{E}{A}"
    assert render(df, add_generation_prompt=True) == want
    assert render(df, add_generation_prompt=True, enable_thinking=False) == want + "<think>\n\n</think>\n\n"


def test_final_answer_gets_an_empty_thought(spark):
    assert render(turns(spark, ("user", "q"), ("assistant", "a"))) == f"{U}q{E}{A}<think>\n\n</think>\n\na{E}"


def test_earlier_reasoning_is_dropped(spark):
    df = turns(spark, ("user", "q"), ("assistant", "<think>\nr\n</think>\n\na"), ("user", "q2"))
    assert render(df) == f"{U}q{E}{A}a{E}{U}q2{E}"


def test_reasoning_after_the_query_is_kept(spark):
    df = turns(
        spark,
        ("user", "q"),
        ("assistant", "x", {"reasoning": "\nwhy\n", "calls": [("f", "{}")]}),
        ("tool", "1"),
        ("assistant", "<think>so</think>\n\ndone"),
    )
    assert render(df) == (
        f"{U}q{E}{A}<think>\nwhy\n</think>\n\nx\n<tool_call>\n{{\"name\": \"f\", \"arguments\": {{}}}}\n</tool_call>{E}"
        f"{U}<tool_response>\n1\n</tool_response>{E}{A}<think>\nso\n</think>\n\ndone{E}"
    )


def test_explicit_reasoning_leaves_content_whole(spark):
    df = turns(spark, ("user", "q"), ("assistant", "a</think>b", {"reasoning": ""}))
    assert render(df) == f"{U}q{E}{A}<think>\n\n</think>\n\na</think>b{E}"


def test_tool_results_share_a_block(spark):
    df = turns(spark, ("user", "q"), ("assistant", "", {"calls": [("f", '{"x": 1}')]}), ("tool", "1"), ("tool", "2"))
    want = (
        f'{U}q{E}{A}<tool_call>\n{{"name": "f", "arguments": {{"x": 1}}}}\n</tool_call>{E}'
        f"{U}<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response>{E}"
    )
    assert render(df) == want


@pytest.mark.parametrize("size", [1, 2, 3])
def test_block_edges_change_nothing(spark, monkeypatch, size):
    df = turns(
        spark, ("system", "s"), ("user", "q"), ("tool", "1"), ("tool", "2"), ("tool", "3"), ("assistant", "a"), ("user", "z")
    )
    whole = render(df)
    monkeypatch.setattr(chat, "BLOCK", size)
    assert render(df) == whole
    assert whole.count("<|im_start|>user") == 3


def test_tools_header(spark):
    tool = '{"type": "function"}'
    text = render(turns(spark, ("system", "be brief"), ("user", "q"), tools=[tool]))
    assert text.startswith("<|im_start|>system\nbe brief\n\n# Tools\n\n")
    assert f"<tools>\n{tool}\n</tools>\n\nFor each" in text
    assert text.endswith(f"</tool_call>{E}{U}q{E}")
    assert render(turns(spark, ("user", "q"), tools=[tool])).startswith("<|im_start|>system\n# Tools")


def test_roles(spark):
    df = turns(spark, ("user", "a"), ("system", "s"), ("user", "b"))
    assert render(df) == f"{U}a{E}<|im_start|>system\ns{E}{U}b{E}"
    assert render(turns(spark, ("user", "a"), ("critic", "no"))) == f"{U}a{E}"
    assert render(turns(spark, ("user", None), ("assistant", "x"))) == f"{U}{E}{A}x{E}"


def test_tool_response_is_not_a_query(spark):
    df = turns(spark, ("user", "q"), ("assistant", "a"), ("user", "<tool_response>1</tool_response>"), ("assistant", "b"))
    assert chat.last_query_turn(df).first().last_query_turn == 0
    assert render(df).count("<think>") == 1


def test_simple_template(spark):
    df = turns(spark, ("user", "你好！"))
    want = "<|im_start|>system\nYou are a helpful assistant<|im_end|>\n<|im_start|>user\n你好！<|im_end|>\n"
    assert chat.render_chat_simple(df).first().prompt == want
    assert chat.render_chat_simple(turns(spark, ("system", "s")), True).first().prompt == f"<|im_start|>system\ns{E}{A}"


def test_split_reasoning_text(spark):
    def python(content):
        if "</think>" not in content:
            return "", content
        return (
            content.split("</think>")[0].rstrip("\n").split("<think>")[-1].lstrip("\n"),
            content.split("</think>")[-1].lstrip("\n"),
        )

    cases = ["a", "<think>\n\nr\n\n</think>\n\na", "x<think>y<think>z</think>b</think>\nc", "</think>", "<think>only", "\n</think>\n"]
    df = texts(spark, *cases).select("doc_id", chat.split_reasoning_text(F.col("text")).alias("s"))
    got = [(r.s.reasoning, r.s.answer) for r in df.orderBy("doc_id").collect()]
    assert got == [python(c) for c in cases]


def test_reasoning_ids(spark):
    df = spark.createDataFrame([(0, [5, 6, 7, 25, 8, 25, 9]), (1, [5, 6, 7, 8]), (2, [5, 6])], "i int, output_ids array<int>")
    rows = chat.cut_reasoning_ids(df, 25, F.lit(2)).orderBy("i").collect()
    assert [(r.reasoning_ids, r.answer_ids) for r in rows] == [([7, 25, 8, 25], [9]), ([], [7, 8]), ([], [])]


def test_reasoning_split_decodes(spark):
    profile = Profile("full", full_byte_alphabet=True)
    model = train_bpe(texts(spark, "ab ab"), 300, 1, profile)
    think_end = profile.specials.index("</think>")
    df = encode(texts(spark, "ask<think>\nwhy\n</think>\n\nyes<|im_end|>"), model, out="output_ids")
    row = chat.split_reasoning_ids(df, model, think_end, F.lit(3)).first()
    assert (row.reasoning, row.answer) == ("why", "yes")


def test_one_conversation_with_most_turns(spark):
    """Five thousand turns in one conversation, far past a block, equal plain Python."""
    roles = ["user", "assistant", "tool", "tool"]
    rows = [(1, i * 3, roles[i % 4], f"m{i}") for i in range(5000)] + [(2, 0, "user", "q"), (2, 5, "tool", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string").repartition(16)
    got = {r.conv_id: r.prompt for r in chat.render_chat(df).collect()}
    parts = []
    for i in range(5000):
        role = roles[i % 4]
        if role == "tool":
            parts.append(("<|im_start|>user" if i % 4 == 2 else "") + f"\n<tool_response>\nm{i}\n</tool_response>")
            parts.append(E if i % 4 == 3 or i == 4999 else "")
        else:
            parts.append(f"<|im_start|>{role}\nm{i}{E}")
    # The last query is turn 4996; the answer after it is not the last message and has no reasoning.
    assert got[1] == "".join(parts)
    assert got[2] == f"{U}q{E}<|im_start|>user\n<tool_response>\nr\n</tool_response>{E}"


def test_null_content_keeps_its_turn_and_the_default_system(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a")], "conv_id int, turn int, role string, content string")
    want = "<|im_start|>system\nYou are a helpful assistant<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert [r.prompt for r in chat.render_chat_simple(turns).collect()] == [want]
