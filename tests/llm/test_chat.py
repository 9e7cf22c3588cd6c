"""Chat formatting: exact round trips."""

import hashlib

from skein.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "be good"), (1, 1, "user", "hi & <bye> [x]"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "user", "&lt;&amp;&#91;"),
    (1, 4, "assistant", ""), (1, 5, "user", "last"), (2, 0, "user", None), (2, 1, "assistant", "日本 \U0001f600\n\n"), (3, 0, "user", "alone"),
    (4, 0, "assistant", "x" * 50_000), (4, 0, "assistant", "x" * 50_000), (None, None, None, None), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"),
    (6, 0, "<s>[ROLE]", "[/ROLE]</s>"), (6, 1, "assistant", "a[/ROLE]b"),
]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_reads_back_what_went_in(spark):
    got = chat.read_back(chat.examples(spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as example", "'m' as whole"))).collect()
    assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in got} == brute(ROWS)


def test_one_example_for_each_reply(spark):
    ex = chat.examples(spark.createDataFrame(ROWS, SCHEMA)).orderBy("conv_id", "example").collect()
    one = [x for x in ex if x.conv_id == 1]
    assert len(one) == 3 and [x.is_whole for x in one] == [False, False, True]
    assert one[0].text[one[0].mask_start : one[0].mask_end] == "&lt;/s>&#91;INST] ok &#91;/INST]"
    assert one[1].text.startswith(one[0].text) and one[2].mask_start == one[2].mask_end
    for x in ex:
        inner = x.text[x.mask_start : x.mask_end]
        assert "<" not in inner and "[" not in inner
        assert x.text.count("</s>") == x.text.count("<s>") == x.text.count("[ROLE]") == x.text.count("[/ROLE]")


def test_formatted_chars(spark):
    df = chat.examples(spark.createDataFrame(ROWS, SCHEMA))
    total = {}
    for x in df.collect():
        total[x.conv_id] = total.get(x.conv_id, 0) + len(x.text)
    assert {x.conv_id: x.formatted_chars for x in chat.read_back(df).collect()} == total


def test_empty_table(spark):
    assert chat.read_back(chat.examples(spark.createDataFrame([], SCHEMA))).count() == 0


def test_plan_has_no_python(spark):
    plan = chat.read_back(chat.examples(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
