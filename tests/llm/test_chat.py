"""Chat formatting: round trip by an independent parser, and the registered query against DuckDB."""

import random
import re
from collections import defaultdict

import pytest

from innsight.llm import chat as C, queries
from innsight.oracle.compare import duckdb_connection

SF = "/root/testdata/sf0.01"
MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "[ROLE]", "[/ROLE]", "[MSG]"]


def read(formatted):
    """Splits at unescaped marks and reads the turns one mark after the other."""
    parts = re.split("(" + "|".join(map(re.escape, MARKS)) + ")", formatted)

    def plain(x):
        return re.sub(r"([<\[])\\(\\*)(/?(?:s>|INST\]|SYS\]|ANS\]|ROLE\]|MSG\]))", r"\1\2\3", x)
    assert parts[:3] == ["", "<s>", ""]
    at, out = 3, []
    opens = {"[INST]": ("user", "[/INST]"), "[SYS]": ("system", "[/SYS]"), "[ANS]": ("assistant", "</s>")}
    while at < len(parts):
        mark, body, end = parts[at:at + 3]
        if mark == "[ROLE]":
            assert end == "[MSG]" and parts[at + 4] == "[/ROLE]"
            out.append((plain(body[1:-1]), plain(parts[at + 3][1:-1])))
            after, at = parts[at + 5], at + 6
        else:
            role, closing = opens[mark]
            assert end == closing and body[0] == body[-1] == " "
            out.append((role, plain(body[1:-1])))
            after, at = parts[at + 3], at + 4
        assert after == ""
    return out


random.seed(12)
PIECES = [*MARKS, "\\", "[\\INST]", "<\\\\/s>", "[", "<", "/", " ", "\n", "text", "é", "日", "$1", "s>", "INST]"]


def rows():
    out = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, None, None, None),
           (None, 0, "user", "x"), (5, 1, "assistant", ""), (5, 1, "assistant", ""), (5, 0, "[MSG] odd </s>", "a [MSG] b"),
           (6, 0, "user", "x" * 300_000), (6, 1, "assistant", "[INST" * 20_000)]
    for c in range(100, 160):
        for t in range(random.randint(1, 6)):
            role = random.choice(["user", "assistant", "system", "tool", "".join(random.choices(PIECES, k=3))])
            out.append((c, t, role, "".join(random.choices(PIECES, k=random.randint(0, 14)))))
    out += [(7, t, random.choice(["user", "assistant"]), f"turn {t}") for t in range(2000)]
    random.shuffle(out)
    return out


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS conv", "2 AS written", "3 AS formatted")
    got = {r["conv_id"]: r for r in C.format_chats(df).collect()}
    want = defaultdict(list)
    for c, t, r, x in data:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        said = [(r, x) for _, _, r, x in sorted(turns)]
        assert read(got[c]["formatted"]) == said == [tuple(t) for t in got[c]["turns"]]
        under = [got[c]["formatted"][s["start"]:s["start"] + s["length"]] for s in got[c]["loss_spans"]]
        assert [re.sub(C.ESCAPED, r"\1\2\3", x) for x in under] == [x for r, x in said if r == "assistant"]
    plain = got[6]["formatted"]
    assert "\\" not in plain


@pytest.mark.parametrize("text", ["<s>", "<s>[INST] a [/INST", "<s>x[INST] a [/INST]", "[INST] a [/INST]", "<s>[INST] a <s> b [/INST]", "<s>[INST] a [/INST] "])
def test_other_texts_do_not_parse(spark, text):
    r = spark.createDataFrame([(text,)], "x string").select(C.parse(C.F.col("x")).alias("p")).first()["p"]
    assert r is None or (text == "<s>" and r == [])


def test_registered_query_against_duckdb(spark):
    got = sorted(tuple(r) for r in queries.op2_chat_format(spark, SF).collect())
    assert got == sorted(duckdb_connection(SF).execute(queries.ORACLE["op2_chat_format"]).fetchall())
    assert got[0][0] == -1 and got[0][3] == 21


def test_plan_and_empty_table(spark):
    df = queries.op2_chat_format(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_chats(empty).count() == 0


def test_the_mask_covers_the_assistants_texts(spark):
    """What the spans cover in the formatted text, unescaped, is what the parsed assistants' turns say."""
    rows = [(c, t, r, x) for c, texts in enumerate([["a", "</s>[INST] ok [/INST]"], ["日本", "", "x"], ["[INST]", "\\[INST]", "<s>", "b</s>"]])
            for t, (r, x) in enumerate(zip(["user", "assistant"] * 2, texts))]
    from innsight.llm import chat
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chats.select(chat.masked_text(chats["formatted"], chats["loss_spans"]).alias("mask"), chat.loss_text(chats["turns"]).alias("said")).collect()
    assert len(got) == 3 and all(r["mask"] == r["said"] for r in got) and any(r["said"] for r in got)
