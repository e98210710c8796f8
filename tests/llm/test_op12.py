"""Chat formatting: round trip, masks, pages, odd rows."""

import hashlib
import random

import pytest

from reelmark.llm import op12_chat

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", "<\\|", "<\\\\|x", "\n", "assistant", "é", "😀", " ", "word"]


def conversations():
    draw = random.Random(4)
    rows = []
    for conv in range(60):
        for turn in range(draw.choice([1, 2, 3, 8, 40])):
            text = "".join(draw.choice(PARTS) for _ in range(draw.randrange(12)))
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "to\nol\\n<|"]), text))
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", None), (5, 0, None, "x"), (7, 3, "user", "y"), (7, 3, "user", "y")]
    return rows + [(99, t, ("user", "assistant")[t % 2], "long " * 3000) for t in range(8)]


def expected(rows):
    by_conv = {}
    for row in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        by_conv.setdefault(row[0], []).append(row[2:])
    for conv, turns in by_conv.items():
        formatted = total = 0
        for at, (role, text) in enumerate(turns):
            formatted += len(op12_chat.escaped_role(role)) + len(op12_chat.escaped(text)) + 24
            total += formatted if role == "assistant" or at == len(turns) - 1 else 0
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        yield conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), total


def key(row):
    return (row[0] is None, row[0] or 0)


@pytest.mark.parametrize("page", [1, 500, op12_chat.PAGE])
def test_read_back(spark, page):
    given = spark.createDataFrame(conversations(), SCHEMA).selectExpr("*", "role AS kind", "turn AS pages").repartition(5)
    got = op12_chat.read_back(op12_chat.format_examples(given, page)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(conversations()), key=key)


def test_escapes_are_reversible_and_hide_control_strings():
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randrange(9)))
        hidden = op12_chat.escaped(text)
        assert "<|" not in hidden and op12_chat.unescaped(hidden) == text
        role = op12_chat.escaped_role(text)
        assert "\n" not in role and "<|" not in role and op12_chat.unescaped_role(role) == text


@pytest.mark.parametrize("page", [40, op12_chat.PAGE])
def test_each_reply_has_all_turns_before_it_as_context(spark, page):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")])]
    formatted = op12_chat.format_examples(spark.createDataFrame(rows, SCHEMA), page)
    texts = op12_chat.example_texts(formatted).orderBy("part").collect()
    turn = "<|im_start|>{}\n{}<|im_end|>\n".format
    first = turn("system", "s") + turn("user", "a")
    second = first + turn("assistant", "b") + turn("user", "c")
    start = "<|im_start|>assistant\n"
    assert [(r.context, r.reply) for r in texts] == [(first + start, "b"), (second + start, "d")]
    assert formatted.where("kind = 'example'").count() == 2 and formatted.where("kind <> 'example' AND loss_end > 0").count() == 0


def test_pages_keep_long_conversations_linear(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], "some words of text") for t in range(400)]
    chars = {}
    for turns in (200, 400):
        formatted = op12_chat.format_examples(spark.createDataFrame(rows[:turns], SCHEMA), 1000)
        chars[turns] = formatted.selectExpr("sum(length(text))").first()[0]
    assert chars[400] < 2.2 * chars[200]


def test_a_foreign_context_is_noticed(spark):
    formatted = op12_chat.format_examples(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c")], SCHEMA))
    changed = formatted.where("part = 0").selectExpr("conv_id", "part", "kind", "pages", "replace(text, 'a<', 'z<') AS text", "loss_start", "loss_end")
    with pytest.raises(Exception, match="context"):
        op12_chat.read_back(changed.unionByName(formatted).coalesce(1)).collect()


def test_empty(spark):
    assert op12_chat.read_back(op12_chat.format_examples(spark.createDataFrame([], SCHEMA))).count() == 0
