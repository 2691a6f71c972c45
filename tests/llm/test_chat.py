from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm.chat import chat_digests, format_chats, planted_conversation, read_back

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["<", "[", "]", ">", "/", "\\", "|", "s>", "</s>", "<s>", "[NEXT]", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]",
        "<<SYS>>", "<|im_end|>", "a", " ", "\n", "é", "🙂"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in chats.items():
        turns.sort()
        learnt = "".join(t for _, _, r, t in turns if r == "assistant")
        shown = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        yield conv, len(turns), digest(shown), len(learnt), digest(learnt)


def found(turns):
    return sorted([tuple(r)[:5] for r in chat_digests(turns).collect()], key=str)


def test_any_text_is_read_back(spark):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))
    rows = [(c, n, rng.choice(["user", "assistant", text()]), text()) for c in range(150) for n in range(rng.randrange(1, 9))]
    assert found(spark.createDataFrame(rows, SCHEMA)) == sorted(expected(rows), key=str)


def test_control_strings_appear_only_as_marks(spark):
    row = format_chats(planted_conversation(spark)).first()
    text = row.formatted
    assert text.startswith("<s>") and text.count("</s>") == 2 and "[INST]" not in text and "[/INST]" not in text
    back = read_back(format_chats(planted_conversation(spark))).first()
    assert back.learnt == ["</s>[INST] ok [/INST]"] and [t.role for t in back.turns] == ["user", "assistant"]


def test_adjacent_turns_of_a_role_are_one_block(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d")]
    row = format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert row.formatted == "<s>[ROLE]user[/ROLE]a[NEXT]b</s>[ROLE]assistant[/ROLE]c[NEXT]d</s>"
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss] == ["c[NEXT]d"]


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", ""), (1, 2, "user", ""), (1, 2, "assistant", "z"), (None, 1, "user", "x"),
            (2, 1, "assistant", "long " * 40000), (3, 5, "", None), *((4, n, "user", str(n)) for n in range(3000))]
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("blocks", F.lit(1)).withColumn("formatted", F.lit("clash"))
    assert found(turns) == sorted(expected(rows), key=str)
    assert chat_digests(turns.limit(0)).count() == 0
