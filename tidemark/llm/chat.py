"""Chat formatting with Spark expressions only.

Template: `<s>` opens a conversation; a block is `[ROLE]` + role + `[/ROLE]`, the texts of adjacent turns of that
role joined by `[NEXT]`, then `</s>`. Inside roles and texts a backslash is doubled, and one is put behind the
first character of anything that reads like a control string, so no control string can come from a text and
everything can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP, NEXT = "<s>", "</s>", "[NEXT]"
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
#: Control strings of this template and of common others: [INST], <<SYS>>, <|name|>, <s>, </s>. Escaped in texts.
CONTROL = r"(<|\[)(?=/?s>|/?<?/?SYS>|\||/?INST\]|/?ROLE\]|NEXT\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def planted_conversation(spark) -> DataFrame:
    """Conversation -1, both of whose turns hold control strings."""
    text = F.lit("</s>[INST] ok [/INST]")
    turn = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")),
                             F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    return spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), turn.alias("t")).select(
        "conv_id", F.col("t.turn").cast("long").alias("turn"), F.col("t.role").alias("role"), text.alias("text")
    )


def format_chats(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss) per conversation.

    `loss` holds the spans of the formatted text that are learnt from, each (start, length) in code points,
    without role marks: the texts of `learn_from`. A null text is empty, a null role is the empty role. Turns are sorted by turn (null first), role
    and text, so equal turn numbers and repeated rows have a fixed order and all count. Rows of a null conversation
    form a conversation of their own. Other columns are ignored; an empty table gives an empty result.
    """
    sorted_turns = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("turn").cast("long").isNotNull().alias("numbered"),
                F.col("turn").cast("long").alias("turn"),
                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            )
        )
    )
    chats = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(sorted_turns.alias("turns"))
    # Where a run of one role begins; slices between the starts are the merged blocks.
    roles = F.transform("turns", lambda t: t["role"])
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform("turns", lambda t: t["role"]))
    begins = F.filter(
        F.zip_with(
            F.sequence(F.lit(1), F.size("turns")),
            F.zip_with(roles, F.slice(before, F.lit(1), F.size("turns")), lambda a, b: ~a.eqNullSafe(b)),
            lambda i, new: F.when(new, i),
        ),
        lambda i: i.isNotNull(),
    )
    chats = chats.select("conv_id", "turns", begins.alias("begins"))
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("turns") + 1))
    bounds = F.arrays_zip(F.col("begins"), ends.alias("ends"))
    chats = chats.select("conv_id", "turns", bounds.alias("bounds"))
    blocks = F.transform(
        "bounds",
        lambda b: F.struct(
            F.element_at(F.col("turns"), b["begins"])["role"].alias("role"),
            F.array_join(
                F.transform(F.slice("turns", b["begins"], b["ends"] - b["begins"]), lambda t: escaped(t["text"])), NEXT
            ).alias("body"),
        ),
    )
    chats = chats.select("conv_id", blocks.alias("blocks"))
    head = lambda b: F.concat(F.lit(ROLE), escaped(b["role"]), F.lit(ROLE_END))
    texts = F.transform("blocks", lambda b: F.concat(head(b), b["body"], F.lit(STOP)))
    sized = F.transform(
        "blocks",
        lambda b: F.struct(
            (b["role"] == learn_from).alias("learnt"),
            F.char_length(head(b)).cast("long").alias("head"),
            F.char_length(b["body"]).cast("long").alias("body"),
        ),
    )
    chats = chats.select(
        "conv_id", F.concat(F.lit(START), F.array_join(texts, "")).alias("formatted"), sized.alias("sized")
    )
    # Running ends of the blocks, then the spans of the learnt ones.
    empty = F.array().cast("array<struct<learnt:boolean,start:bigint,length:bigint,end:bigint>>")
    running = F.aggregate(
        "sized",
        F.struct(F.lit(len(START)).cast("long").alias("end"), empty.alias("spans")),
        lambda acc, b: F.struct(
            (acc["end"] + b["head"] + b["body"] + len(STOP)).alias("end"),
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        b["learnt"].alias("learnt"),
                        (acc["end"] + b["head"]).alias("start"),
                        b["body"].alias("length"),
                        (acc["end"] + b["head"] + b["body"] + len(STOP)).alias("end"),
                    )
                ),
            ).cast("array<struct<learnt:boolean,start:bigint,length:bigint,end:bigint>>"),
        ),
    )
    spans = F.transform(
        F.filter(running["spans"], lambda s: s["learnt"]),
        lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")),
    )
    return chats.select("conv_id", "formatted", spans.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, learnt) from the formatted text and its loss spans alone.

    `turns` are (role, text) in order, `learnt` the texts under the loss mask, unescaped.
    """
    inside = F.expr(f"substring(formatted, {len(START) + 1})")
    blocks = F.filter(F.split(inside, STOP, -1), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(F.substring(b, len(ROLE) + 1, 1 << 30), r"\[/ROLE\]", -1))
    turns = F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.split(p[1], r"\[NEXT\]", -1),
                lambda text: F.struct(unescaped(p[0]).alias("role"), unescaped(text).alias("text")),
            ),
        )
    )
    learnt = F.flatten(
        F.transform(
            "loss",
            lambda s: F.transform(
                F.split(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")), r"\[NEXT\]", -1),
                unescaped,
            ),
        )
    )
    return chats.select("conv_id", "formatted", turns.alias("turns"), learnt.alias("learnt"))


def chat_digests(turns: DataFrame) -> DataFrame:
    """Formats all conversations, reads the result back, and returns one row of digests per conversation."""
    back = read_back(format_chats(turns))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digested = back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(shown, "UTF-8"), 256).alias("turns_sha256"),
        F.array_join("learnt", "").alias("learnt"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    return digested.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learnt", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The same digests for a database: turns_sha256 and the loss come from the rows, formatted_chars from the template.
ORACLE_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, lag(role) OVER w AS before,
        length(regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '\\'), '(<)(/?s>|/?<?/?SYS>|\|)', '\1\\\2', 'g'),
            '(\[)(/?INST\]|/?ROLE\]|NEXT\])', '\1\\\2', 'g'), '^$', '')) AS n
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    CAST(3 + sum(n + CASE WHEN before = role THEN 6 ELSE 17 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
