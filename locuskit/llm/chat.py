r"""Chat formatting with a grammar round trip, with DataFrame functions only.

    conversation = turn*
    turn         = assistant | other
    assistant    = "<s>" role "\n" text "</s>"
    other        = "[INST]" role "\n" text "[/INST]"

The control strings are `<s>`, `</s>`, `[INST]` and `[/INST]`; one that follows a backslash is text. The reader ends a turn
at each closing control string that no backslash precedes, takes the rest apart at its first line feed, and undoes the
escapes: `\` + control string, `\-` (a backslash) and `\|` (a line feed in a role). A conversation is rendered plainly
first, read back and compared with its source. Where they differ, control strings inside roles and texts are escaped; where
that still differs (contents that look like escapes), backslashes and line feeds in roles too, which always reads back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.shared import table

#: Turns by this role are in the loss mask.
TRAINED = "assistant"
CONTROL = r"(</?s>|\[/?INST\])"
CLOSING = r"(?<!\\)(?:</s>|\[/INST\])"
OPENING = r"^(?:<s>|\[INST\])"
STRONGEST = 2


def _escaped(x: Column, level: int, is_role: bool) -> Column:
    if level >= 2:
        x = F.replace(x, F.lit("\\"), F.lit("\\-"))
        if is_role:
            x = F.replace(x, F.lit("\n"), F.lit("\\|"))
    if level >= 1:
        x = F.regexp_replace(x, CONTROL, r"\\$1")
    return x


def unescaped(x: Column) -> Column:
    x = F.regexp_replace(x, r"\\" + CONTROL, "$1")
    return F.replace(F.replace(x, F.lit("\\|"), F.lit("\n")), F.lit("\\-"), F.lit("\\"))


def _pieces(turns: Column, level: int) -> Column:
    """Each turn's header, escaped text and closing string."""
    trained = lambda t: t["role"] == TRAINED
    return F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.when(trained(t), "<s>").otherwise("[INST]"), _escaped(t["role"], level, True), F.lit("\n")).alias("head"),
            _escaped(t["text"], level, False).alias("body"),
            F.when(trained(t), "</s>").otherwise("[/INST]").alias("tail"),
        ),
    )


def rendered(turns: Column, level: int) -> Column:
    return F.array_join(F.transform(_pieces(turns, level), lambda p: F.concat(p["head"], p["body"], p["tail"])), "")


def parsed(text: Column) -> Column:
    """The turns of a rendered conversation, as structs of role and text: the deterministic reader."""
    parts = F.split(text, CLOSING, -1)
    turns = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))  # what follows the last closing string is no turn
    cut = lambda p: F.struct(F.regexp_replace(F.substring_index(p, "\n", 1), OPENING, "").alias("role"), F.substr(p, F.length(F.substring_index(p, "\n", 1)) + F.lit(2)).alias("text"))
    return F.transform(F.transform(turns, cut), lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text")))


def _reads_back(text: Column, turns: Column) -> Column:
    """The parse equals the source, and each turn's opening string is the one that its role calls for."""
    opened = F.array_join(F.transform(F.split(text, CLOSING, -1), lambda p: F.regexp_extract(p, OPENING, 0)), "")
    wanted = F.array_join(F.transform(turns, lambda t: F.when(t["role"] == TRAINED, "<s>").otherwise("[INST]")), "")
    return (parsed(text) == turns) & (opened == wanted) & text.endswith(F.coalesce(F.get(F.transform(turns, lambda t: F.when(t["role"] == TRAINED, "</s>").otherwise("[/INST]")), F.size(turns) - 1), F.lit("")))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: `conv`, `formatted`, `level` (of escaping), `loss_spans` (array of start, length: the escaped
    texts of assistant turns in `formatted`, from 0, in code points).

    Turns go by turn number, nulls first; turns of one number by role, then text. A null role or text is empty. Rows without
    a conversation id form one conversation without id. An empty table gives an empty result. A conversation is one value,
    so its turns meet in one row, as its format demands.
    """
    rows = df.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = F.when(_reads_back(rendered(F.col("turns"), 0), F.col("turns")), F.lit(0))
    lost = F.raise_error(F.lit("a conversation doesn't read back at the strongest level of escaping")).cast("int")
    strongest = F.when(_reads_back(rendered(F.col("turns"), STRONGEST), F.col("turns")), F.lit(STRONGEST)).otherwise(lost)
    level = F.coalesce(plain, F.when(_reads_back(rendered(F.col("turns"), 1), F.col("turns")), F.lit(1)), strongest)
    chats = chats.withColumn("level", level)
    chosen = lambda made: F.when(F.col("level") == 0, made(0)).when(F.col("level") == 1, made(1)).otherwise(made(STRONGEST))
    chats = chats.withColumn("pieces", chosen(lambda n: _pieces(F.col("turns"), n)))
    sizes = F.transform("pieces", lambda p: F.struct(F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"), F.length(p["tail"]).alias("t"), (p["tail"] == "</s>").alias("loss")))
    walked = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + p["h"] + p["b"] + p["t"]).alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + p["h"]).alias("start"), p["b"].alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return chats.select("conv", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"), "level", walked.alias("loss_spans"))


def digest(chats: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    read = chats.withColumns({
        "turns": parsed(F.col("formatted")),
        "loss": F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + F.lit(1), s["length"]))), ""),
    })
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    return digest(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


# Plain rendering reads back unless a role or text holds a control string or what looks like an escape, or a text ends in a
# backslash, or a role has a line feed; escaped control strings read back unless one of the others is there.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, regexp_matches(role || chr(1) || text, '</?s>|\[/?INST\]') AS control,
         regexp_matches(role || chr(1) || text, '\\[-|]') OR ends_with(text, '\') OR contains(role, chr(10)) AS odd
  FROM c),
l AS (SELECT conv_id, CASE WHEN bool_or(odd) THEN 2 WHEN bool_or(control) THEN 1 ELSE 0 END AS level FROM m GROUP BY conv_id),
r AS (
  SELECT m.*, level, CASE level WHEN 2 THEN replace(replace(role, '\', '\-'), chr(10), '\|') ELSE role END AS role2,
         CASE level WHEN 2 THEN replace(text, '\', '\-') ELSE text END AS text2
  FROM m JOIN l USING (conv_id)),
e AS (
  SELECT *, CASE WHEN level > 0 THEN regexp_replace(role2, '(</?s>|\[/?INST\])', '\\\1', 'g') ELSE role2 END AS role3,
         CASE WHEN level > 0 THEN regexp_replace(text2, '(</?s>|\[/?INST\])', '\\\1', 'g') ELSE text2 END AS text3
  FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role3) + length(text3) + CASE role WHEN 'assistant' THEN 8 ELSE 14 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
