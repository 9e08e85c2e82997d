"""The chat grammar: every conversation reads back, and masks hold the assistant's texts."""

import hashlib
import random

from locuskit.llm import chat

BITS = ["a", "é🙂", "\\", "\\-", "\\|", "|", "-", "\n", "<s>", "</s>", "[INST]", "[/INST]", "<", "</", "s>", "[", "INST]", " "]


def conversations():
    r = random.Random(5)
    out = [(1, 0, "user", "plain"), (1, 1, "assistant", "answer\nof two lines"), (2, 0, "user", "end \\"), (2, 1, "assistant", "x"), (3, 1, None, None), (3, 0, "ro\nle</s>", "a"), (None, 0, "user", "n"), (4, 0, "user", "same"), (4, 0, "assistant", "turn"), (4, None, "system", "first")]
    for c in range(10, 90):
        out += [(c, t, r.choice(["user", "assistant", "system", "assistant"]), "".join(r.choices(BITS, k=r.randint(0, 8)))) for t in range(r.randint(1, 5))]
    return out


def test_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(df)
    read = {r.conv: r for r in made.select("conv", "formatted", "level", "loss_spans", chat.parsed(made["formatted"]).alias("turns")).collect()}
    digests = {r.conv_id: r for r in chat.digest(made).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t, role or "", text or "") for i, t, role, text in rows if i == c), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        turns = [(role, text) for _, _, role, text in turns]
        got = read[c]
        assert [(t.role, t.text) for t in got.turns] == turns, (c, got.formatted)
        said = [t for role, t in turns if role == "assistant"]
        assert len(got.loss_spans) == len(said)
        d = digests[c]
        assert d.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest() and d.loss_chars == len("".join(said))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest() and d.n_turns == len(turns)
        assert d.formatted_chars == len(got.formatted)
    assert read[1].level == 0 and read[2].level == 2 and {r.level for r in read.values()} == {0, 1, 2}
    assert chat.format_chats(df.limit(0)).collect() == []


def test_planted_conversation(spark):
    got = {r.conv_id: r for r in chat.op8_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(said) and got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_very_long_text(spark):
    """A text of a megabyte full of control strings reads back, beside one without any; columns may be named like helpers."""
    long = "</s>[INST] ok [/INST]\\-|" * 40_000
    df = spark.createDataFrame([(1, 0, "user", "short", 0), (1, 1, "assistant", long, 1), (2, 0, "assistant", "y" * 1_000_000, 2)], "conv_id long, turn long, role string, text string, level int")
    d = {r.conv_id: r for r in chat.digest(chat.format_chats(df)).collect()}
    assert d[1].loss_chars == len(long) and d[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and d[1].n_turns == 2
    assert d[2].loss_chars == 1_000_000 and d[2].loss_sha256 == hashlib.sha256(b"y" * 1_000_000).hexdigest()
