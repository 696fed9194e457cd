import hashlib
import random

from refloom.llm.chat_format import HOSTILE, format_chat, parse, read_back, render_turn


def test_round_trip_of_hostile_content():
    r = random.Random(1)
    parts = ["\\", "### ", "###", ": ", ":", " </turn>\n", "</turn>", "\n", " ", "user", "é", "x", "### Assistant: "]
    turns = [("".join(r.choice(parts) for _ in range(r.randint(0, 3))), "".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for _ in range(3000)]
    whole = ""
    for role, text in turns:
        s, begin, end = render_turn(role, text)
        assert parse(s) == [(role, text)]
        whole += s
    assert parse(whole) == turns
    plain, begin, end = render_turn("user", "hello")
    assert plain == "### user: hello </turn>\n" and plain[begin:end] == "hello"


def test_read_back(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", HOSTILE), (1, 2, "user", "tie"), (2, None, None, ""), (None, 5, "assistant", "é" * 9), (2, 1, "assistant", "a\n</turn>"),
        (3, 1, "user", "same"), (3, 1, "user", "same"), (4, 0, "user", "z" * 100_000),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as rendered", "2 as loss_begin")
    segments = format_chat(table)
    formatted = {}
    for x in sorted(segments.collect(), key=lambda x: (x.conv_id or 0, -1 if x.turn is None else x.turn, x.rendered)):
        formatted[x.conv_id] = formatted.get(x.conv_id, "") + x.rendered
    got = {x.conv_id: x for x in read_back(segments).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, x in got.items():
        turns = parse(formatted[conv])
        mine = sorted(((b is not None, b or 0), c or "", d or "") for a, b, c, d in rows if a == conv)
        assert sorted(turns) == sorted((c, d) for _, c, d in mine)
        loss = "".join(t for role, t in turns if role == "assistant")
        assert x.n_turns == len(turns) and x.loss_chars == len(loss) and x.formatted_chars == len(formatted[conv])
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert read_back(format_chat(table.limit(0))).collect() == []
