import random

import pytest
import regex
from graphloom.llm.split import split_oversized

WS = regex.compile(r"\p{White_Space}")
NL = r"(?>\r\n|[\n\r\x0b\f\x85\u2028\u2029])"
SCHEMA = "id int, text string, whole string, skeleton string, piece string"


def pieces(spark, texts, limit, overlap):
    df = spark.createDataFrame([(i, t, "w", "s", "p") for i, t in texts], SCHEMA)
    out = {}
    for r in split_oversized(df, "text", ["id"], limit, overlap).collect():
        out.setdefault(r["id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece_index"]) for k, v in out.items()}


def check(text, parts, limit, overlap):
    end, joined = 0, ""
    assert [p["piece_index"] for p in parts] == list(range(len(parts))) and len(parts) > 1
    for p in parts:
        t, at = p["piece_text"], p["piece_start"]
        assert text[at : at + len(t)] == t
        assert len(WS.sub("", t)) == p["piece_size"] <= limit
        assert at == (max(0, end - overlap) if p["piece_index"] else 0)
        joined += t[end - at :]
        end = at + len(t)
        tail = {"block": rf"{NL}\s*?{NL}\s*$", "line": NL, "word": r"\s"}.get(p["boundary"])
        assert tail is None or regex.search(tail, t[-60:])
    assert joined == text
    assert parts[-1]["boundary"] == "end"


def test_random_texts_come_back_whole(spark):
    r = random.Random(1)
    bits = ["a", "bc", "é", "𝒳", "x" * 30, " ", "\n", "\n\n", "\r\n", "\t", "\u00a0", "\u2028", "}", "\u200b", "日本"]
    texts = [(i, "".join(r.choice(bits) for _ in range(r.randrange(0, 400)))) for i in range(60)]
    for limit, overlap in ((40, 7), (100, 0), (25, 24)):
        got = pieces(spark, texts, limit, overlap)
        for i, t in texts:
            assert (i in got) == (len(WS.sub("", t)) > limit)
            if i in got:
                check(t, got[i], limit, overlap)


def test_strong_boundaries_first(spark):
    text = "aaaa bbbb\n\ncccc dddd\neeee ffff gggg"
    assert [p["piece_text"] for p in pieces(spark, [(1, text)], 14, 0)[1]] == ["aaaa bbbb\n\n", "cccc dddd\n", "eeee ffff gggg"]
    assert [p["boundary"] for p in pieces(spark, [(1, text)], 14, 0)[1]] == ["block", "line", "end"]
    assert [p["boundary"] for p in pieces(spark, [(1, "x" * 30)], 14, 0)[1]] == ["char", "char", "end"]


def test_what_gives_no_pieces(spark):
    assert pieces(spark, [(1, None), (2, ""), (3, " \n" * 5000), (4, "x" * 20), (None, None)], 20, 5) == {}
    got = pieces(spark, [(1, "x" * 21), (1, "x" * 21)], 20, 5)
    assert len(got[1]) == 2


def test_very_long_text(spark):
    text = ("word " * 9 + "\n") * 20_000
    check(text, pieces(spark, [(1, text)], 1500, 120)[1], 1500, 120)


def test_long_runs_of_space(spark):
    for gap in ("\n" * 200_000, " \r\n" * 100_000, "\t" * 200_000):
        text = "x" * 1600 + gap + "y" * 1600 + gap
        check(text, pieces(spark, [(1, text)], 1500, 120)[1], 1500, 120)


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], SCHEMA), "text", ["id"], 10, 10)
