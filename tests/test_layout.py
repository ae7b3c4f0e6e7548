import pytest
from pyspark.sql import functions as F

from lectern import queries
from lectern import queries
from lectern.operators import hyphens, layout
from lectern.plans import pdf_text
from lectern.sources import files
from lectern.sources.files import PAGES

W, H = 595.0, 842.0


def box(x0, y0, x1, y1):
    return (float(x0), float(y0), float(x1), float(y1))


def text(x0, y0, x1, y1, *lines, size=14.0):
    made = [([(t, float(s), box(x0, y0, x0 + 5, y1)) for t, s in (line if isinstance(line, list) else [(line, size)])],) for line in lines]
    return (0, box(x0, y0, x1, y1), made)


def image(x0, y0, x1, y1):
    return (1, box(x0, y0, x1, y1), None)


def convert(spark, pages, **kw):
    df = spark.createDataFrame([("b", i, W, H, blocks) for i, blocks in enumerate(pages, 1)], PAGES)
    made = pdf_text.convert(df, plain=True, **kw)
    return (made.texts.collect() or [("b", None)])[0][1], made


BODY = "A plain body line with more than forty characters in it, for the size."


def test_chapter_heading_title_and_drop_cap(spark):
    page = [text(72, 80, 300, 100, "CHAPTER", size=20.0), text(72, 110, 300, 130, "1", size=20.0), text(72, 210, 300, 230, "Low Water", size=20.0), text(72, 260, 500, 320, [("T", 24.0), ("he river keeps its own calendar, and the mill keeps the river's.", 14.0)])]
    got, _ = convert(spark, [page])
    assert got == "CHAPTER 1\n\nLow Water\n\nThe river keeps its own calendar, and the mill keeps the river's.\n"


def test_hyphens_at_line_ends(spark):
    lexicon = {"gathered": (4.0, False)}
    page = [text(72, 100, 500, 300, "The dusk was rust-", "colored and the crew gath-", "ered behind their grey-", "cloaked pilot and waited.")]
    got, _ = convert(spark, [page], lexicon=lexicon)
    assert "rust-colored" in got and "gathered" in got and "grey-cloaked" in got


@pytest.mark.parametrize(("left", "right", "expected"), [("rust", "colored", "rust-colored"), ("grey", "cloaked", "grey-cloaked"), ("gath", "ered", "gathered"), ("un", "known", "un-known")])
def test_resolve_in_both_forms(spark, left, right, expected):
    lexicon = spark.createDataFrame([("gathered", 4.0, False), ("unknown", 3.6, False), ("un-known", 3.4, False)], "word string, zipf double, listed boolean")
    pairs = spark.createDataFrame([(left, right)], "left string, right string")
    assert hyphens.resolve(pairs, lexicon).first()["joined"] == expected
    lines = spark.createDataFrame([(f"{left}-", f"{right}.")], "a string, b string")
    assert hyphens.joined(lines, F.array(F.array("a", "b")), "t", hyphens.held_lexicon(lexicon)).first().t == [expected + "."]


#: Lines, and their text without a lexicon and with one that knows "ending", "Thebes", "overtime" and "overtimes".
FOLDS = [
    (["T", "he end-", "ing of it-", "2 all"], "The end-ing of it2 all", "The ending of it2 all"),
    (["", " a ", None, "b"], "ab", "ab"),
    ([], "", ""),
    (["wo-"], "wo-", "wo-"),
    (["x-", "Y z"], "x-Y z", "x-Y z"),
    (["ab", "Cd"], "ab Cd", "ab Cd"),
    (["It took over-", "time-", "s pay"], "It took over-time-s pay", "It took overtimes pay"),
    (["Th", "e-", "bes fell"], "The-bes fell", "Thebes fell"),
    (["a rust-", "colored end-", "ING"], "a rust-colored end-ING", "a rust-colored endING"),
    (["snow-capped tops", "stood out."], "snow-capped tops stood out.", "snow-capped tops stood out."),
]


def test_lines_folded_with_and_without_a_lexicon(spark):
    lexicon = {w: (4.0, False) for w in ("ending", "thebes", "overtime", "overtimes")}
    rows = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(FOLDS)], "i int, c array<string>")
    got = hyphens.joined(hyphens.joined(rows, F.array("c"), "a"), F.array("c", F.array(F.lit("x"))), "b", lexicon).orderBy("i").collect()
    assert [r.a[0] for r in got] == [a for _, a, _ in FOLDS] and [tuple(r.b) for r in got] == [(b, "x") for _, _, b in FOLDS]
    none = spark.createDataFrame([(None,)], "c array<array<string>>")
    assert hyphens.joined(none, F.col("c"), "t", lexicon).first().t is None


def test_lines_folded_with_a_table_of_words(spark, sf, monkeypatch):
    """A corpus's own words are more than can be sent along."""
    monkeypatch.setattr(hyphens, "MOST_WORDS", 3)
    lexicon = spark.createDataFrame([(w, 4.0, False) for w in ("ending", "thebes", "overtime", "overtimes")], "word string, zipf double, listed boolean")
    rows = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(FOLDS)], "i int, c array<string>")
    got = hyphens.joined(rows, F.array("c", F.array(F.lit("x"))), "b", lexicon).orderBy("i").collect()
    assert [tuple(r.b) for r in got] == [(b, "x") for _, _, b in FOLDS]
    none = spark.createDataFrame([(None,)], "c array<array<string>>")
    assert hyphens.joined(none, F.col("c"), "t", lexicon).first().t is None
    assert queries.QUERIES["wrapped_lines"](spark, sf).count()


def test_running_headers_and_page_numbers_go(spark):
    pages = [[text(72, 24, 300, 34, "THE EYE OF THE WORLD, A HEADER THAT IS LONGER THAN EIGHTY CHARACTERS TO STAY IN AS A BODY", size=9.0), text(72, 200, 500, 240, f"Body number {'abcd'[i]} is unique and it is long enough for the page."), text(290, 780, 310, 790, str(i + 1), size=9.0)] for i in range(4)]
    got, _ = convert(spark, pages)
    assert "HEADER" not in got and not any(line.isdigit() for line in got.split("\n")) and all(f"Body number {c}" in got for c in "abcd")


def test_ornament_is_no_image_page_and_map_is(spark):
    got, made = convert(spark, [[image(100, 100, 160, 150), text(72, 200, 500, 240, BODY)]])
    assert BODY in got and made.pages.where("state = 'skipped'").count() == 0
    got, made = convert(spark, [[image(0, 0, W, H)]])
    assert got is None and made.failed.count() == 1 and made.pages.first()["state"] == "skipped"


def test_columns_are_read_one_after_the_other(spark):
    blocks = [b for i in range(3) for b in (text(40, 100 + 100 * i, 280, 150 + 100 * i, f"Left text {i} that goes on and on until the end."), text(320, 100 + 100 * i, 560, 150 + 100 * i, f"Right text {i} that goes on and on until the end."))]
    got, _ = convert(spark, [blocks])
    assert got.index("Left text 2") < got.index("Right text 0")
    few, _ = convert(spark, [blocks[:4]])
    assert few.index("Right text 0") < few.index("Left text 1")


def test_footnotes_go_and_pages_are_stitched(spark):
    got, _ = convert(spark, [[text(72, 80, 500, 120, BODY), text(72, 790, 400, 800, "1. a note below the text, more than eighty characters long, so that it is no footer at all", size=7.0)]])
    assert "note below" not in got
    got, _ = convert(spark, [[text(72, 80, 500, 120, "The trees of the old forest were tall and green about")], [text(72, 80, 500, 120, "them. Then it rained for a long while, as it often does here.")]])
    assert "green about them. Then" in got
    marked, _ = convert(spark, [[text(72, 80, 500, 120, "The trees of the old forest were tall and green about")], [text(72, 80, 500, 120, "them. Then it rained for a long while, as it often does here.")]], keep_page_breaks=True)
    assert marked.startswith("The trees") and "\n\n--- page 2 ---\n\nthem." in marked


def test_ocr_replaces_garbage_only(spark):
    pages = [[text(72, 80, 500, 120, "12 34")], [text(72, 80, 500, 120, BODY)]]
    df = spark.createDataFrame([("b", i, W, H, b) for i, b in enumerate(pages, 1)], PAGES)
    made = pdf_text.convert(df, ocr=F.lit("Read by a machine, one line\nand another.\n\nA second paragraph."), plain=False)
    got = made.texts.first()["text"]
    assert "# ocr_pages: 1\n" in got and "Read by a machine, one line and another." in got and BODY in got and "# pages: 2" in got and "# skipped_image_pages: none" in got


def test_modal_size_and_kinds(spark):
    page = [text(72, 100, 500, 120, BODY, size=12.2), text(72, 130, 500, 150, BODY, size=11.9), text(72, 160, 500, 180, BODY, size=15.0), text(10, 400, 100, 420, "side", size=8.0), text(72, 500, 300, 520, "", size=12.0), text(72, 600, 300, 620, "ALL CAPS")]
    df = spark.createDataFrame([("b", 1, W, H, page), ("n", 1, W, H, None), ("e", 1, W, H, [])], PAGES)
    rows = {r.doc_id: r for r in layout.classified(df).collect()}
    assert rows["b"].body_size == 12.0 and [p.kind for p in rows["b"].parts] == ["body", "body", "heading", "sidenote", None, "heading"]
    assert rows["n"].parts == [] and rows["e"].parts == [] and rows["e"].body_size == 12.0


def test_lexicon_from_files(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("Gathered\t4.2\nodd\tx\n\nrare\t1.5\n")
    (tmp_path / "w.txt").write_text("Rare\nmoor\n \n")
    got = {r.word: (r.zipf, r.listed) for r in files.lexicon(spark, str(tmp_path / "f.tsv"), str(tmp_path / "w.txt")).collect()}
    assert got == {"gathered": (4.2, False), "odd": (None, False), "rare": (1.5, True), "moor": (None, True)}
    assert files.lexicon(spark).count() == 0
    lines = spark.createDataFrame([("a gath-", "ered moor")], "a string, b string")
    held = hyphens.held_lexicon(files.lexicon(spark, str(tmp_path / "f.tsv")))
    assert hyphens.joined(lines, F.array(F.array("a", "b")), "t", held).first().t == ["a gathered moor"]
