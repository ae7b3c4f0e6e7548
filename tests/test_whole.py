"""Queries that run an operator over whole texts, against brute force on small tables."""

import random
from collections import Counter

from speech import speech

from lectern.queries import audio, cast, pages, texts, views


def test_span_join_reads_whole_documents(spark, tmp_path):
    texts = [None, "", "x", "Once upon a time", " ".join(f"word{i}" for i in range(500)), "A long  line\nof two " * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in pages.span_join(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        words = (text or "").split(" ")
        spans, out = [words[0][:1], words[0][1:], *words[1:]], ""
        for k, span in enumerate(spans):
            span = " " * (k % 4 == 3) + span
            before = spans[k - 1] if (k - 1) % 4 != 3 else " " + spans[k - 1]
            glued = k == 1 and spans[0].isalpha() and span[:1].islower()
            out += span if k == 0 or glued or before.endswith(" ") or span.startswith(" ") or (k - 1) % 3 == 0 else " " + span
        assert got[i] == out and "".join(out.split(" ")) == "".join(words)


def marked(text):
    return "\n".join("“" + x if i % 5 == 1 else x + "”" if i % 5 == 2 else x for i, x in enumerate(text.split("\n")))


def test_quotes_in_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    far = "x" * 300 + " “speech\nover two lines " + "y" * 200 + "” and \"more\" of it"
    docs = [None, "", far, "“never closed\n \t\nnext “one” ‘two’ isn't 'three'"] + ["".join(rng.choices(["“", "”", "‘", "’", '"', "'", " ", "\n", "\n\n", "ab", "é😀", "-"], k=200)) for _ in range(60)]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.start, r.end) for r in texts.quote_whole(spark, str(tmp_path)).collect())
    assert got == sorted((i, a, b) for i, t in enumerate(docs) if t is not None for a, b in speech(marked(t)))
    assert (2, 301, marked(far).index("“", 302)) in got and (3, 0, 14) in got


def test_faults_of_the_whole_casting(spark, sf):
    known = {r.voice_id for r in views.voices(spark, sf).collect()}
    rows = []
    for r in cast.casting(spark, sf).collect():
        rows += [(r.book_id, "x" * (r.book_id % 5 == 0) + r.voice_id)] * (1 + (r.book_id % 7 == 0))
    expected = [(b, v, "unknown voice") for b, v in rows if v not in known] + [(b, v, "cast twice") for (b, v), n in Counter(rows).items() if n > 1]
    got = [(r.book_id, r.voice_id, r.reason) for r in audio.casting_faults(spark, sf).collect()]
    assert sorted(got) == sorted(expected) and {r for _, _, r in got} == {"unknown voice", "cast twice"}
