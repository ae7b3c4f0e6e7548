import json
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import audio as A
from lectern.operators import clips as C
from lectern.operators import registry, voices
from lectern.plans import annotators
from lectern.plans import audio as plan
from lectern.sources import files, sinks, wav
from lectern.sources.config import Settings
from lectern.streaming import clips as stream


def tone(seconds, rate=24_000, level=0.1):
    return (np.sin(np.arange(round(seconds * rate)) * 0.04) * level).astype(np.float32)


def test_clip_gate(spark):
    rows = [(1, tone(4, 1000).tolist()), (2, tone(8, 1000).tolist()), (3, [0.0] * 8000), (4, [1.0] * 8000), (5, []), (6, None), (7, [float("nan")] * 8000), (8, tone(16, 1000).tolist())]
    df = spark.createDataFrame(rows, "i int, x array<float>")
    got = {r.i: (r.u, r.a) for r in df.select("i", A.usable_clip(F.col("x"), 1000).alias("u"), A.audible(F.col("x")).alias("a")).collect()}
    assert [got[i][0] for i in range(1, 9)] == [False, True, False, False, False, False, False, False]
    assert got[2][1] and not got[3][1] and not got[5][1] and not got[7][1]


def test_trim_and_mono(spark):
    rate = 4800
    sound = np.concatenate([np.zeros(rate), tone(1, rate, 0.3), np.zeros(2 * rate)]).astype(np.float32)
    df = spark.createDataFrame([(1, sound.tolist()), (2, [0.0] * 100), (3, [])], "i int, x array<float>")
    got = {r.i: r.n for r in df.select("i", F.size(A.trim_silence(F.col("x"), rate)).alias("n")).collect()}
    assert rate <= got[1] <= rate + round(rate * 0.2) and got[2] == 100 and got[3] == 0
    mono = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0, 5.0]],)], "c array<array<float>>").select(A.to_mono(F.col("c"))).first()[0]
    assert mono == [0.5, 0.5]


def test_wav_round_trip(spark):
    x = tone(0.1)
    data = wav.encode(x, 24_000)
    samples, rate = wav.decode(data)
    assert rate == 24_000 and np.abs(samples[:, 0] - x).max() < 1e-4 and wav.decode(b"junk") is None and wav.decode(None) is None
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"junk")), (3, None)], "i int, c binary")
    got = {r.i: r for r in df.select("i", wav.decoded("c").alias("d"), wav.facts("c").alias("f")).collect()}
    assert len(got[1].d.samples) == 2400 and got[1].f.frames == 2400 and got[2].d.samples is None and got[3].f.frames is None
    assert df.select(F.size(wav.resampled(wav.decoded("c")["samples"], wav.decoded("c")["sample_rate"], 12_000)).alias("n")).first()["n"] == 1200


def greedy(speakers, library, fixed):
    """Casting by the definition: the first free voice of the gender, else the first free one."""
    cast = dict(fixed)
    free = sorted(v for v, _ in library if v not in cast.values())
    genders = dict(library)
    missing = sorted((s for s in speakers if s[0] not in cast), key=lambda s: (s[0] != "narrator", s[0]))
    if len(missing) > len(free):
        return None
    for s, g in [m for m in missing if m[1] in ("male", "female")] + [m for m in missing if m[1] not in ("male", "female")]:
        own = [v for v in free if genders[v] == g] if g in ("male", "female") else []
        cast[s] = (own or free)[0]
        free.remove(cast[s])
    return cast


kinds = st.sampled_from(["male", "female", "unknown"])


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from(["narrator", *"abcdefg"]), kinds), st.dictionaries(st.sampled_from([f"v{i}" for i in range(9)]), kinds), st.booleans())
def test_casting_by_definition(speakers, library, keep):
    fixed = {"a": "v3"} if keep and "v3" in library else {}
    expected = greedy(list(speakers.items()), list(library.items()), fixed)
    if expected is None:
        with pytest.raises(ValueError, match="additional"):
            voices.assign(list(speakers.items()), sorted(library.items()), fixed)
    else:
        assert voices.assign(list(speakers.items()), sorted(library.items()), fixed)[0] == expected


def test_casting_by_joins_is_the_same(spark):
    rng = np.random.default_rng(5)
    library = [(f"v{i:02}", ["female", "male", "unknown"][i % 3]) for i in range(30)]
    speakers = [(b, f"s{i}" if i else "narrator", ["female", "male", "unknown"][rng.integers(3)]) for b in range(20) for i in range(rng.integers(1, 9))]
    df = spark.createDataFrame(speakers, "book_id int, speaker_id string, gender string")
    lib = spark.createDataFrame(library, "voice_id string, gender string")
    got = {(r.book_id, r.speaker_id): r.voice_id for r in voices.cast(df, lib).collect()}
    slow = {(r.book_id, k): v for r in voices.cast_greedy(df, lib).collect() for k, v in r.casting.items()}
    assert got == slow and len(got) == len(speakers)


def scan(rows, count, most, owned):
    """Sampling by the definition: one row after the other."""
    best = {}
    for pos, s, d, u in rows:
        if pos > most:
            break
        if not u or s in owned:
            continue
        if s not in best or abs(d - 10) < abs(best[s][1] - 10):
            best[s] = (pos, d)
        if len(owned) + len(best) >= count:
            break
    return best


def test_sampling_by_definition(spark):
    rng = np.random.default_rng(9)
    for _ in range(4):
        rows = [(i + 1, str(rng.integers(12)), float(rng.integers(1, 20)), bool(rng.integers(3))) for i in range(80)]
        df = spark.createDataFrame(rows, "scan_pos long, speaker_id string, duration double, usable boolean").repartition(3)
        count, most, owned = int(rng.integers(3, 15)), int(rng.integers(10, 100)), {"1", "2"}
        have = spark.createDataFrame([(o,) for o in owned], "speaker_id string")
        got = {r.speaker_id: (r.scan_pos, r.duration) for r in voices.sample(df, count, most, have).collect()}
        assert got == scan(rows, count, most, owned)


def test_references_labels_and_overlay(spark):
    v = spark.createDataFrame([("a", "clips/a.wav", "h1", "1", None), ("b", "../b.wav", "h", "2", "F"), ("c", "clips/c.wav", "h3", "3", "bad"), ("d", "clips/d.wav", "h4", "4", "")], "voice_id string, path string, sha256 string, speaker_id string, gender string")
    held = spark.createDataFrame([("clips/a.wav", "h1", 240000, 24000, 1), ("../b.wav", "h", 240000, 24000, 1), ("clips/c.wav", "other", 240000, 24000, 1), ("clips/d.wav", "h4", 24000, 24000, 1)], "path string, sha256 string, frames long, sample_rate int, channels int")
    assert {r.voice_id: r.reason.split()[0] for r in voices.invalid_references(v, held).collect()} == {"b": "invalid", "c": "checksum", "d": "not"}
    labels = spark.createDataFrame([("1", "M"), ("3", "F")], "speaker_id string, gender string")
    assert {r.voice_id: r.gender for r in voices.label(v, labels).collect()} == {"a": "male", "b": "female", "c": "female", "d": "unknown"}
    ch = spark.createDataFrame([("b", "ines", "Ines", ["m"], "female", None, "")], "book_id string, speaker_id string, name string, aliases array<string>, gender string, age string, voice string")
    sheet = spark.createDataFrame([("b", "ines", "", [], "male", "adult", "low"), ("b", "odo", "Odo", ["x"], "", None, None)], ch.schema)
    got = {r.speaker_id: (r.name, r.aliases, r.gender, r.age, r.voice) for r in registry.overlay(ch, sheet).collect()}
    assert got == {"ines": ("Ines", ["m"], "male", "adult", "low"), "odo": ("Odo", ["x"], "unknown", None, None)}


def script(spark, *rows):
    return spark.createDataFrame([("b", i, s, t, d, 150) for i, (s, t, d) in enumerate(rows, 1)], "book_id string, position long, speaker_id string, dialogue string, direction string, pause_after_ms int")


def test_synthesis_reuse_and_stitching(spark, tmp_path):
    lib = spark.createDataFrame([(f"v{i}", f"h{i}", "unknown") for i in range(3)], "voice_id string, sha256 string, gender string")
    none = spark.createDataFrame([], "book_id string, speaker_id string, gender string")
    rows = script(spark, ("narrator", "Morning.", "x"), ("ines", "Come up.", "x"))
    cast = plan.cast(rows, lib, none)
    assert {r.speaker_id: r.voice_id for r in cast.collect()} == {"narrator": "v0", "ines": "v1"}
    s = Settings(engine="chatterbox")
    table = str(tmp_path / "clips")

    def synth(rows, have, model="fixture", settings=s, characters=None):
        keep, made = plan.synthesize(rows, cast, lib, have, annotators.ToneModel, model, settings, characters)
        made.write.mode("append").parquet(table)
        return keep.count()

    held = lambda: spark.read.parquet(table)
    assert synth(rows, None) == 0 and held().count() == 2
    assert synth(rows, held()) == 2 and held().count() == 2
    changed = script(spark, ("narrator", "Morning.", "y"), ("ines", "Go down.", "x"))
    with pytest.raises(plan.InvalidInput, match="stale"):
        plan.stitch(changed, cast, lib, held())
    assert synth(changed, held()) == 1 and held().count() == 3
    keep, _ = plan.synthesize(changed, cast, lib, held(), annotators.ToneModel, "fixture", s)
    out = plan.stitch(changed, cast, lib, keep)
    assert [(r.position, r.start_frame, r.end_frame) for r in out.timeline.orderBy("position").collect()] == [(1, 0, 1200), (2, 4800, 7200)]
    assert out.books.first()["milliseconds"] == pytest.approx(450.0) and out.books.first()["clips"] == 2
    pcm = b"".join(bytes(r.data) for r in out.pcm.orderBy("position").collect())
    x, _ = annotators.ToneModel().generate("Morning.", "", 1, "")
    assert len(pcm) == 2 * (1200 + 3600 + 2400 + 3600) and np.abs(np.frombuffer(pcm, "<i2")[:1200] - x * 32768).max() <= 1 and not any(pcm[2400 : 2 * 4800])
    written = plan.write_sounds(out, str(tmp_path / "audio")).collect()
    content = (tmp_path / "audio" / "b.wav").read_bytes()
    assert [(r.path, r.size) for r in written] == [("b.wav", len(pcm))] and content.endswith(pcm) and len(content) == 44 + len(pcm)
    assert wav.head(content) == (len(pcm) // 2, 24000, 1)
    assert synth(changed, held(), "other") == 0
    with pytest.raises(plan.InvalidInput, match="without a voice"):
        plan.synthesize(script(spark, ("nobody", "x", "")), cast, lib, None, annotators.ToneModel, "m", s)
    people = spark.createDataFrame([("b", "ines", "female", "young", "a bright voice")], "book_id string, speaker_id string, gender string, age string, voice string")
    prompted = plan.prompted(script(spark, ("ines", "“Mind the step.”", "She croaks.")), people, cast, lib).first()
    assert prompted.prompt == 'A young woman with a bright voice croaks, "Mind the step."' and 1.5 <= prompted.seconds <= 35


def test_order_past_nine_and_identity(spark):
    rows = [("b", i, f"{i}", 100, 24000, 150) for i in range(1, 3000)]
    df = spark.createDataFrame(rows, "book_id string, position long, sha256 string, frames long, sample_rate int, pause_after_ms int")
    assert C.identity(df).first()["identity"] == C.identity(df.repartition(7)).first()["identity"] != C.identity(df.withColumn("pause_after_ms", F.lit(1))).first()["identity"]
    made = C.timeline(df.repartition(5))
    assert made.where("start_frame <> (position - 1) * 3700").count() == 0
    small = spark.createDataFrame([("b", 1, [1, -2, 300], 1000, 2)], "book_id string, position long, samples16 array<int>, sample_rate int, pause_after_ms int")
    assert bytes(C.pcm(small).first()["data"]) == np.array([1, -2, 300, 0, 0], "<i2").tobytes()


def test_streams(spark, tmp_path):
    rows = script(spark, ("narrator", "One.", "x"), ("ines", "Two.", "x"))
    rows.write.parquet(str(tmp_path / "in"))
    lib = spark.createDataFrame([("v0", "h0"), ("v1", "h1")], "voice_id string, sha256 string")
    cast = spark.createDataFrame([("b", "narrator", "v0"), ("b", "ines", "v1")], "book_id string, speaker_id string, voice_id string")
    want = lambda df: C.desired(df, cast, lib, "m", "{}")
    make = lambda work: work.select("book_id", "position", "fingerprint", F.lit(True).alias("valid"))
    table, where = str(tmp_path / "clips"), str(tmp_path / "check")
    stream.maintain(stream.script_stream(spark, str(tmp_path / "in")), want, make, table, where).awaitTermination(120)
    assert spark.read.parquet(table).count() == 2
    script(spark, ("narrator", "One.", "x"), ("ines", "Two, changed.", "x")).write.mode("append").parquet(str(tmp_path / "in"))
    stream.maintain(stream.script_stream(spark, str(tmp_path / "in")), want, make, table, where).awaitTermination(120)
    assert spark.read.parquet(table).count() == 3
    scans = spark.createDataFrame([(i + 1, str(i % 5), 9.0, True) for i in range(20)], "scan_pos long, speaker_id string, duration double, usable boolean")
    scans.write.parquet(str(tmp_path / "scan"))
    source = spark.readStream.schema(scans.schema).parquet(str(tmp_path / "scan"))
    stream.voice_scan(source, str(tmp_path / "lib"), 3, 100, str(tmp_path / "check2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "lib")).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"position": 1, "speaker_id": "narrator", "dialogue": "x", "direction": "", "pause_after_ms": 5}\nnot json\n')
    rows = files.scripts(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()
    assert [(r.line, r.position) for r in rows] == [(1, 1), (2, None)]
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "dataset": "d", "attribution": "", "voices": {"v1": {"path": "p", "speaker_id": "1", "duration": 9.5}}}, indent=2))
    v = files.voice_manifests(spark, str(tmp_path / "m.json"), "d").first()
    assert (v.voice_id, v.path, v.duration) == ("v1", "p", 9.5) and files.voice_manifests(spark, str(tmp_path / "m.json"), "other").count() == 0
    (tmp_path / "l.json").write_text('{"1": "M", "2": "F"}')
    assert {r.speaker_id: r.gender for r in files.speaker_labels(spark, str(tmp_path / "l.json")).collect()} == {"1": "male", "2": "female"}
    texts = spark.createDataFrame([("x/1", "# m\nhello"), ("y", "# only")], "doc_id string, text string")
    assert {r.path: r.size for r in sinks.write_texts(texts, str(tmp_path / "out")).collect()} == {"x_1.txt": 9, "y.txt": 6}
    kept, failed = files.clean_texts(spark, str(tmp_path / "out"))
    assert [r.text for r in kept.collect()] == ["hello"] and failed.count() == 1
    assert {r["size"] for r in files.listing(spark, str(tmp_path / "out"), hashed=True).collect()} == {9, 6}
    sinks.write_json(spark, str(tmp_path / "j" / "a.json"), {"ä": [1]})
    assert json.loads((tmp_path / "j" / "a.json").read_text()) == {"ä": [1]}
    s = script(spark, ("narrator", "One.", "x"))
    for _ in range(2):
        sinks.write_script(s, str(tmp_path / "script"))
    assert spark.read.text(str(tmp_path / "script")).count() == 1
    layouts = files.parsed_layouts(spark, str(tmp_path / "out"), lambda b: [{"width": 1.0, "height": 1.0, "blocks": []}] if len(b) == 9 else 1 / 0)
    assert sorted(r.page for r in layouts.collect()) == [0, 1]


def test_sound_headers_of_any_size():
    small, large = wav.sound_header(100, 24000), wav.sound_header(5 << 30, 48000)
    assert len(small) == 44 and wav.head(small + bytes(100)) == (50, 24000, 1)
    assert large[:4] == b"RF64" and large[4:8] == large[-4:] == b"\xff" * 4 and len(large) == 80
    kind, size, riff, data, samples, _ = struct.unpack_from("<4sIQQQI", large, 12)
    assert (kind, size, data, samples) == (b"ds64", 28, 5 << 30, 5 << 29) and riff == (5 << 30) + 72


@pytest.mark.parametrize("frames", [1, 7, 65_536])
def test_blocks_are_the_whole_clip(frames):
    x = np.sin(np.arange(1000) / 9).astype(np.float32)
    content = wav.encode(x, 8000)
    assert np.array_equal(np.concatenate(list(wav.blocks(content, frames))), wav.decode(content)[0]) and list(wav.blocks(b"no wave")) == [] and list(wav.blocks(None)) == []


def test_heard(spark):
    clips = [wav.encode(np.zeros(70_000), 8000), wav.encode(np.append(np.zeros(70_000), 0.5), 8000), b"no wave", None, wav.encode(np.zeros(0), 8000)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(clips)], "i int, c binary")
    assert [r.v for r in df.select("i", plan.valid("c").alias("v")).orderBy("i").collect()] == [False, True, False, False, False]


def test_clips_are_handed_on_by_their_bytes(spark, monkeypatch):
    """A batch of very many long lines isn't held as sound at once."""
    seen = []
    lib = spark.createDataFrame([("v0", "male", "h")], "voice_id string, gender string, sha256 string")
    rows = script(spark, ("narrator", "Morning.", "x"))
    cast = spark.createDataFrame([("b", "narrator", "v0")], "book_id string, speaker_id string, voice_id string")
    frame = type(rows)
    monkeypatch.setattr(frame, "mapInPandas", lambda self, run, schema: seen.append(run) or self)
    plan.synthesize(rows, cast, lib, None, annotators.ToneModel, "m", Settings(engine="chatterbox"))
    line = {"book_id": "b", "fingerprint": "f", "dialogue": "word " * 500, "spoken": "word " * 500, "direction": "", "speaker_id": "narrator", "voice_id": "v0", "reference_sha256": "h"}
    parts = list(seen[0](iter([plan.pd.DataFrame([line | {"position": i} for i in range(30)])])))
    assert [p for x in parts for p in x["position"]] == list(range(30))
    assert max(x["content"].map(len).sum() for x in parts if len(x)) < plan.MOST_HELD + 2 * 600_000 + 44


def test_a_library_of_any_size_is_cast_by_its_first_voices(spark):
    library = [(f"v{i:04}", ["female", "male", "unknown"][i % 3]) for i in range(400)]
    lib = spark.createDataFrame(library, "voice_id string, gender string")
    people = [("a", s, "female") for s in "uvwxyz"] + [("b", "x", "male"), ("b", "y", "unknown"), ("c", "y", "female")]
    df = spark.createDataFrame(people, "book_id string, speaker_id string, gender string")
    fixed = [("a", "u", "v0399"), ("a", "gone", "v0003"), ("d", "x", "v0001")]
    earlier = spark.createDataFrame(fixed, "book_id string, speaker_id string, voice_id string")
    assert len(voices.held_library(lib, 7)[0]) == 21 and voices.held_library(lib, 7)[1] == 400
    got = {r.book_id: r.casting for r in voices.cast_greedy(df, lib, earlier.where("book_id = 'a'").union(df.where("false").select("book_id", "speaker_id", "gender"))).collect()}
    for book in "a":
        own = {s: v for b, s, v in fixed if b == book}
        assert got[book] == voices.assign([(s, g) for b, s, g in people if b == book], library, own)[0] == greedy([(s, g) for b, s, g in people if b == book], library, own)


def test_registry_by_books_and_by_characters(spark, monkeypatch):
    item = "struct<speaker_id: string, name: string, aliases: array<string>, gender: string>"
    rows = [(b, n, (f"c{n}", f"Name {n // 3}", [f"Alias{b or 0}x{n}", "he"], "f" if n % 2 else "")) for b in (1, None, 2) for n in range(40)]
    rows += [(3, 1, ("x", "X", [], "")), (3, 2, ("y", "Y", [], "")), (3, 3, ("z", "X", ["y"], "")), (3, 4, ("q", "Q", [], ""))]
    df = spark.createDataFrame(rows, f"book_id long, nth int, item {item}").repartition(5)
    whole = {r.book_id: r for r in registry.merge_books(df).collect()}
    people = registry.merge_characters(df).collect()
    assert whole[3].error == "aliases belong to several speakers" and [r.error for r in people if r.book_id == 3] == [whole[3].error]
    for b in (1, None, 2):
        own = registry.Registry({"narrator": registry.NARRATOR})
        renamed = own.update([dict(zip(("speaker_id", "name", "aliases", "gender"), x[2])) for x in rows if x[0] == b])
        assert json.loads(whole[b].characters) == own.characters and whole[b].renamed == renamed
        got = {r.speaker_id: r for r in people if r.book_id == b}
        assert {k: json.loads(r.character) for k, r in got.items()} == own.characters
        assert {k: r["items"] for k, r in got.items()} == {k: list(renamed.values()).count(k) for k in own.characters}
