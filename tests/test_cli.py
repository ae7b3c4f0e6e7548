import numpy as np

from lectern import cli
from lectern.plans import library
from lectern.sources import files, wav


def audio_row(pos, speaker, seconds=8.0, level=0.1, rate=8000):
    data = wav.encode(np.sin(np.arange(round(seconds * rate)) * 0.04) * level, rate)
    return (pos, speaker, f"{speaker}_{pos}", "Original reference.", None, (bytearray(data), None))


def test_library_build(spark):
    rows = [audio_row(1, "1", 4), audio_row(2, "x", 8), audio_row(3, "1", 14), audio_row(4, "2", 8, 0.0), audio_row(5, "1", 10), audio_row(6, "2", 8), audio_row(7, "3", 8)]
    df = spark.createDataFrame(rows + [(8, "4", "4", None, None, None)], files.AUDIO_ROW)
    labels = spark.createDataFrame([("1", "female")], "speaker_id string, gender string")
    made = library.build(df, 2, labels=labels)
    got = {r.voice_id: r for r in made.voices.collect()}
    assert set(got) == {"libritts_r_1", "libritts_r_2"} and got["libritts_r_1"].duration == 10 and got["libritts_r_1"].sample_rate == 24000 and got["libritts_r_1"].gender == "female" and made.shortage.count() == 0
    assert wav.decode(bytes(made.clips.where("path like '%_1.wav'").first()["data"]))[1] == 24000
    more = library.build(df, 5, have=made.voices)
    assert more.voices.count() == 3 and more.shortage.first()["have"] == 3
    for bad in ((0, 5), (1, 0)):
        try:
            library.build(df, *bad)
        except ValueError:
            continue
        raise AssertionError


def test_commands_from_text_to_output(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "a.txt").write_text("CHAPTER 1\n\nShe said, “Go on.” Then it rained.\n\nThe end came.")
    spark.createDataFrame([audio_row(i, str(i)) for i in range(1, 4)], files.AUDIO_ROW).write.parquet(str(tmp_path / "rows"))
    lib, book = str(tmp_path / "lib"), str(tmp_path / "book")
    assert cli.main(["voices-build", str(tmp_path / "rows"), lib, "--count", "3"], spark) == 0 and (tmp_path / "lib" / "clips" / "libritts_r_1.wav").is_file()
    assert cli.main(["voices-list", lib], spark) == 0 and "libritts_r_3" in capsys.readouterr().out
    args = ["run", str(tmp_path / "books"), book, lib, "--annotator", "quotes"]
    assert cli.main(args, spark) == 0
    lines = [r.dialogue for r in spark.read.parquet(f"{book}/script").orderBy("position").collect()]
    assert lines[0] == "CHAPTER 1" and "Go on." in lines
    assert spark.read.parquet(f"{book}/books").first()["clips"] == len(lines)
    [sound] = (tmp_path / "book" / "audio").glob("*.wav")
    assert wav.head(sound.read_bytes())[1:] == (24000, 1)
    before = spark.read.parquet(f"{book}/clips").count()
    assert cli.main(args, spark) == 0 and spark.read.parquet(f"{book}/clips").count() == before
    assert cli.main(["stitch", str(tmp_path / "none"), lib], spark) == 1 and "nothing at" in capsys.readouterr().out
    assert cli.main(["script", str(tmp_path / "books"), str(tmp_path / "b2"), "--chunk-chars", "5"], spark) == 1
