import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import audio, jobs, models, voices
from lectern.sources import extract
from lectern.streaming import events


def book(pages, spine):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{i}" href="{i}.xhtml"/>' for i in pages)
        refs = "".join(f'<itemref idref="{i}"/>' for i in spine)
        z.writestr("OEBPS/c.opf", f'<package xmlns="http://x"><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for i, html in pages.items():
            z.writestr(f"OEBPS/{i}.xhtml", html)
    return out.getvalue()


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿café".encode())
    (tmp_path / "b.txt").write_bytes("café “x”".encode("cp1252"))
    (tmp_path / "c.txt").write_bytes(b"\x81\xe9")
    (tmp_path / "d.epub").write_bytes(book({"p2": "<h1>Two</h1><p>second  page</p>", "p1": "<head><title>T</title></head><p>One &amp; all</p>"}, ["p1", "p2", "gone"]))
    rows = extract.files(spark, str(tmp_path), "*.txt").select(F.substring_index("path", "/", -1).alias("n"), extract.decode(F.col("content")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == {"a.txt": "café", "b.txt": "café “x”", "c.txt": "\x81é"}
    text = extract.epub_texts(extract.files(spark, str(tmp_path), "*.epub")).first().text
    assert text.index("One & all") < text.index("Two") < text.index("second page") and "T\n" not in text
    html = spark.createDataFrame([("<p>a</p><script>x</script>b<br>c",)], "h string").select(extract.html_text("h").alias("t")).first().t
    assert html.split() == ["a", "b", "c"] and "x" not in html


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(name, content)
    return out.getvalue()


def test_books_of_all_kinds(spark):
    """Each book with a text worked out by hand: orders, bases, repeated and missing names, code pages, broken tables and archives."""
    box = ("META-INF/container.xml", "<container xmlns='urn:x'><rootfiles><rootfile full-path='{}'/></rootfiles></container>")
    package = lambda items, refs: "<package xmlns='http://o'><manifest>" + "".join(f"<item id='{i}' href='{h}'/>" for i, h in items) + "</manifest><spine>" + "".join(f"<itemref idref='{r}'/>" for r in refs) + "</spine></package>"
    with_box = lambda opf, *rest: archive([(box[0], box[1].format(opf)), *rest])
    page = lambda t: f"<html><body><p>{t}</p></body></html>"
    books = {
        "at the root": (with_box("c.opf", ("c.opf", package([("a", "1.xhtml"), ("b", "2.xml")], "ba")), ("1.xhtml", page("one")), ("2.xml", page("two"))), "two\n\none"),
        "in folders": (with_box("x/y/c.opf", ("x/y/c.opf", package([("a", "/t//1.html")], "aa")), ("x/y/t/1.html", page("twice"))), "twice\n\ntwice"),
        "last item of an id": (with_box("c.opf", ("c.opf", package([("a", "1.xhtml"), ("a", "2.xhtml")], "a")), ("1.xhtml", page("no")), ("2.xhtml", page("yes"))), "yes"),
        "nothing of the spine": (with_box("c.opf", ("c.opf", package([("a", "gone.xhtml")], "a")), ("b.HTM", page("b")), ("a.xhtml", page("a")), ("n.txt", "no page")), "b\n\na"),
        "no container": (archive([("z.html", page("z")), ("a.html", page(" ")), ("b.html", page("b  &amp;\tb"))]), "z\n\nb & b"),
        "broken package": (with_box("c.opf", ("c.opf", "<package>"), ("1.html", page("one"))), "one"),
        "package that is not there": (with_box("d.opf", ("1.html", page("one"))), "one"),
        "windows page": (archive([("1.html", page("caf\xe9 \u20ac").encode("cp1252"))]), "caf\xe9 \u20ac"),
        "long page": (archive([(f"{i}.html", page("long words " * 60_000)) for i in range(3)]), "\n\n".join(["long words " * 59_999 + "long words"] * 3)),
        "no archive": (b"PK?", ""),
        "no bytes": (b"", ""),
        "nothing": (None, None),
    }
    df = spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, (c, _) in books.items()] * 2, "name string, content binary").repartition(3)
    got = extract.with_book_texts(df).select("name", "text").collect()
    assert sorted((r.name, str(r.text)) for r in got) == sorted((n, str(t)) for n, (_, t) in books.items() for _ in range(2))
    assert not extract.with_book_texts(df.limit(0)).collect()


def test_manifests(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "j1", "chunks": [{"index": 0, "text": "x", "status": "done", "duration": 1.5}]}))
    (tmp_path / "b.json").write_text("{broken")
    rows = extract.manifests(spark, str(tmp_path)).collect()
    assert [(r.id, r.status, r.chunks[0].duration) for r in rows] == [("j1", "running", 1.5)]


def test_audio(spark):
    df = spark.createDataFrame([(1, [0.01] * 1000), (2, [0.0] * 1000), (3, [0.01] * 999 + [0.9])], "i int, x array<double>")
    got = {r.i: r.y for r in df.select("i", audio.normalize_loudness(F.col("x")).alias("y")).collect()}
    assert max(got[1]) > 0.05 and max(got[1]) <= 0.99 and got[2] == [0.0] * 1000 and max(got[3]) <= 0.99 + 1e-9
    assert all(max(map(abs, r.y)) <= 1 for r in df.select(audio.denoise("x").alias("y")).collect())


def test_voices(spark):
    have = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    asked = spark.createDataFrame([("a", "c"), ("x", "y"), ("b", "a"), ("a", "d")], "old string, new string")
    assert {(r.old, r.new): r.status for r in voices.rename_status(have, asked).collect()} == {("a", "c"): "renamed", ("x", "y"): "missing", ("b", "a"): "taken", ("a", "d"): "taken"}
    assert sorted(map(tuple, voices.rename(have, asked).collect())) == [("b", 2), ("c", 1)]
    log = spark.createDataFrame([(1, "ready", "a", None, None), (2, "ready", "b", None, None), (3, "renamed", None, "a", "c"), (4, "removed", "b", None, None)], "ts int, type string, voice string, old string, new string")
    assert [r.name for r in voices.current(log).collect()] == ["c"]


def test_fan_out_and_settling(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "v/a.wav", "created"), ("2024-01-01 00:00:00.5", "v/a.wav", "created"), ("2024-01-01 00:00:09", "v/a.WAV", "created"), ("2024-01-01 00:00:01", "v/b.txt", "created"), ("2024-01-01 00:00:02", "v/a.wav", "deleted")], "ts string, path string, type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.path, r.n) for r in events.settled(rows.where("type = 'created'")).collect()) == [("v/a.WAV", 1), ("v/a.wav", 2)]
    assert events.deletions(rows).count() == 1
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    queries = events.fan_out(stream, {"all_events": "true", "made_events": "type = 'created'"}, str(tmp_path / "out"))
    for q in queries:
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out/all_events")).count() == 5 and spark.read.parquet(str(tmp_path / "out/made_events")).count() == 4


def test_progress_follows_the_index(spark, tmp_path):
    """Rows of a batch arrive in any order; the estimate goes by their index."""
    rows = spark.createDataFrame([(j, i, 6, float(i + j)) for j in (1, 2) for i in range(6)], "job_id long, index long, total int, seconds double").repartition(5, "seconds")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, events.drained(events.progress(stream), str(tmp_path / "out")).collect()))
    want = []
    for j in (1, 2):
        for i in range(6):
            last = [k + j for k in range(max(0, i - 4), i + 1)]
            want.append((j, i, i + 1, 6, sum(last) / len(last) * (5 - i) if i < 5 else None))
    assert got == want


def test_arrivals(spark, tmp_path):
    folder = tmp_path / "voices"
    folder.mkdir()
    (folder / "a.wav").write_bytes(b"1234")
    (folder / "b.txt").write_bytes(b"1")
    where = str(tmp_path / "out")
    seen = lambda: sorted((r.path.rsplit("/", 1)[1], r.length) for r in events.drained(events.arrivals(spark, str(folder)), where).collect())
    assert seen() == [("a.wav", 4)]
    (folder / "c.wav").write_bytes(b"12")
    assert seen() == [("a.wav", 4), ("c.wav", 2)]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        events.shared_folder(Cluster, "x")


def test_models(spark):
    def broken():
        raise OSError("no weights")

    with pytest.warns(UserWarning):
        found = models.usable({"a": lambda: str.upper, "b": broken})
    assert list(found) == ["a"]
    with pytest.warns(UserWarning), pytest.raises(RuntimeError):
        models.usable({"b": broken})
    takes = spark.createDataFrame([(1, 0, "abc"), (1, 1, "x"), (2, 0, None)], "chunk_id long, take int, audio string")
    got = {(r.chunk_id, r.take): r.transcript for r in models.transcripts(takes, {"second": lambda x: x[1]}).collect()}
    assert got == {(1, 0): "b", (1, 1): None, (2, 0): None}
    assert {(r.chunk_id, r.take): r.embedding for r in models.embeddings(takes, lambda x: [len(x), 1]).collect()} == {(1, 0): [3.0, 1.0], (1, 1): [1.0, 1.0], (2, 0): None}


def test_wav(spark):
    import wave

    rows = spark.createDataFrame([(1, [0.0, 0.5, -1.0, 2.0] * 2000), (2, [])], "i int, x array<double>")
    for r in rows.select("x", audio.wav_bytes(F.col("x"), 8000).alias("w"), extract.wav_seconds(audio.wav_bytes(F.col("x"), 8000)).alias("s")).collect():
        with wave.open(io.BytesIO(bytes(r.w))) as f:
            assert (f.getnchannels(), f.getsampwidth(), f.getframerate(), f.getnframes()) == (1, 2, 8000, len(r.x))
            assert f.readframes(4) == (b"\x00\x00\xff\x3f\x00\x80\xff\x7f" if r.x else b"")
        assert r.s == len(r.x) / 8000
    kinds = rows.where("i = 1").select(F.explode(F.array(*map(F.lit, ["MP3", "flac", "odd"]))).alias("f"), "x").select("f", audio.encode(F.col("x"), F.col("f")).alias("e")).collect()
    assert {r.f: (r.e.media_type, r.e.content is None) for r in kinds} == {"MP3": ("audio/mpeg", True), "flac": ("audio/flac", True), "odd": ("audio/wav", False)}


def test_placed_chunks_across_blocks(spark):
    rows = spark.createDataFrame([(j, i, [0.0] * (i % 3)) for j in (1, 2) for i in range(50)], "job_id int, index int, samples array<double>")
    got = {(r.job_id, r["index"]): r.offset for r in audio.placed_chunks(rows, block=7).collect()}
    assert got == {(j, i): sum(k % 3 for k in range(i)) for j in (1, 2) for i in range(50)}
