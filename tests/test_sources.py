import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.functions import names
from vellum.operators import logs, recognise
from vellum.plans import pipelines
from vellum.sources import docx, files, pdf
from vellum.streaming import ingest


def png(w, h, value):
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    rows = b"".join(b"\0" + bytes([value] * w) for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_docx_pages(spark, tmp_path):
    put(f"{tmp_path}/a.docx", docx.docx_bytes(["one", "", "two & three", "PDF p1", "four", "END OF EXTRACT", "rest"]))
    d = docx.read_docx(spark, str(tmp_path))
    assert [r["text"] for r in d.orderBy("ord").collect()] == ["one", "", "two & three", "PDF p1", "four", "END OF EXTRACT", "rest"]
    assert [(r["page"], r["text"]) for r in docx.pages(d).orderBy("page").collect()] == [(0, "one\ntwo & three"), (1, "four")]
    assert docx.transcription(d).count() == 6


def test_images_and_listing(spark, tmp_path):
    put(f"{tmp_path}/p/1.png", png(3, 2, 77))
    put(f"{tmp_path}/p/m.bmp", b"x")
    put(f"{tmp_path}/p/t.XML", b"x")
    put(f"{tmp_path}/p/z.zip", b"x")
    r = files.images(spark, f"{tmp_path}/p").first()
    assert (r["h"], r["w"], r["px"]) == (2, 3, [77] * 6)
    assert sorted(x["kind"] for x in files.listing(spark, f"{tmp_path}/p").collect()) == ["image", "mask", "truth"]
    assert files.count_files(spark, f"{tmp_path}/p", (".png",)) == 1
    lines = files.images(spark, f"{tmp_path}/p").select("path", "px", "w")
    assert recognise.recognised(lines).count() == 1


def test_polygons_round_trip(spark, tmp_path):
    df = spark.createDataFrame([([1.9, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0],)], "poly array<double>")
    files.write_polygons(df, f"{tmp_path}/out")
    parts = sorted(f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".txt"))
    data = b"".join(open(f"{tmp_path}/out/{part}", "rb").read() for part in parts)  # noqa: SIM115
    assert data == b"1,2,3,4,5,6,7,8\r\n"
    put(f"{tmp_path}/res/res_12.txt", data + b"\r\n1,2\r\n")
    assert [(r["page_no"], r["poly"]) for r in files.polygons(spark, f"{tmp_path}/res").collect()] == [(12, [1, 2, 3, 4, 5, 6, 7, 8])]


def test_transcriptions_samples_config(spark, tmp_path):
    put(f"{tmp_path}/t/book1/3/3.txt", "uno \nd-\n".encode())
    assert [(r["book"], r["page_no"], r["line_no"], r["text"]) for r in files.transcriptions(spark, f"{tmp_path}/t").orderBy("line_no").collect()] == [("book1", 3, 0, "uno "), ("book1", 3, 1, "d-")]
    s = spark.createDataFrame([("a.jpg", "a")], files.SAMPLES)
    files.write_samples(s, f"{tmp_path}/s")
    assert files.datasets(spark, [f"{tmp_path}/s", None, f"{tmp_path}/s"]).count() == 2
    assert files.datasets(spark, [None]).count() == 0
    c = files.config(spark, '{"lr": 1e-3, "data": {"train": "x"}}', "lr double, data struct<train: string>").first()
    assert (c["lr"], c["data"]["train"]) == (0.001, "x")


def test_pdf_needs_a_renderer(spark, tmp_path):
    put(f"{tmp_path}/b.pdf", b"%PDF")
    got = pdf.read_pages(spark, str(tmp_path), render=lambda data, dpi: iter([data, b"2"])).collect()
    assert [(r["book"], r["page_no"]) for r in got] == [("b", 0), ("b", 1)]
    with pytest.raises(Exception, match="PyMuPDF"):
        pdf.read_pages(spark, str(tmp_path)).collect()


def test_streams(spark, tmp_path):
    put(f"{tmp_path}/in/a.txt", b"x\ny\n")
    q = ingest.arriving_lines(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("lines_seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("lines_seen").count() == 2
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(f"{tmp_path}/log")
    means = ingest.windowed_means(ingest.arriving_log(spark, f"{tmp_path}/log", events.schema), length="1 day")
    q = means.writeStream.format("memory").queryName("means_seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("means_seen").selectExpr("sum(n)").first()[0] == events.count()


def test_colour_and_names(spark, tmp_path):
    put(f"{tmp_path}/p/1.png", png(3, 2, 77))
    r = files.images(spark, f"{tmp_path}/p", colour=True).first()
    assert (r["h"], r["w"], r["px"]) == (2, 3, [77] * 18)
    df = spark.createDataFrame([("folder/x/PORCONES.23.pdf",)], "p string")
    assert df.select(names.book_code(F.col("p"))).first()[0] == "PORCONES.23"


def test_sinks_and_lookups(spark, tmp_path):
    words = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 0, "a"), (1, 1, 2, "c"), (2, 0, 0, "d")], "page_no int, line int, n int, text string")
    files.write_predictions(words, f"{tmp_path}/out", page="page_no", line="line", order="n")
    back = spark.read.text(f"{tmp_path}/out")
    assert sorted((r["page_no"], r["value"]) for r in back.collect()) == [(1, "a b"), (1, "c"), (2, "d")]
    put(f"{tmp_path}/b/res_7_sorted.txt", b"1,2,3\n4,5,6\n;7,8,9;")
    got = [(r["page_no"], r["line_no"], r["ord"], r["c"]) for r in files.box_groups(spark, f"{tmp_path}/b").orderBy("line_no", "ord").collect()]
    assert got == [(7, 0, 0, [1, 2, 3]), (7, 0, 1, [4, 5, 6]), (7, 1, 0, [7, 8, 9])]
    lines = spark.createDataFrame([("x", 0, "a"), ("x", 1, "b"), ("y", 0, "c")], "f string, line_no int, text string")
    assert {r["f"]: r["text"] for r in files.nth_line(lines, 2, ["f"]).collect()} == {"x": "b", "y": None}
    state = spark.createDataFrame([({"module.a.w": 1, "b": 2},)], "s map<string,int>")
    assert state.select(files.without_prefix(F.col("s"))).first()[0] == {"a.w": 1, "b": 2}
    n = spark.createDataFrame([(105, 3, 8, 2)], "a int, b int, c int, d int").select(logs.schedule_steps(*[F.col(c) for c in "abcd"])).first()[0]
    assert n == 19


def test_compositions(spark, tmp_path):
    quads = [(1, i, [10, y, 200, y, 200, y + 20, 10, y + 20]) for i, y in enumerate((40, 90, 140))]
    polygons = spark.createDataFrame(quads, "page_id long, ord long, poly array<long>")
    truth = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd")], "page_id long, text_no int, text string")
    pairs, left = pipelines.samples(polygons, truth)
    assert [(r["y1"], r["text"]) for r in pairs.orderBy("y1").collect()] == [(40, "ab"), (90, "cd")] and left.count() == 1
    found = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cx")], "page_id long, line_no int, text string")
    r = pipelines.evaluated(found, truth, ["page_id"]).first()
    assert (r["edits"], r["chars"], r["cer"]) == (1, 4, 0.25)
    truth.select(F.col("text").alias("ref"), F.lit("ax").alias("pred")).write.parquet(f"{tmp_path}/pairs")
    arriving = spark.readStream.schema("ref string, pred string").parquet(f"{tmp_path}/pairs")
    ingest.scored_into(spark, arriving, f"{tmp_path}/scored", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert sorted((r["ref"], r["edits"], r["chars"]) for r in spark.read.parquet(f"{tmp_path}/scored").collect()) == [("ab", 1, 2), ("cd", 2, 2)]
