import json

import pytest
from pyspark.sql import functions as F

from pagemill.plans import cli
from pagemill.plans.storage import broadcast_if_small, exists, materialize, scratch, shared_dir
from pagemill.plans.transcribe import StandIn
from pagemill.sources import documents, pdf
from pagemill.streaming import incremental


def fake_decoder(path):
    """Two pages: one with a text layer, one without."""
    text = "这是一页有文本层的正文，长度足够，可以直接读取，没有任何乱码，也不需要视觉模型。2024年度共有12项投资。"
    span = lambda t: dict(block_no=1, line_no=1, span_no=1, text=t, size=11.0, flags=0, x0=0.0, y0=50.0, x1=9.0, y1=60.0)
    yield dict(page_number=1, width=100.0, page_height=100.0, raw_text=text, spans=[span(text)], words=[], tables=[], images=[])
    yield dict(page_number=2, width=100.0, page_height=100.0, raw_text="", spans=[], words=[], tables=[dict(table_no=1, y0=1.0, y1=2.0, cells=[["a", None]])], images=[])


@pytest.fixture
def folder(tmp_path):
    for n in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / n).write_bytes(b"%PDF")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_bytes(b"%PDF")
    return tmp_path


def test_listing(spark, folder, tmp_path):
    assert sorted(r.doc_id for r in documents.list_files(spark, str(folder)).collect()) == ["a", "b"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        documents.list_files(spark, str(tmp_path / "empty")).count()


def test_pdf_source(spark, folder):
    spark.dataSource.register(pdf.PdfSource)
    df = spark.read.format("pagemill_pdf").option("decoder", "test_sources:fake_decoder").load(str(folder))
    assert sorted((r.doc_id, r.page_number) for r in df.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert pdf.exploded(df, "spans").count() == 2 and pdf.exploded(df, "tables").first().cells == [["a", None]]
    with pytest.raises(FileNotFoundError):
        pdf.PdfReader({"path": str(folder / "sub" / "none")}).partitions()


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"doc_id": "d", "source_pdf": "d.pdf", "pages": [{"page_number": 1, "validated": True}]}, indent=2, ensure_ascii=False))
    m = documents.read_manifests(spark, str(tmp_path / "m.json"))
    r = m.first()
    assert r.repeated_texts == [] and r.image_ocr == {} and r.success is False and r.pages[0].validated
    documents.write_manifests(m.withColumn("source_pdf", F.lit("报告.pdf")), str(tmp_path / "out"))
    assert "报告.pdf" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_exports(spark, tmp_path):
    out = spark.createDataFrame([("d", 3, "第三页")], "doc_id string, page_number int, content string")
    documents.export_pages(out, str(tmp_path))
    assert (tmp_path / "d/pages/003.md").read_text() == "第三页"
    documents.export_canonical(spark.createDataFrame([("d", "全文\n")], "doc_id string, markdown string"), str(tmp_path))
    assert (tmp_path / "d/canonical.md").read_text() == (tmp_path / "d.md").read_text() == "全文\n"


def test_resume(spark):
    docs, done = (spark.createDataFrame([(x,) for x in xs], "doc_id string") for xs in ("ab", "b"))
    assert [r.doc_id for r in documents.unfinished(docs, done).collect()] == ["a"]
    assert documents.unfinished(docs, done, force=True).count() == 2


def test_storage(spark):
    df = materialize(spark.range(10))
    assert df.count() == 10
    assert "broadcast" in broadcast_if_small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(df, 5)._jdf.queryExecution().logical().toString().lower()
    wide = materialize(spark.range(4).select("id", F.repeat(F.lit("文"), 500).alias("t"), F.array(F.lit(None).cast("string")).alias("a")))
    assert "broadcast" in broadcast_if_small(wide, size=8000)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(wide, size=6000)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in broadcast_if_small(wide.limit(0))._jdf.queryExecution().logical().toString().lower()


def test_scratch_is_dropped(spark):
    with scratch(spark):
        df = materialize(spark.range(3))
        with scratch(spark):
            inner = materialize(spark.range(4))
        assert not exists(spark, inner.inputFiles()[0]) and df.count() == 3
    assert not exists(spark, df.inputFiles()[0]) and exists(spark, materialize(spark.range(1)).inputFiles()[0])


class FakeSession:
    class conf:
        get = staticmethod(lambda name, default=None: default)

    def __init__(self, master):
        self.sparkContext = type("C", (), {"master": master, "getCheckpointDir": lambda self: None})()


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession(master))


def test_command(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    base = [str(folder), "-o", out, "--decoder", "test_sources:fake_decoder"]
    estimate = {r.doc_id: r.scan_pages for r in cli.run(spark, cli.arguments([*base, "--dry-run"])).collect()}
    assert estimate == {"a": 1, "b": 1, None: 2}
    texts = {r.doc_id: r.markdown for r in cli.run(spark, cli.arguments(base), StandIn("raw_text")).collect()}
    assert set(texts) == {"a", "b"} and "page:1 method:native" in texts["a"] and "[空白页]" in texts["a"]
    assert (tmp_path / "out/a/canonical.md").exists()


def image_decoder(path):
    """Three pages with an embedded image each and a header; in file b a page that no model can read."""
    text = "这是一页有文本层的正文，长度足够，可以直接读取，没有任何乱码，也不需要视觉模型。2024年度共有12项投资。"
    span = lambda b, t, y: dict(block_no=b, line_no=1, span_no=1, text=t, size=11.0, flags=0, x0=0.0, y0=y, x1=9.0, y1=y + 5)
    for n in (1, 2, 3):
        image = dict(xref=n, rect_no=1, y0=80.0, ext="png", image=b"chart")
        yield dict(page_number=n, width=100.0, page_height=100.0, raw_text="页眉文字\n" + text, spans=[span(1, "页眉文字", 2.0), span(2, text, 50.0)], words=[], tables=[], images=[image])
    if "b." in str(path):
        yield dict(page_number=4, width=100.0, page_height=100.0, raw_text="", spans=[], words=[], tables=[], images=[])


class ImageReader:
    def __call__(self, job, prompt):
        from pagemill.plans.transcribe import Reply

        if "placeholder_id" not in job:
            raise RuntimeError("no page can be read")
        return Reply("图中文字" + job["placeholder_id"])


def test_command_reads_images(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    args = cli.arguments([str(folder), "-o", out, "--decoder", "test_sources:image_decoder"])
    texts = {r.doc_id: r.markdown for r in cli.run(spark, args, ImageReader()).collect()}
    assert set(texts) == {"a"} and "IMG_OCR" not in texts["a"]
    assert [texts["a"].count(f"图中文字xref-{n}") for n in (1, 2, 3)] == [1, 1, 1]
    kept = documents.read_runs(spark, out + "/manifest.parquet").where("doc_id = 'a'").first()
    assert kept.repeated_texts == ["页眉文字"] and set(kept.image_ocr) == {"xref-1", "xref-2", "xref-3"}
    assert (tmp_path / "out/b/errors.txt").read_text() == "以下页面未通过校验：4" and not (tmp_path / "out/a/errors.txt").exists()


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([("s", 1), ("s", 2)], "source string, page_number int")
    df.write.parquet(str(src))
    stream = incremental.page_stream(spark, str(src), df.schema)
    q = incremental.run_batches(stream, lambda b: b.groupBy("source").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["count"] == 2
