"""The command from files to canonical texts, with a fake decoder and renderer and a model behind a local HTTP server."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from pagemill.plans import cli
from pagemill.plans.transcribe import Hopeless, NoModel, Reply, answered, attempt
from pagemill.sources import documents
from pagemill.sources.pdf import PageImage, file_system, local_copy, pdf_files

BODY = "本页介绍基金在报告期内的投资情况，文字层完整，可以直接读取，不需要图像识别。合计共有18项投资，账面成本为7,200万元。"


def page(n, raw, header=(), image=None):
    span = lambda b, l, t, y: dict(block_no=b, line_no=l, span_no=1, text=t, size=11.0, flags=0, x0=0.0, y0=y, x1=9.0, y1=y + 2)
    spans = [span(1, i, t, 2.0 + 2 * i) for i, t in enumerate(header)] + ([span(2, 1, raw, 50.0)] if raw else [])
    text = "\n".join([*header, raw]) if raw else ""
    return dict(page_number=n, width=100.0, page_height=100.0, raw_text=text, spans=spans, words=[], tables=[], images=[image] if image else [])


def decoder(path):
    """By name: a report with a text layer and a header of two lines, one that was scanned, one whose font is broken."""
    if "native" in path:
        for n in (1, 2, 3):
            yield page(n, f"{BODY}第{n}段。", ("星桥资本", "二〇二四年度报告"))
    elif "scan" in path:
        yield page(1, "")
        yield page(2, f"{BODY}后记。")
    else:
        yield page(1, "睡睢督睤睥" * 20)


class Model(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        url = body["messages"][0]["content"][1]["image_url"]["url"]
        Model.asked.append(url)
        answer = {"choices": [{"message": {"content": "识别得到的正文，内容完整。" * 20}}], "usage": {"prompt_tokens": 100, "completion_tokens": 40}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Model.asked.clear()
    yield s
    s.shutdown()


def png(path, number, dpi):
    return b"\x89PNG" + f"{path}:{number}".encode()


def test_from_files_to_texts(spark, tmp_path, server):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for n in ("native", "scan"):
        (src / f"{n}.pdf").write_bytes(b"%PDF")
    (tmp_path / "env").write_text(f"# settings\nPAGEMILL_TEST_BASE_URL='http://127.0.0.1:{server.server_port}/v1'\nPAGEMILL_TEST_MODEL=m1\n")
    base = [str(src), "-o", str(out), "--decoder", "test_pipeline:decoder", "-p", "pagemill-test", "--env", str(tmp_path / "env"), "--chunk-chars", "9"]
    go = lambda *more: cli.run(spark, cli.arguments([*base, *more]), image=PageImage(str(out), renderer=png))
    texts = {r.doc_id: r.markdown for r in go("--debug").collect()}
    assert set(texts) == {"native", "scan"} and len(Model.asked) == 1
    assert "page:1 method:vision" in texts["scan"] and "识别得到的正文" in texts["scan"] and "page:2 method:native" in texts["scan"]
    # the header's two lines are one text of the text layer, found and listed as it stands there
    m = json.loads((out / "native/manifest.json").read_text())
    assert m["success"] and m["repeated_texts"] == ["星桥资本\n二〇二四年度报告"] and [p["method"] for p in m["pages"]] == ["native"] * 3
    assert documents.read_manifests(spark, str(out / "native/manifest.json")).first().pages[2].page_file == "003.md"
    assert (out / "native/pages/002.md").read_text().startswith("<!-- page:2 method:native -->")
    assert (out / "native/debug/page-002.native.md").exists() and (out / "scan/canonical.md").read_text() == (out / "scan.md").read_text() == texts["scan"]
    # the page's picture was kept for the model and goes, as no text mentions it
    assert not list((out / "scan/assets").iterdir())
    # a later run reads only what is new, and loses nothing of what there was
    (src / "broken.pdf").write_bytes(b"%PDF")
    assert {r.doc_id for r in go().collect()} == {"native", "scan", "broken"} and len(Model.asked) == 2
    assert documents.read_runs(spark, f"{out}/pages.parquet").groupBy("doc_id").count().count() == 3
    assert {r.doc_id for r in go().collect()} == {"native", "scan", "broken"} and len(Model.asked) == 2
    done, costs = cli.summary(spark, str(out), spark.createDataFrame([("m1", 1.0, 10.0)], "model string, input double, output double"))
    assert tuple(done.first()) == (3, 0) and costs.first().prompt_tokens == 200 and costs.first().cost == pytest.approx(0.001)
    assert {r.doc_id for r in go("--force").collect()} == {"native", "scan", "broken"} and len(Model.asked) == 4
    assert documents.read_runs(spark, f"{out}/canonical.parquet").count() == 3
    assert go("--stage", "merge").count() == 3 and go("--stage", "extract").count() == 6


def test_without_a_model(spark, tmp_path):
    """Pages that need one are reported; no text is invented, and what stands without a model is merged."""
    for n in ("native", "scan"):
        (tmp_path / f"{n}.pdf").write_bytes(b"%PDF")
    out = tmp_path / "out"
    args = lambda *f: cli.arguments([str(tmp_path / f[0]) if f else str(tmp_path), "-o", str(out), "--decoder", "test_pipeline:decoder", "--env", "none"])
    assert [r.doc_id for r in cli.run(spark, args()).collect()] == ["native"]
    assert (out / "scan/errors.txt").read_text() == "以下页面未通过校验：1" and not (out / "scan.md").exists()
    bad = documents.read_runs(spark, f"{out}/pages.parquet").where("not validated").first()
    assert bad.warnings == ["no model provider is configured"] and bad.content is None
    with pytest.raises(ValueError, match="scan"):
        cli.run(spark, args("scan.pdf"))


def test_answers_as_they_finish():
    began = time.monotonic()
    wait = {0: 30, 1: 0.1, 2: 30, 3: 0.05, 4: 0}

    def call(job):
        time.sleep(wait[job["k"]])
        if job["k"] == 4:
            raise RuntimeError("x")
        return Reply(str(job["k"]))

    got = {j["k"]: r for j, r in answered(({"k": k} for k in range(5)), call, 1, 0.4)}
    assert time.monotonic() - began < 5  # hung calls hold neither the others nor the end
    assert got[0] is got[2] is None and got[1].text == "1" and got[3].text == "3" and isinstance(got[4], RuntimeError)
    assert list(answered([], call, 3, None)) == []


def test_hopeless_errors_are_not_tried_again():
    tries = []

    def call():
        tries.append(1)
        return NoModel()({}, "")

    with pytest.raises(Hopeless):
        attempt(call, sleep=lambda s: None)
    assert len(tries) == 1


def test_files_of_any_file_system(tmp_path):
    (tmp_path / "b.PDF").write_bytes(b"2")
    (tmp_path / "a.pdf").write_bytes(b"1")
    (tmp_path / "c.txt").write_bytes(b"3")
    uri = tmp_path.as_uri()
    assert pdf_files(uri) == [f"{uri}/a.pdf", f"{uri}/b.PDF"] and pdf_files(f"{uri}/a.pdf") == [f"{uri}/a.pdf"]
    with local_copy(f"{uri}/a.pdf") as path:
        assert open(path, "rb").read() == b"1"
    with pytest.raises(FileNotFoundError):
        pdf_files(str(tmp_path / "none"))
    assert file_system(uri)[1] == str(tmp_path)
