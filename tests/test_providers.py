import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from pagemill.plans import providers as P
from pagemill.plans.pipeline import split_pages
from pagemill.sources import documents, pdf
from pagemill.streaming import incremental

PNG = b"\x89PNG" + b"x" * 20
ENV = {"ACME_BASE_URL": "http://localhost/v1/", "ACME_MODEL": "gpt-5-x", "ACME_API_KEY": "k"}


def test_settings():
    p = P.Provider.from_env("acme", ENV)
    assert (p.base_url, p.model, p.key_name, p.style) == ("http://localhost/v1", "gpt-5-x", "ACME_API_KEY", "chat")
    with pytest.raises(ValueError, match="ACME_MODEL"):
        P.Provider.from_env("acme", {**ENV, "ACME_MODEL": ""})


def test_requests():
    assert P.limit_name("o3-mini") == P.limit_name("gpt-5") == "max_completion_tokens" and P.limit_name("qwen") == "max_tokens"
    body = P.chat_request("gpt-5", "read", PNG)
    url = body["messages"][0]["content"][1]["image_url"]["url"]
    assert url.startswith("data:image/png;base64,") and base64.b64decode(url.partition(",")[2]) == PNG
    block = P.message_request("m", body["messages"][0]["content"])["messages"][0]["content"][1]
    assert block["source"]["media_type"] == "image/png" and base64.b64decode(block["source"]["data"]) == PNG
    assert P.mime_type(b"\xff\xd8..") == "image/jpeg" and P.mime_type(b"?") == "application/octet-stream"


def test_answers():
    assert P.reply_of("chat", {"choices": [{"message": {"content": " a "}}], "usage": {"prompt_tokens": 3, "completion_tokens": None}}) == P.Reply("a", 3, 0)
    assert P.reply_of("messages", {"content": [{"type": "text", "text": "b"}], "usage": {"input_tokens": 1, "output_tokens": 2}}) == P.Reply("b", 1, 2)
    assert P.reply_of("chat", {}) == P.Reply("")


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("/messages"):
            answer = {"content": [{"type": "text", "text": self.headers["x-api-key"] + body["model"]}]}
        else:
            answer = {"choices": [{"message": {"content": self.headers["Authorization"] + body["model"]}}]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *args):
        pass


@pytest.mark.parametrize("style, text", [("chat", "Bearer km"), ("messages", "km")])
def test_http(monkeypatch, style, text):
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("ACME_API_KEY", "k")
    p = P.Provider("acme", f"http://127.0.0.1:{server.server_port}/v1", "m", "ACME_API_KEY", style)
    assert P.HttpTranscriber(p)({"image": PNG}, "read").text == text
    server.shutdown()


def fake_renderer(path, number, dpi):
    return f"{path}:{number}:{dpi}".encode()


def test_render_and_export(spark, tmp_path):
    jobs = spark.createDataFrame([("d", "a.pdf", 2)], "doc_id string, path string, page_number int")
    out = pdf.render(jobs, renderer=fake_renderer)
    assert bytes(out.first().image) == b"a.pdf:2:150"
    documents.export_assets(out, str(tmp_path))
    documents.export_errors(spark.createDataFrame([("d", "以下页面未通过校验：2")], "doc_id string, errors string"), str(tmp_path))
    asset = tmp_path / "d/assets/page-002-full.png"
    assert asset.read_bytes() == b"a.pdf:2:150" and (tmp_path / "d/errors.txt").read_text().endswith("2")
    gone = spark.createDataFrame([("d", "assets/page-002-full.png"), ("d", "assets/none.png")], "doc_id string, asset string")
    documents.delete_orphans(gone, str(tmp_path))
    assert not asset.exists()


def test_split(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "page_number int, native_candidate boolean")
    text, scan = split_pages(df)
    assert text.count() == 1 and scan.count() == 2


def test_arrivals(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id) as ts, 's' as source from range(5) t(id)".replace("make_interval(0,0,0,0,0,id)", "make_dt_interval(0, 0, cast(id * 20 as int), 0)"))
    df.write.parquet(str(src))
    stream = incremental.page_stream(spark, str(src), df.schema)
    q = incremental.arrivals(stream, "ts").writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.pages for r in spark.table("arrived").collect()) == [2, 3]
