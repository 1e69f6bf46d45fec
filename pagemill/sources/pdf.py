"""A Python data source that decodes PDF files, one partition a file.

Decoding needs a PDF library, which is optional: ``option("decoder", "module:function")`` names a function from a path to
page dictionaries with the fields of ``SCHEMA``; without the option PyMuPDF is used if it is installed.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from importlib import import_module

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = (
    "doc_id string, page_number int, width double, page_height double, raw_text string, "
    "spans array<struct<block_no:int,line_no:int,span_no:int,text:string,size:double,flags:int,x0:double,y0:double,x1:double,y1:double>>, "
    "words array<struct<word_no:int,x0:double,y0:double,x1:double,y1:double,text:string>>, "
    "tables array<struct<table_no:int,y0:double,y1:double,cells:array<array<string>>>>, "
    "images array<struct<xref:int,rect_no:int,y0:double,ext:string,image:binary>>, path string"
)

#: Resolution at which pages are rendered for a model; a fixed value.
PAGE_DPI = 150


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def pdf_files(path: str) -> list[str]:
    """A PDF file, or those of a folder (not of folders below), sorted; none is an error. Local paths and URIs alike."""
    system, base = file_system(path)
    if system.get_file_info(base).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith((".pdf", ".PDF")))
    if not names:
        raise FileNotFoundError(f"no PDF files in {path}")
    return [f"{path.rstrip('/')}/{n}" for n in names]


@contextmanager
def local_copy(path: str) -> Iterator[str]:
    """A local path of a file, for decoders that need one: itself, or a copy that is deleted afterwards."""
    if "://" not in path or path.startswith("file://"):
        yield path.removeprefix("file://")
        return
    system, base = file_system(path)
    with tempfile.TemporaryDirectory(prefix="pagemill-pdf-") as folder:
        name = os.path.join(folder, os.path.basename(base))
        with system.open_input_stream(base) as source, open(name, "wb") as target:
            while block := source.read(1 << 20):
                target.write(block)
        yield name


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _decoder(name: str | None) -> Callable[[str], Iterator[dict]]:
    if name:
        module, _, attr = name.partition(":")
        return getattr(import_module(module), attr)
    return _mupdf


def _mupdf(path: str) -> Iterator[dict]:
    try:
        import fitz
    except ImportError as e:
        raise ImportError("decoding PDF files needs PyMuPDF, or a decoder named in the options") from e
    with fitz.open(path) as doc:
        for n, page in enumerate(doc, 1):
            layout = page.get_text("dict", flags=fitz.TEXT_PRESERVE_WHITESPACE)["blocks"]
            spans = [
                dict(block_no=b, line_no=i, span_no=k, text=s["text"], size=float(s["size"]), flags=int(s["flags"]), x0=block["bbox"][0], y0=block["bbox"][1], x1=block["bbox"][2], y1=block["bbox"][3])
                for b, block in enumerate(layout)
                if block.get("type") == 0
                for i, line in enumerate(block["lines"])
                for k, s in enumerate(line["spans"])
            ]
            try:
                tables = [dict(table_no=k, y0=t.bbox[1], y1=t.bbox[3], cells=t.extract()) for k, t in enumerate(page.find_tables().tables)]
            except Exception:  # the finder gives up on some pages; they have no tables then
                tables = []
            images = []
            for image in page.get_images(full=True):
                info = doc.extract_image(image[0])
                images += [dict(xref=image[0], rect_no=len(images) + k, y0=r.y0, ext=info.get("ext") or "png", image=info.get("image")) for k, r in enumerate(page.get_image_rects(image[0]), 1)]
            yield dict(
                page_number=n,
                width=page.rect.width,
                page_height=page.rect.height,
                raw_text=page.get_text(),
                spans=spans,
                words=[dict(word_no=k, x0=w[0], y0=w[1], x1=w[2], y1=w[3], text=w[4]) for k, w in enumerate(page.get_text("words"))],
                tables=tables,
                images=images,
            )


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.decoder = options.get("path", ""), options.get("decoder")

    def partitions(self) -> list[File]:
        return [File(f) for f in pdf_files(self.path)]

    def read(self, partition: File) -> Iterator[tuple]:
        from pyspark.sql import Row

        doc_id = os.path.splitext(os.path.basename(partition.path))[0]
        names = _parse_fields(SCHEMA)
        with local_copy(partition.path) as path:
            for page in _decoder(self.decoder)(path):
                page = {**page, "doc_id": doc_id, "path": partition.path}
                yield tuple([Row(**x) for x in page.get(c) or []] if c in ("spans", "words", "tables", "images") else page.get(c) for c in names)


def _parse_fields(schema: str) -> list[str]:
    depth, names, word = 0, [], ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            names.append(word.split()[0])
            word = ""
        else:
            word += c
    return names


class PdfSource(DataSource):
    """``spark.dataSource.register(PdfSource)``, then ``spark.read.format("pagemill_pdf").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "pagemill_pdf"

    def schema(self) -> str | StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> PdfReader:
        return PdfReader(dict(self.options))


def exploded(pages: DataFrame, part: str) -> DataFrame:
    """One of ``spans``, ``words``, ``tables`` and ``images`` as a table of its own."""
    return pages.select("doc_id", "page_number", F.explode(part).alias("p")).select("doc_id", "page_number", "p.*")


def _mupdf_page(path: str, number: int, dpi: int) -> bytes:
    try:
        import fitz
    except ImportError as e:
        raise ImportError("rendering pages needs PyMuPDF, or a renderer") from e
    with fitz.open(path) as doc:
        return doc[number - 1].get_pixmap(dpi=dpi, alpha=False).tobytes("png")


@dataclass(frozen=True)
class PageImage:
    """Renders a job's page (``path``, ``page_number``) as PNG where it is sent to a model, and keeps it as an asset of its document under ``root`` if there is one."""

    root: str | None = None
    dpi: int = PAGE_DPI
    renderer: Callable[[str, int, int], bytes] = _mupdf_page

    def __call__(self, job: dict) -> bytes:
        with local_copy(job["path"]) as path:
            image = self.renderer(path, job["page_number"], self.dpi)
        if self.root:
            system, base = file_system(self.root)
            folder = f"{base}/{job['doc_id']}/assets"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/page-{job['page_number']:03d}-full.png") as out:
                out.write(image)
        return image


def render(jobs: DataFrame, dpi: int = PAGE_DPI, renderer: Callable[[str, int, int], bytes] = _mupdf_page) -> DataFrame:
    """``jobs`` (``path``, ``page_number``, ...) with the page as PNG in ``image``, a row at a time; for use outside the pipeline, which renders where it sends."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructField

    out = StructType([*jobs.schema.fields, StructField("image", BinaryType())])
    make = PageImage(None, dpi, renderer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index
            for i, (p, n) in enumerate(zip(b.column(at("path")).to_pylist(), b.column(at("page_number")).to_pylist())):
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([make({"path": p, "page_number": n})], type=pa.binary())], names=[*b.schema.names, "image"])

    return jobs.mapInArrow(run, out)
