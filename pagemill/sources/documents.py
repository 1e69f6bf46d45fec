"""Reading and writing documents: file listings, manifests, page and canonical texts."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import debug_name, page_file
from pagemill.plans.storage import broadcast_if_small, materialize

MANIFEST = "doc_id string, source_pdf string, generated_at bigint, success boolean, repeated_texts array<string>, image_ocr map<string,string>, pages array<struct<page_number:int,page_file:string,validated:boolean,method:string,warnings:array<string>,assets:array<string>,attempts:array<struct<method:string,ok:boolean,warnings:array<string>>>>>"


def list_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """PDF files of a folder (not of folders below) or one file: ``doc_id, path, length, modificationTime`` and ``content`` on request.

    A missing path or a folder without PDFs is an error.
    """
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").option("recursiveFileLookup", "false").load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.[pP][dD][fF]$", 1)
    df = df.select(stem.alias("doc_id"), "path", "length", "modificationTime", *(["content"] if content else []))
    if df.select("path").limit(1).count() == 0:
        raise FileNotFoundError(f"no PDF files in {path}")
    return df


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files (one JSON object each); what a manifest leaves out is empty, not NULL."""
    df = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return df.withColumns(
        {
            "repeated_texts": F.coalesce("repeated_texts", F.array().cast("array<string>")),
            "image_ocr": F.coalesce("image_ocr", F.create_map().cast("map<string,string>")),
            "success": F.coalesce("success", F.lit(False)),
        }
    )


def write_manifests(manifests: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, UTF-8, non-ASCII kept."""
    manifests.write.mode(mode).option("ignoreNullFields", "false").json(path)


def unfinished(documents: DataFrame, finished: DataFrame, force: bool = False) -> DataFrame:
    """Documents without a canonical text; all of them if ``force``."""
    return documents if force else documents.join(finished.select("doc_id").distinct(), "doc_id", "left_anti")


def append_run(df: DataFrame, path: str, run: int) -> None:
    """Rows of one run added to a table; a document that a later run has again is superseded, the others are untouched."""
    df.withColumn("run", F.lit(run).cast("bigint")).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Of each document the rows of its last run. Runs are compared by document alone; rows aren't exchanged while documents are few enough to broadcast."""
    df = spark.read.parquet(path)
    last = materialize(df.groupBy("doc_id").agg(F.max("run").alias("run")))
    return df.join(broadcast_if_small(last), ["doc_id", "run"], "left_semi").drop("run")


def export_texts(df: DataFrame, name: str, text: str, root: str) -> None:
    """Write ``text`` of each row to the file ``root/name``, from the executors, on any file system the URI names."""

    def save(rows: Iterable) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))
        for r in rows:
            full = f"{base}/{r[0]}"
            system.create_dir(os.path.dirname(full), recursive=True)
            with system.open_output_stream(full) as out:
                out.write(bytes(r[1]) if isinstance(r[1], (bytes, bytearray)) else (r[1] or "").encode())

    df.select(name, text).foreachPartition(save)


def export_pages(outputs: DataFrame, root: str) -> None:
    """``<doc_id>/pages/NNN.md`` for each page."""
    export_texts(outputs.select(F.concat_ws("/", "doc_id", F.lit("pages"), page_file(F.col("page_number"))).alias("name"), "content"), "name", "content", root)


def export_canonical(texts: DataFrame, root: str) -> None:
    """``<doc_id>/canonical.md`` and a named copy beside the document's folder."""
    both = texts.select(F.explode(F.array(F.concat_ws("/", "doc_id", F.lit("canonical.md")), F.concat("doc_id", F.lit(".md")))).alias("name"), "markdown")
    export_texts(both, "name", "markdown", root)


def export_manifests(manifests: DataFrame, root: str) -> None:
    """``<doc_id>/manifest.json``: the fields of ``MANIFEST``, indented, non-ASCII kept."""
    fields = F.struct(*manifests.columns)
    export_texts(manifests.select(F.concat_ws("/", "doc_id", F.lit("manifest.json")).alias("name"), F.to_json(fields, {"pretty": "true", "ignoreNullFields": "false"}).alias("json")), "name", "json", root)


def export_debug(tried: DataFrame, root: str) -> None:
    """``<doc_id>/debug/page-NNN.<way>.md`` for each local way that was tried: ``doc_id, page_number, native_markdown, coords_markdown``."""
    ways = F.array(*(F.struct(F.lit(s).alias("suffix"), F.col(c).alias("text")) for s, c in (("native.md", "native_markdown"), ("native-coords.md", "coords_markdown"))))
    each = tried.select("doc_id", "page_number", F.explode(F.filter(ways, lambda w: w["text"].isNotNull())).alias("w"))
    export_texts(each.select(F.concat_ws("/", "doc_id", F.lit("debug"), debug_name(F.col("page_number"), F.col("w.suffix"))).alias("name"), "w.text"), "name", "text", root)


def delete_documents(documents: DataFrame, root: str) -> None:
    """The folders of documents under ``root`` deleted, with all that is in them."""

    def drop(rows: Iterable) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))
        for r in rows:
            if system.get_file_info(f"{base}/{r.doc_id}").type == fs.FileType.Directory:
                system.delete_dir(f"{base}/{r.doc_id}")

    documents.select("doc_id").distinct().foreachPartition(drop)


def export_errors(errors: DataFrame, root: str) -> None:
    """``<doc_id>/errors.txt`` for each document that failed."""
    export_texts(errors.select(F.concat_ws("/", "doc_id", F.lit("errors.txt")).alias("name"), "errors"), "name", "errors", root)


def export_assets(images: DataFrame, root: str) -> None:
    """``<doc_id>/assets/page-NNN-full.png`` for each page image: ``doc_id, page_number, image``."""
    from pagemill.functions.text import page_image_name

    export_texts(images.select(F.concat_ws("/", "doc_id", F.lit("assets"), page_image_name(F.col("page_number"))).alias("name"), "image"), "name", "image", root)


def delete_orphans(orphans: DataFrame, root: str) -> None:
    """Delete the files of ``merge.orphan_assets`` under ``root``; what is gone already is passed over."""

    def drop(rows: Iterable) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))
        for r in rows:
            path = f"{base}/{r.doc_id}/{r.asset}"
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_file(path)

    orphans.select("doc_id", "asset").foreachPartition(drop)
