"""Command line: extract and merge a folder of PDF documents."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import block_text, page_file, page_image_name
from pagemill.operators import coords, cost, layout, merge, repeats
from pagemill.plans.pipeline import PAGE, read_images, route, with_images
from pagemill.plans.providers import HttpTranscriber, Provider, read_env
from pagemill.plans.storage import exists, materialize
from pagemill.plans.transcribe import NoModel, Transcriber
from pagemill.sources import documents
from pagemill.sources.pdf import PageImage, PdfSource, exploded


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="pagemill", description="Turn page-structured documents into validated Markdown.")
    p.add_argument("input", help="a PDF file or a folder of them; a path or URI")
    p.add_argument("-o", "--output", help="output folder; by default 'output' beside the input")
    p.add_argument("-p", "--provider", help="model provider, configured as <NAME>_BASE_URL, <NAME>_MODEL and <NAME>_API_KEY")
    p.add_argument("-v", "--vision-provider", help="provider for pages and images, instead of --provider")
    p.add_argument("--env", default=".env", help="file with settings the environment lacks")
    p.add_argument("--decoder", help="module:function that decodes a file")
    p.add_argument("--ocr-concurrency", type=int, default=8, help="model calls at once in a task")
    p.add_argument("--file-concurrency", type=int, default=3, help="tasks that call the model at once")
    p.add_argument("--chunk-chars", type=int, help="accepted for older scripts; without effect")
    p.add_argument("--force", action="store_true", help="read finished documents again")
    p.add_argument("--stage", choices=("all", "extract", "merge"), default="all")
    p.add_argument("--dry-run", action="store_true", help="count pages and estimate the cost only")
    p.add_argument("--debug", action="store_true", help="keep what each local way made of a page")
    return p.parse_args(argv)


def model_of(args: argparse.Namespace) -> Transcriber:
    """The configured provider's transcriber; without one, pages that need a model are reported as not readable."""
    name = args.vision_provider or args.provider
    return HttpTranscriber(Provider.from_env(name, read_env(args.env))) if name else NoModel()


def decoded(spark: SparkSession, path: str, decoder: str | None = None) -> DataFrame:
    """Pages of the files under ``path``, decoded once."""
    spark.dataSource.register(PdfSource)
    reader = spark.read.format("pagemill_pdf")
    return materialize((reader.option("decoder", decoder) if decoder else reader).load(path))


def text_blocks(pages: DataFrame) -> DataFrame:
    """Text blocks of each page with their lines kept apart: ``doc_id, page_number, page_height, block_no, y0, y1, text``. A page's spans are gathered within its row."""

    def text(own):
        lines = F.array_distinct(F.transform(own, lambda s: s["line_no"]))
        return block_text(F.transform(lines, lambda l: F.transform(F.filter(own, lambda s: s["line_no"] == l), lambda s: s["text"])))

    blocks = layout.let(layout.ordered_spans("spans"), lambda s: F.transform(layout.blocks_of(s), lambda b: F.struct(b["block_no"].alias("block_no"), b["y0"].alias("y0"), b["y1"].alias("y1"), text(b["spans"]).alias("text"))))
    return pages.select("doc_id", "page_number", "page_height", F.explode(blocks).alias("b")).select("doc_id", "page_number", "page_height", "b.*")


def prepared(pages: DataFrame) -> DataFrame:
    """What the routing ladder needs of decoded pages: analysis, native Markdown, coordinate tables, repeated texts, and the file's ``path``."""
    repeated = repeats.repeated_by_document(repeats.repeated_texts(text_blocks(pages)))
    analysis = repeats.analyse_pages(pages.select("doc_id", "page_number", "raw_text", F.size("tables").alias("table_count"), F.size("images").alias("image_blocks")), repeated)
    native = layout.page_markdown("spans", layout.reliable_tables("tables", "raw_text"), F.col("images"))
    rebuilt = coords.rebuild(exploded(pages, "words")).withColumnRenamed("markdown", "coords_markdown")
    return analysis.join(pages.select(*PAGE, "path", native.alias("native_markdown")), PAGE).join(rebuilt, PAGE, "left").join(repeated, "doc_id", "left")


def extract(spark: SparkSession, pages: DataFrame, args: argparse.Namespace, model: Transcriber, out: str, run: int, image=None) -> None:
    """Stage 1: pages routed and written as a run of ``pages.parquet``, manifests, usage, and the files of each document."""
    ready = materialize(prepared(pages))
    if args.force:
        documents.delete_documents(ready, out)
    usage: list[DataFrame] = []
    outputs = materialize(route(ready, model, concurrency=args.ocr_concurrency, image=image, tasks=args.file_concurrency, on_read=usage.append))
    native = ready.where("native_candidate")
    pending = layout.pending_images(exploded(pages, "images").join(native.select(*PAGE), PAGE, "left_semi"))
    images = materialize(read_images(pending, model, args.ocr_concurrency))
    outputs = materialize(with_images(outputs, native, images))
    documents.append_run(outputs, f"{out}/pages.parquet", run)
    name = getattr(getattr(model, "provider", None), "model", type(model).__name__)
    documents.append_run(usage[0].withColumn("model", F.lit(name)), f"{out}/usage.parquet", run)
    gate = merge.document_gate(outputs)
    record = F.struct("page_number", page_file(F.col("page_number")).alias("page_file"), "validated", "method", "warnings", F.array().cast("array<string>").alias("assets"), "attempts")
    records = outputs.groupBy("doc_id").agg(F.sort_array(F.collect_list(record)).alias("pages"))
    listed = ready.select("doc_id", "repeated_texts", F.col("path").alias("source_pdf")).dropDuplicates(["doc_id"])
    manifests = (
        listed.join(images, "doc_id", "left")
        .join(gate.select("doc_id", "success"), "doc_id")
        .join(records, "doc_id")
        .select("doc_id", "source_pdf", F.lit(run // 1000).alias("generated_at"), "success", F.coalesce("repeated_texts", F.array().cast("array<string>")).alias("repeated_texts"), F.coalesce("image_ocr", F.create_map().cast("map<string,string>")).alias("image_ocr"), "pages")
    )
    manifests = materialize(manifests)
    documents.append_run(manifests, f"{out}/manifest.parquet", run)
    documents.export_manifests(manifests, out)
    documents.export_pages(outputs.where("content is not null"), out)
    documents.export_errors(merge.error_texts(gate), out)
    if args.debug:
        documents.export_debug(ready.select(*PAGE, F.when(F.col("native_candidate"), F.col("native_markdown")).alias("native_markdown"), "coords_markdown"), out)


def merged(spark: SparkSession, out: str, run: int, only: DataFrame | None = None) -> None:
    """Stage 2: canonical texts of the documents whose pages are all validated, and page images that they don't mention deleted.

    With none that is, it is an error that names one; documents that failed keep their ``errors.txt``.
    """
    outputs = documents.read_runs(spark, f"{out}/pages.parquet")
    if only is not None:
        outputs = outputs.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    gate = materialize(merge.document_gate(outputs))
    good = gate.where("success").select("doc_id")
    if good.limit(1).count() == 0:
        merge.require_validated(outputs)
    lacking = merge.missing_outputs(outputs.join(good, "doc_id", "left_semi"), outputs).limit(1).collect()
    if lacking:
        raise ValueError(f"page {lacking[0].page_number} of {lacking[0].doc_id} has no output")
    texts = materialize(merge.canonical(outputs.join(good, "doc_id", "left_semi"), documents.read_runs(spark, f"{out}/manifest.parquet")))
    documents.append_run(texts, f"{out}/canonical.parquet", run)
    documents.export_canonical(texts, out)
    assets = outputs.join(good, "doc_id", "left_semi").where("method is null or method not in ('native', 'native-coords')").select("doc_id", F.concat(F.lit("assets/"), page_image_name(F.col("page_number"))).alias("asset"))
    documents.delete_orphans(merge.orphan_assets(assets, texts), out)


def run(spark: SparkSession, args: argparse.Namespace, model: Transcriber | None = None, image=None) -> DataFrame:
    """The command's result: an estimate, page outputs, or canonical texts. ``model`` and ``image`` stand in for the provider and the renderer."""
    out = args.output or (args.input.rstrip("/").rpartition("/")[0] + "/output" if "://" in args.input else os.path.join(os.path.dirname(os.path.abspath(args.input)), "output"))
    began = int(time.time() * 1000)
    texts = f"{out}/canonical.parquet"
    pages = None
    if args.stage != "merge" or args.dry_run:
        pages = decoded(spark, args.input, args.decoder)
        if not args.force and not args.dry_run and exists(spark, texts):
            pages = materialize(documents.unfinished(pages, documents.read_runs(spark, texts)))
        if args.dry_run:
            return cost.dry_run(pages, "doc_id")
        if pages.limit(1).count():
            model = model or model_of(args)
            if image is None and isinstance(model, HttpTranscriber):
                image = PageImage(out)
            extract(spark, pages, args, model, out, began, image)
        elif args.stage == "all":
            return documents.read_runs(spark, texts)
    if args.stage == "extract":
        return documents.read_runs(spark, f"{out}/pages.parquet")
    merged(spark, out, began, pages)
    return documents.read_runs(spark, texts)


def summary(spark: SparkSession, out: str, prices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents that succeeded and failed, and tokens and costs of the model calls, over the last run of each document."""
    prices = prices if prices is not None else spark.createDataFrame([], "model string, input double, output double")
    return cost.batch_summary(documents.read_runs(spark, f"{out}/manifest.parquet")), cost.usage_cost(documents.read_runs(spark, f"{out}/usage.parquet"), prices)


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("pagemill").config("spark.sql.execution.arrow.maxRecordsPerBatch", "256").getOrCreate()
    args = arguments(argv)
    result = run(spark, args)
    if args.dry_run:
        result.show(1000, truncate=False)
        return
    result.select("doc_id").distinct().show(1000, truncate=False)
    out = args.output or os.path.join(os.path.dirname(os.path.abspath(args.input)), "output")
    for table in summary(spark, out):
        table.show(1000, truncate=False)


if __name__ == "__main__":
    main()
