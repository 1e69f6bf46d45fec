"""The routing ladder: the cheapest way of reading a page that passes its checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.quality import FELL_BACK, page_warnings, wants_coordinates, wants_fallback
from pagemill.functions.text import FAILED_IMAGE, fill_images, mark_cut_years, or_empty_page, page_marker, reinsert_listed
from pagemill.operators import correct, nouns, repetition
from pagemill.operators.line_tables import align_pipe_tables, plain_tables
from pagemill.plans.storage import materialize
from pagemill.plans.transcribe import IMAGE_PROMPT, Transcriber, transcribe

PAGE = ["doc_id", "page_number"]
OUTPUT = [*PAGE, "method", "content", "validated", "warnings", "attempts"]


def _warned(markdown: Column, method: str) -> Column:
    return page_warnings(markdown, F.lit(method), F.col("has_tables"), F.col("body_text"), F.col("raw_text"))


def _attempt(method: str, markdown: str, warnings: str) -> Column:
    ok = (F.size(warnings) == 0) & (F.length(F.trim(F.coalesce(F.col(markdown), F.lit("")))) > 0)
    return F.struct(F.lit(method).alias("method"), ok.alias("ok"), F.col(warnings).alias("warnings"))


def split_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages whose text layer can be used, and those that have to be read from their image."""
    return pages.where(F.col("native_candidate")), pages.where(~F.coalesce("native_candidate", F.lit(False)))


def local_ways(pages: DataFrame) -> DataFrame:
    """Pages with the checks of their two local ways: native text, then a table rebuilt from coordinates.

    ``pages`` has the analysis columns, ``native_markdown`` and ``coords_markdown`` (both without marker, either NULL).
    Adds ``native_warnings``, ``coords_warnings``, ``way`` (``native``, ``native-coords`` or NULL) and ``attempts``.
    """
    none = F.lit(None).cast("array<string>")
    df = pages.withColumn("native_warnings", F.when(F.col("native_candidate"), _warned(F.col("native_markdown"), "native")).otherwise(none))
    tried = F.coalesce(wants_coordinates(F.col("native_warnings")), F.lit(False)) & F.col("coords_markdown").isNotNull()
    df = df.withColumn("coords_warnings", F.when(tried, _warned(F.col("coords_markdown"), "native")).otherwise(none))
    way = F.when(F.size("native_warnings") == 0, "native").when(F.size("coords_warnings") == 0, "native-coords")
    attempts = F.array(
        F.when(F.col("native_warnings").isNotNull(), _attempt("native", "native_markdown", "native_warnings")),
        F.when(F.col("coords_warnings").isNotNull(), _attempt("native-coords", "coords_markdown", "coords_warnings")),
    )
    return df.withColumn("way", way).withColumn("attempts", F.filter(attempts, lambda a: a.isNotNull()))


def accepted(local: DataFrame) -> DataFrame:
    """Outputs of the pages that a local way reads."""
    text = F.when(F.col("way") == "native", F.col("native_markdown")).otherwise(F.col("coords_markdown"))
    content = F.concat(page_marker(F.col("page_number"), F.col("way")), F.lit("\n"), or_empty_page(text))
    return local.where("way is not null").select(*PAGE, F.col("way").alias("method"), content.alias("content"), F.lit(True).alias("validated"), F.array().cast("array<string>").alias("warnings"), "attempts")


def repaired(read: DataFrame, known: DataFrame | None, repairs: bool = True) -> DataFrame:
    """Transcripts after their repairs, in this order: loops, plain tables, pipe tables, text layer, names, years, headers."""
    df = read
    if repairs:
        df = repetition.without_loops(df, "text")
        df = df.withColumn("text", plain_tables(F.col("text"))).withColumn("text", align_pipe_tables(F.col("text")))
        # Python functions run for every row they are given, so only pages with a sound text layer are
        sound = (F.length(F.coalesce("raw_text", F.lit(""))) > 0) & ~F.coalesce("garbled", F.lit(False))
        df = correct.correct_by_text_layer(df.where(sound), "text", "raw_text").unionByName(df.where(~sound))
        if known is not None:
            df = correct.correct_names(df.join(known, "doc_id", "left"), "text", "nouns", "raw_text").drop("nouns")
    return df.withColumn("text", reinsert_listed(mark_cut_years("text"), F.coalesce("raw_text", F.lit("")), F.col("repeated_texts")))


def judged(read: DataFrame) -> DataFrame:
    """Outputs of transcribed pages: kept with their warnings, or replaced by the text layer where far too short."""
    content = F.concat(page_marker(F.col("page_number"), F.lit("vision")), F.lit("\n"), or_empty_page(F.col("text")))
    df = read.withColumn("content", content).withColumn("found", _warned(F.col("content"), "vision"))
    back = wants_fallback(F.col("found"), F.col("raw_text"))
    raw = F.concat(page_marker(F.col("page_number"), F.lit("native-fallback")), F.lit("\n"), F.col("raw_text"))
    failed = F.col("error").isNotNull()
    return df.select(
        *PAGE,
        F.when(~failed, F.when(back, "native-fallback").otherwise("vision")).alias("method"),
        F.when(~failed, F.when(back, raw).otherwise(F.col("content"))).alias("content"),
        (~failed).alias("validated"),
        F.when(failed, F.array("error")).when(back, F.array(F.lit(FELL_BACK))).otherwise(F.col("found")).alias("warnings"),
        "attempts",
    )


def route(
    pages: DataFrame,
    model: Transcriber | None = None,
    transcripts: DataFrame | None = None,
    repairs: bool = True,
    concurrency: int = 8,
    image: Callable[[dict], bytes] | None = None,
    tasks: int | None = None,
    on_read: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Every page read the cheapest way that passes: ``doc_id, page_number, method, content, validated, warnings, attempts``.

    What the local ways cannot read goes to ``model`` (its picture made by ``image``, in at most ``tasks`` tasks), or takes
    its ``text`` and ``error`` from ``transcripts``. The ways are branches that filter before the costly step, never a
    conditional around it; texts are neither written nor exchanged to be split. ``on_read`` gets the materialised
    answers with their token counts. ``pages`` needs ``repeated_texts``.
    """
    local = local_ways(pages)
    jobs = local.where("way is null")
    if transcripts is not None:
        read = jobs.join(transcripts.select(*PAGE, "text", "error"), PAGE, "left").withColumn("text", F.coalesce("text", F.lit("")))
    else:
        if model is None:
            raise ValueError("a model or transcripts are needed")
        read = materialize(transcribe(jobs.repartition(tasks, *PAGE) if tasks else jobs, model, concurrency=concurrency, image=image))
        if on_read is not None:
            on_read(read.select(*PAGE, "error", "prompt_tokens", "completion_tokens"))
    known = None
    if repairs:
        sound = pages.where(~F.coalesce("garbled", F.lit(False)) & (F.length("raw_text") > 0))
        known = nouns.known_nouns(sound.select("doc_id", F.col("raw_text").alias("text")))
    return accepted(local).unionByName(judged(repaired(read, known, repairs)))


def read_images(pending: DataFrame, model: Transcriber, concurrency: int = 8) -> DataFrame:
    """``doc_id, image_ocr``: a map from placeholder id to text for each document; what failed is marked."""
    read = transcribe(pending, model, IMAGE_PROMPT, concurrency, None)
    text = F.when(F.col("error").isNull(), F.col("text")).otherwise(FAILED_IMAGE)
    return read.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("placeholder_id", text.alias("t")))).alias("image_ocr"))


def with_images(outputs: DataFrame, native: DataFrame, images: DataFrame) -> DataFrame:
    """Native pages with images rendered again with their texts; clean ones replace what the page had.

    ``native``: analysis columns and ``native_markdown`` of the pages that hold placeholders.
    """
    again = native.where(F.contains("native_markdown", F.lit("<!-- IMG_OCR:"))).join(images, "doc_id").withColumn("filled", fill_images(F.col("native_markdown"), F.col("image_ocr")))
    clean = again.where(F.size(_warned(F.col("filled"), "native")) == 0).select(*PAGE, F.concat(page_marker(F.col("page_number"), F.lit("native")), F.lit("\n"), "filled").alias("filled"))
    both = outputs.join(clean, PAGE, "left")
    new = F.col("filled").isNotNull()
    return both.select(*PAGE, F.when(new, "native").otherwise(F.col("method")).alias("method"), F.coalesce("filled", "content").alias("content"), (new | F.col("validated")).alias("validated"), "warnings", "attempts")
