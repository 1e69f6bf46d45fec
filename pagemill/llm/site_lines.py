"""Lines repeated over the documents of one source.

Every line is a node of its source's graph, weighted by the number of reports it stands in; consecutive lines are
edges. Nodes and edges of high support stay, connected components of what is left are the source's boilerplate blocks,
and matching occurrences are deleted block by block. What is excessive is fixed by a node's support, so edges decide
which lines make up one block, not which lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.plans.storage import broadcast_if_small, materialize

#: A line is excessive if it stands in at least so many reports of its source, and in that share of them.
MIN_REPORTS, MIN_SHARE = 3, 0.15

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
#: All white space: Unicode White_Space, the information separators and zero-width blanks.
_BLANKS = r"[\s\x{85}\x{1c}-\x{1f}\p{Z}\x{200b}\x{2060}\x{feff}]+"


def line_form(line: Column) -> Column:
    """What lines are compared by: no white space, ASCII instead of full-width forms, lower case."""
    return F.lower(F.translate(F.regexp_replace(line, _BLANKS, ""), _WIDE, _ASCII))


def _hashed(form: Column) -> Column:
    """128 bits that stand for a form in shuffles; two of 10^12 lines agree by chance with probability below 10^-14."""
    return F.struct(F.xxhash64(form).alias("a"), F.xxhash64(F.lit(7), form).alias("b"))


def numbered_lines(df: DataFrame, lines: Column, *keep: Column) -> DataFrame:
    """One row for each non-empty line: ``keep``, ``line_no`` (from 1), ``rank`` among the non-empty ones, ``a``, ``b``, ``line``."""
    forms = F.transform(lines, lambda l, i: F.struct((i + 1).cast("int").alias("line_no"), l.alias("line"), line_form(l).alias("form")))
    full = F.filter(forms, lambda s: F.length(s["form"]) > 0)
    return (
        df.select(*keep, F.posexplode(full).alias("rank", "s"))
        .select("*", F.col("s.line_no").alias("line_no"), F.col("s.line").alias("line"), _hashed(F.col("s.form")).alias("h"))
        .select("*", "h.*")
        .drop("s", "h")
    )


def all_lines(analysis: DataFrame, manifest: DataFrame) -> DataFrame:
    """Lines of ``analysis.body_text`` and of ``manifest.repeated_texts`` in one form: ``field, record_key, source, doc, line_no, rank, a, b, line``."""
    doc = lambda c: F.xxhash64(c).alias("doc")
    body = numbered_lines(
        analysis.where(F.col("body_text").isNotNull() & F.col("source").isNotNull()),
        F.split("body_text", "\n", -1),
        F.lit("analysis.body_text").alias("field"),
        F.col("page_id").cast("string").alias("record_key"),
        "source",
        doc(F.col("doc_id")),
    )
    listed = numbered_lines(
        manifest.where(F.col("repeated_texts").isNotNull() & F.col("source").isNotNull()),
        F.col("repeated_texts"),
        F.lit("manifest.repeated_texts").alias("field"),
        F.col("doc_id").alias("record_key"),
        "source",
        doc(F.col("doc_id")),
    )
    return body.unionByName(listed)


def high_support(lines: DataFrame, manifest: DataFrame, min_reports: int = MIN_REPORTS, min_share: float = MIN_SHARE) -> DataFrame:
    """Nodes that stay: ``source, a, b, reports``.

    Two aggregations, both combined on the map side: one row for each line and report, then a count for each line. A
    line on every page of a third of the corpus is one row a task and report before anything is shuffled.
    """
    total = manifest.where(F.col("source").isNotNull()).groupBy("source").agg(F.count_distinct("doc_id").alias("n_reports"))
    per_report = lines.groupBy("source", "a", "b", "doc").agg(F.lit(1).alias("one"))
    support = per_report.groupBy("source", "a", "b").agg(F.count("*").alias("reports")).where(F.col("reports") >= min_reports)
    return support.join(total, "source").where(F.col("reports") >= F.lit(min_share) * F.col("n_reports")).select("source", "a", "b", "reports")


def occurrences(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every occurrence of a node. Nodes of a source number at most (lines of a report) / ``min_share``; their count is checked before a broadcast."""
    return lines.join(broadcast_if_small(nodes), ["source", "a", "b"])


def blocks(found: DataFrame, nodes: DataFrame, min_reports: int = MIN_REPORTS) -> DataFrame:
    """Connected components of the graph of nodes and high-support edges: ``source, a, b, block``, the least form of a component's lines.

    An edge joins nodes that follow each other in a record and stays if at least ``min_reports`` reports have it and at
    least half the reports of its rarer end. Components spread the least node label along edges until nothing changes;
    only the graph is shuffled, which is small beside the text.
    """
    w = Window.partitionBy("field", "record_key").orderBy("rank")
    follows = found.select("field", "record_key", "source", "doc", "rank", "a", "b", "reports").withColumn("n", F.lead(F.struct("rank", "a", "b", "reports")).over(w)).where(F.col("n.rank") == F.col("rank") + 1)
    pair = follows.groupBy("source", "a", "b", F.col("n.a").alias("a2"), F.col("n.b").alias("b2"), F.least("reports", F.col("n.reports")).alias("rarer"), "doc").agg(F.lit(1).alias("one"))
    strong = pair.groupBy("source", "a", "b", "a2", "b2", "rarer").agg(F.count("*").alias("support")).where((F.col("support") >= min_reports) & (F.col("support") * 2 >= F.col("rarer")))
    node = lambda a, b: F.concat_ws(":", "source", a, b)
    edges = materialize(strong.select(node("a", "b").alias("u"), node("a2", "b2").alias("v")).where("u <> v").distinct())
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    label = materialize(nodes.select(node("a", "b").alias("u")).distinct().withColumn("block", F.col("u")))
    while True:
        heard = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("block").alias("least"))
        spread = label.join(heard, "u", "left").select("u", F.least("block", "least").alias("block"), (F.col("least") < F.col("block")).alias("changed"))
        # shortcut: a node takes the label its label has, which halves the distance to the least one
        parent = spread.select(F.col("u").alias("block"), F.col("block").alias("above"))
        nxt = materialize(spread.join(parent, "block", "left").select("u", F.least("block", "above").alias("block"), F.coalesce("changed", F.lit(False)).alias("changed")))
        label = nxt.select("u", "block")
        if nxt.where("changed").limit(1).count() == 0:
            break
    form = found.groupBy("source", "a", "b").agg(F.min(line_form(F.col("line"))).alias("form"))
    named = materialize(nodes.withColumn("u", node("a", "b")).join(label, "u").join(form, ["source", "a", "b"]).select("source", "a", "b", "form", F.col("block").alias("u")))
    least = named.groupBy("u").agg(F.min("form").alias("block"))
    return named.join(least, "u").select("source", "a", "b", "block")


def find_repeated(analysis: DataFrame, manifest: DataFrame, min_reports: int = MIN_REPORTS, min_share: float = MIN_SHARE) -> DataFrame:
    """Occurrences of excessively repeated lines: ``field, record_key, source, line_no, line, reports, block``.

    Defined cases: NULL texts, NULL sources and NULL or empty lines have no occurrences; a record that comes twice has
    its occurrences twice, but a report counts once; sources with fewer than ``min_reports`` reports have none; tables
    without rows give none; columns other than the named ones are not read.
    """
    lines = all_lines(analysis, manifest)
    nodes = materialize(high_support(lines, manifest, min_reports, min_share))
    found = materialize(occurrences(lines, nodes))
    return found.join(broadcast_if_small(materialize(blocks(found, nodes, min_reports))), ["source", "a", "b"]).select("field", "record_key", "source", "line_no", "line", "reports", "block")


def repeated_by_source(found: DataFrame) -> DataFrame:
    """The lines of each source: ``source, block, line, reports, occurrences``; ``line`` is the least spelling."""
    return found.groupBy("source", "block", F.xxhash64(line_form(F.col("line"))).alias("h"), "reports").agg(F.min("line").alias("line"), F.count("*").alias("occurrences")).drop("h")


def without_repeated(analysis: DataFrame, found: DataFrame) -> DataFrame:
    """Each page's ``body_text`` without the occurrences in ``found``: ``page_id, body_text, removed``.

    A page that comes twice is given once; a NULL ``body_text`` stays NULL; a page whose lines all go has an empty text.
    """
    pages = analysis.select("page_id", "body_text").dropDuplicates(["page_id"])
    gone = found.where("field = 'analysis.body_text'").groupBy(F.col("record_key").cast("bigint").alias("page_id")).agg(F.collect_set("line_no").alias("gone"))
    numbered = F.transform(F.split("body_text", "\n", -1), lambda l, i: F.struct(l.alias("l"), (i + 1).cast("int").alias("i")))
    kept = F.filter(numbered, lambda s: ~F.array_contains("gone", s["i"]))
    clean = F.array_join(F.transform(kept, lambda s: s["l"]), "\n")
    return pages.join(gone, "page_id", "left").select("page_id", F.when(F.col("gone").isNull(), F.col("body_text")).otherwise(clean).alias("body_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
