"""Tables whose rows run down the page, rebuilt from word coordinates.

Words are counted, matched and gathered by page with plain aggregations and equi-joins; only what a page has few of
(fields, columns) is held in arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.tables import pipe_row

PAGE = ["doc_id", "page_number"]
#: Field names of which one must appear, and the geometry; fixed values.
REQUIRED = ("公司全称", "公司简称", "投资日期", "行业", "总投资成本")
X_MIN, X_MAX, Y_TOL, BUCKET, LEAST_FIELDS = 88.0, 110.0, 20.0, 5, 3


def fields_of(header: Column, y_tol: float = Y_TOL) -> Column:
    """Fields from header words: by falling height, words within ``y_tol`` of a field's first word belong to it: array of (y, name)."""
    start = F.array().cast("array<struct<y:double,name:string>>")

    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["y"].alias("y"), F.concat(last["name"], w["text"]).alias("name"))))
        fresh = F.concat(acc, F.array(F.struct(w["y"].alias("y"), w["text"].alias("name"))))
        return F.when(F.size(acc) == 0, fresh).when(F.abs(w["y"] - last["y"]) > y_tol, fresh).otherwise(joined)

    ordered = F.array_sort(header, lambda a, b: F.when(a["y"] > b["y"], -1).when(a["y"] < b["y"], 1).when(a["no"] < b["no"], -1).when(a["no"] > b["no"], 1).otherwise(0))
    return F.aggregate(ordered, start, step)


def bucket(x: Column) -> Column:
    return (F.bround(x / BUCKET) * BUCKET).cast("int")


def column_centres(data: DataFrame) -> DataFrame:
    """Centres of columns: ``doc_id, page_number, centres`` (sorted).

    They are local maxima of the words' x histogram, counted with map-side combining; of those less than 10 apart the
    higher one stays. Neighbours are exactly one bucket away, so they are looked up by range, not by row.
    """
    hist = data.groupBy(*PAGE, bucket(F.col("x0")).alias("b")).agg(F.count("*").alias("n"))
    page = Window.partitionBy(*PAGE)
    beside = lambda k: F.coalesce(F.max("n").over(page.orderBy("b").rangeBetween(k, k)), F.lit(0))
    hist = hist.select("*", beside(-BUCKET).alias("left"), beside(BUCKET).alias("right"), F.greatest(F.lit(8), F.floor(F.sum("n").over(page) / 80)).alias("least"))
    peaks = hist.where("n >= least and n >= left and n >= right").groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("p"))
    start = F.array().cast("array<struct<b:int,n:bigint>>")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        swapped = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(p))
        return F.when(F.size(acc) == 0, F.array(p)).when(p["b"] - last["b"] >= 10, F.concat(acc, F.array(p))).when(p["n"] > last["n"], swapped).otherwise(acc)

    return peaks.select(*PAGE, F.transform(F.aggregate("p", start, step), lambda p: p["b"].cast("double")).alias("centres"))


def _nearest(values: Column, at: Column) -> Column:
    """0-based place of the value nearest to ``at``, the first on a tie."""
    distances = F.transform(values, lambda v: F.abs(v - at))
    return F.array_position(distances, F.array_min(distances)).cast("int") - 1


def rebuild(words: DataFrame, x_min: float = X_MIN, x_max: float = X_MAX, y_tol: float = Y_TOL) -> DataFrame:
    """``doc_id, page_number, markdown`` of the pages that hold such a table; others have no row.

    ``words``: ``doc_id, page_number, word_no, x0, y0, text``. Words meet the fields and centres of their page in an
    equi-join on the page; cells are gathered by page, column and field.
    """
    known = words.where((F.col("x0") >= x_min) & F.col("text").isNotNull())
    data = known.where(F.col("x0") >= x_max).select(*PAGE, "word_no", F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"), "text")
    word = F.struct(F.col("word_no").alias("no"), F.col("y0").cast("double").alias("y"), "text")
    header = known.where(F.col("x0") < x_max).groupBy(*PAGE).agg(F.sort_array(F.collect_list(word)).alias("header"))
    told = F.array_join(F.transform("header", lambda w: w["text"]), "")
    fields = header.where(told.rlike("|".join(REQUIRED))).select(*PAGE, F.explode(F.array(fields_of(F.col("header"), y_tol))).alias("fields")).where(F.size("fields") >= LEAST_FIELDS)
    pages = fields.join(column_centres(data), PAGE)
    near = data.join(pages, PAGE)
    first = near.where(F.abs(F.col("y0") - F.col("fields")[0]["y"]) <= y_tol * 1.5).select(*PAGE).distinct()
    ys = F.transform("fields", lambda f: f["y"])
    placed = near.select(*PAGE, "word_no", "text", "y0", _nearest(F.col("centres"), F.col("x0")).alias("c"), _nearest(ys, F.col("y0")).alias("f"), "fields")
    placed = placed.where(F.abs(F.get("fields", F.col("f"))["y"] - F.col("y0")) <= y_tol * 3).join(first, PAGE, "left_semi")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"])
    cells = placed.groupBy(*PAGE, "c", "f").agg(F.array_join(texts, " ").alias("t"))
    rows = cells.groupBy(*PAGE, "c").agg(F.map_from_entries(F.collect_list(F.struct("f", "t"))).alias("cells"))
    full = rows.join(fields, PAGE).select(*PAGE, "c", "fields", pipe_row(F.transform("fields", lambda _, i: F.coalesce(F.try_element_at(F.col("cells"), i), F.lit("")))).alias("row"))
    body = full.groupBy(*PAGE).agg(F.any_value("fields").alias("fields"), F.sort_array(F.collect_list(F.struct("c", "row"))).alias("rows"))
    names = pipe_row(F.transform("fields", lambda f: f["name"]))
    rule = pipe_row(F.array_repeat(F.lit("---"), F.size("fields")))
    return body.select(*PAGE, F.array_join(F.concat(F.array(names, rule), F.transform("rows", lambda r: r["row"])), "\n").alias("markdown"))
