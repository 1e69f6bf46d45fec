"""The query catalogue of the document operators and the SQL that checks it.

Every query runs over whole tables. Inputs the tables lack (spans, words, cells) are derived from ``lineitem``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import quality as Q
from pagemill.functions import tables as TB
from pagemill.functions import text as TX
from pagemill.operators import coords, correct, cost, layout, merge, nouns, repeats, repetition
from pagemill.operators.line_tables import align_pipe_tables, plain_tables
from pagemill.plans.pipeline import route
from pagemill.plans.storage import materialize, read_table
from pagemill.sources.documents import unfinished

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# Shared inputs -------------------------------------------------------------------------------------------------------

BLANK = r"[\s\p{Z}\x{0b}\x{85}]"
LIKE_GLYPHS = Q.BROKEN_GLYPHS
FIGURES_SQL = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐]"
HAN_SQL = r"[\x{4e00}-\x{9fff}]"
MARKER_SQL = r"<!-- page:\d+(?: method:[\p{L}\p{N}_-]+)? -->\n?"


def _s(x: str) -> str:
    """SQL for trimming all white space."""
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _unmarked(x: str) -> str:
    return f"regexp_replace({x}, '{MARKER_SQL}', '', 'g')"


def _glyphs(x: str) -> str:
    return f"(length({x}) - length(translate({x}, '{LIKE_GLYPHS}', '')))"


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pages, each once; of a page that comes twice the one written last."""
    return merge.latest(read_table(spark, d, "pages"), ["page_id"], "written_at")


def analysis_rows(spark: SparkSession, d: str) -> DataFrame:
    return merge.latest(read_table(spark, d, "analysis"), ["page_id"], "analyzed_at")


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    return merge.latest(read_table(spark, d, "manifest"), ["doc_id"], "received_at")


_LATEST = """latest_pages as (select * from pages qualify row_number() over (partition by page_id order by written_at desc nulls last) = 1),
latest_analysis as (select * from analysis qualify row_number() over (partition by page_id order by analyzed_at desc nulls last) = 1),
latest_manifest as (select * from manifest qualify row_number() over (partition by doc_id order by received_at desc nulls last) = 1)"""

#: Lines in an order that is unique: line items of an order.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_LINES = """lines as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos from lineitem)"""


# Scalar functions ----------------------------------------------------------------------------------------------------


@_query(f"select distinct page_id, {_unmarked('markdown')} as body, printf('<!-- page:%d method:%s -->', page_number, coalesce(method, 'native')) as marker, printf('%03d.md', page_number) as file_name, printf('page-%03d.native.md', page_number) as debug_name, printf('page-%03d-full.png', page_number) as image_name from pages where markdown is not null")
def page_marker_roundtrip(spark, d):
    n = F.col("page_number")
    method = F.coalesce("method", F.lit("native"))
    return (
        read_table(spark, d, "pages")
        .where("markdown is not null")
        .select("page_id", TX.strip_markers("markdown").alias("body"), TX.page_marker(n, method).alias("marker"), TX.page_file(n).alias("file_name"), TX.debug_name(n, F.lit("native.md")).alias("debug_name"), TX.page_image_name(n).alias("image_name"))
        .distinct()
    )


_GARBLED = f"""
texts as (select distinct page_id, coalesce(raw_text, '') as t from analysis),
chars as (select page_id, c, count(*) as n from (select page_id, unnest(regexp_extract_all(t, '{HAN_SQL}')) as c from texts) group by 1, 2),
top as (select page_id, sum(n) as top8 from (select *, row_number() over (partition by page_id order by n desc) as r from chars) where r <= 8 group by 1),
han_total as (select page_id, sum(n) as han from chars group by 1),
judged as (select t.page_id, t.t, coalesce(top8, 0) as top8, coalesce(han, 0) as han, {_glyphs('t.t')} as glyphs, length(t.t) - length(regexp_replace(t.t, '{FIGURES_SQL}', '', 'g')) as figures from texts t left join top using (page_id) left join han_total using (page_id)),
garbled as (select page_id, t, glyphs, case when length(t) < 30 then false when glyphs >= 5 then true when han < 10 then false else top8 / greatest(han, 1) > 0.4 and figures / greatest(length(t), 1) < 0.02 end as garbled from judged)
"""


@_query(f"with {_GARBLED} select page_id, garbled, cast(glyphs as bigint) as glyphs from garbled")
def garble_detect(spark, d):
    t = F.coalesce("raw_text", F.lit(""))
    return read_table(spark, d, "analysis").select("page_id", Q.is_garbled("raw_text").alias("garbled"), big(Q.broken_glyphs(t)).alias("glyphs")).distinct()


@_query(f"with {_GARBLED} select page_id, cast(length(t) as bigint) as size, length(t) >= 30 and not garbled as candidate from garbled")
def native_candidates(spark, d):
    return read_table(spark, d, "analysis").select("page_id", big(F.length(F.coalesce("raw_text", F.lit("")))).alias("size"), Q.native_candidate("raw_text").alias("candidate")).distinct()


def _conversion_sql(source: str, result: str) -> str:
    n, m = f"length({_s(_unmarked(source))})", f"length({_s(result)})"
    return f"list_filter([case when {n} > 200 and {m} < {n} * 0.3 then printf('输出长度(%d)不足源文本(%d)的30%%，可能有大量内容丢失', {m}, {n}) end, case when {_glyphs(result)} > 5 then printf('输出中检测到 %d 个疑似乱码字符', {_glyphs(result)}) end], lambda w: w is not null)"


@_query(f"""with both_texts as (select distinct a.page_id, coalesce(a.raw_text, '') as s, coalesce(p.markdown, '') as r from analysis a join pages p using (page_id))
select distinct page_id, array_to_string({_conversion_sql('s', 'r')}, ';') as warnings from both_texts""")
def validate_conversion(spark, d):
    texts = read_table(spark, d, "analysis").select("page_id", F.coalesce("raw_text", F.lit("")).alias("s")).join(read_table(spark, d, "pages").select("page_id", F.coalesce("markdown", F.lit("")).alias("r")), "page_id")
    return texts.select("page_id", F.array_join(Q.conversion_warnings(F.col("s"), F.col("r")), ";").alias("warnings")).distinct()


def _page_warnings_sql(markdown: str, method: str, tables: str, body: str, raw: str) -> str:
    b = f"{_s(_unmarked(f"coalesce({markdown}, '')"))}"
    lines = f"list_filter(list_transform(string_split({b}, chr(10)), lambda l: {_s('l')}), lambda l: l <> '')"
    short = f"not contains({b}, '|') and len({lines}) > 8 and len(list_filter({lines}, lambda l: length(l) <= 15)) / greatest(len({lines}), 1) > 0.6"
    native = f"case when {method} = 'native' then list_filter([case when coalesce({tables}, false) and regexp_matches({b}, '<tbody>\\s*</tbody>', 's') then '{Q.EMPTY_TABLE}' end, case when {short} then '{Q.SHORT_LINES}' end], lambda w: w is not null) else [] end"
    source = f"coalesce(nullif({body}, ''), {raw}, '')"
    return f"case when {b} = '' then ['{Q.EMPTY_OUTPUT}'] else list_concat({native}, case when {source} = '' then [] else {_conversion_sql(source, b)} end) end"


@_query(f"""with src as (select distinct p.page_id, p.markdown, p.method, a.has_tables, a.body_text, a.raw_text from pages p join analysis a using (page_id)),
w as (select page_id, {_page_warnings_sql('markdown', "coalesce(method, '')", 'has_tables', 'body_text', 'raw_text')} as w, raw_text from src)
select distinct page_id, array_to_string(w, ';') as warnings, len(list_filter(w, lambda x: regexp_matches(x, '短行|表格'))) > 0 as coordinates, len(list_filter(w, lambda x: contains(x, '不足源文本'))) > 0 and length(coalesce(raw_text, '')) > 500 as fallback from w""")
def validate_page(spark, d):
    src = read_table(spark, d, "pages").select("page_id", "markdown", "method").join(read_table(spark, d, "analysis").select("page_id", "has_tables", "body_text", "raw_text"), "page_id")
    w = src.withColumn("w", Q.page_warnings(F.col("markdown"), F.coalesce("method", F.lit("")), F.col("has_tables"), F.col("body_text"), F.col("raw_text")))
    return w.select("page_id", F.array_join("w", ";").alias("warnings"), Q.wants_coordinates(F.col("w")).alias("coordinates"), Q.wants_fallback(F.col("w"), F.col("raw_text")).alias("fallback")).distinct()


@_query(f"select distinct page_id, array_to_string(regexp_extract_all(coalesce(raw_text, ''), '{HAN_SQL}{{3,}}'), ';') as phrases, cast(length(regexp_replace(coalesce(raw_text, ''), '[^\\p{{L}}]', '', 'g')) as bigint) as letters from analysis")
def phrases(spark, d):
    t = F.coalesce("raw_text", F.lit(""))
    return read_table(spark, d, "analysis").select("page_id", F.array_join(TX.phrases(t, 3), ";").alias("phrases"), big(TX.letters(t)).alias("letters")).distinct()


@_query("""select cast(o_orderkey as bigint) as o_orderkey, regexp_replace(concat('（', substr(cast(year(o_orderdate) as varchar), 1, 3), ' 年 ', month(o_orderdate), ' 月）于', substr(cast(year(o_orderdate) as varchar), 1, 3), ' 年 5 月'), '(^|[^\\p{L}\\p{N}_])(20[012])\\s+年\\s+(\\d+\\s+月)', '\\1\\2? 年 \\3', 'g') as fixed from orders""")
def truncated_years(spark, d):
    cut = F.substring(F.year("o_orderdate").cast("string"), 1, 3)
    t = F.concat(F.lit("（"), cut, F.lit(" 年 "), F.month("o_orderdate").cast("string"), F.lit(" 月）于"), cut, F.lit(" 年 5 月"))
    return read_table(spark, d, "orders").select(big("o_orderkey").alias("o_orderkey"), TX.mark_cut_years(t).alias("fixed"))


@_query("""with src as (select distinct page_id, concat(coalesce(markdown, ''), ' ![a](assets/', page_file, ') ![](', doc_id, '/x.png)') as t from pages)
select page_id, array_to_string(regexp_extract_all(t, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1), ';') as refs from src""")
def asset_refs(spark, d):
    t = F.concat(F.coalesce("markdown", F.lit("")), F.lit(" ![a](assets/"), "page_file", F.lit(") ![]("), "doc_id", F.lit("/x.png)"))
    return read_table(spark, d, "pages").select("page_id", F.array_join(TX.asset_refs(t), ";").alias("refs")).distinct()


@_query(f"""with {_LATEST}, src as (select page_id, concat(coalesce(markdown, ''), ' <!-- IMG_OCR:xref-', page_id % 500, ' -->') as t, coalesce(m.image_ocr, map()) as ocr from latest_pages p left join latest_manifest m using (doc_id))
select page_id, list_reduce(list_transform(list_sort(map_keys(ocr)), lambda k: {{'k': k, 'v': coalesce(ocr[k], '[图片识别失败]')}}), lambda acc, e: {{'k': '', 'v': replace(acc.v, concat('<!-- IMG_OCR:', e.k, ' -->'), e.v)}}, {{'k': '', 'v': t}}).v as filled from src""")
def image_placeholder_fill(spark, d):
    t = F.concat(F.coalesce("markdown", F.lit("")), F.lit(" "), TX.image_placeholder(F.col("page_id") % 500))
    ocr = manifest_rows(spark, d).select("doc_id", "image_ocr")
    filled = TX.fill_images(t, F.coalesce("image_ocr", F.create_map().cast("map<string,string>")))
    return page_rows(spark, d).join(ocr, "doc_id", "left").select("page_id", filled.alias("filled"))


@_query("""select cast(p_partkey as bigint) as p_partkey, cast(case when p_size / 22.0 >= 1.8 then 1 when p_size / 22.0 >= 1.4 then 2 when p_size / 22.0 >= 1.15 then 3 else 0 end as bigint) as level from part""")
def heading_levels(spark, d):
    return read_table(spark, d, "part").select(big("p_partkey").alias("p_partkey"), big(TB.heading_level(F.col("p_size"), F.lit(22.0))).alias("level"))


@_query("select vec_id, cast(label as bigint) as label, concat('data:image/png;base64,', to_base64(encode(cast(vec_id as varchar) || repeat('x', 120)))) as url, encode(cast(vec_id as varchar) || repeat('x', 120)) = from_base64(to_base64(encode(cast(vec_id as varchar) || repeat('x', 120)))) as same from embeddings")
def data_urls(spark, d):
    image = F.encode(F.concat(F.col("vec_id").cast("string"), F.repeat(F.lit("x"), F.lit(120))), "utf-8")
    url = TX.data_url(image)
    return read_table(spark, d, "embeddings").select("vec_id", big("label").alias("label"), url.alias("url"), (TX.data_url_bytes(url) == image).alias("same"))


# Tables --------------------------------------------------------------------------------------------------------------


def order_cells(spark: SparkSession, d: str) -> DataFrame:
    """A table for each order: ragged and sparse ones among them."""
    q = F.col("l_quantity").cast("bigint").cast("string")
    row = F.when(F.col("l_partkey") % 17 == 0, F.array(F.col("l_linestatus"), q)).otherwise(F.array(F.concat(F.lit(" "), "l_returnflag", F.lit("\n"), "l_linestatus"), F.when(F.col("l_tax") > 0.03, q), F.col("l_suppkey").cast("string")))
    items = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_ORDER, row.alias("r")))).alias("rows"))
    return items.select("l_orderkey", F.transform("rows", lambda r: r["r"]).alias("cells"))


_CELLS = f"""{_LINES}, rows as (select l_orderkey, pos, case when l_partkey % 17 = 0 then [l_linestatus, cast(cast(l_quantity as bigint) as varchar)] else [concat(' ', l_returnflag, chr(10), l_linestatus), case when l_tax > 0.03 then cast(cast(l_quantity as bigint) as varchar) end, cast(l_suppkey as varchar)] end as r from lines),
tables as (select l_orderkey, list(list_transform(r, lambda c: replace({_s("coalesce(c, '')")}, chr(10), '<br>')) order by pos) as t from rows group by 1),
shape as (select *, list_max(list_transform(t, lambda r: len(r))) as w, len(t) as n, len(flatten(t)) as total, len(list_filter(flatten(t), lambda c: c = '')) as empty, len(list_distinct(list_transform(t, lambda r: len(r)))) as kinds from tables),
pad as (select *, list_transform(t, lambda r: list_concat(r, list_transform(range(w - len(r)), lambda i: ''))) as p from shape)"""


@_query(f"""with {_CELLS} select l_orderkey, case when empty / total >= 0.3 or kinds > 1 or n <= 1 then array_to_string(list_concat(['<table>', '  <thead>', '    <tr>'], list_transform(p[1], lambda c: concat('      <th>', c, '</th>')), ['    </tr>', '  </thead>', '  <tbody>'], flatten(list_transform(p[2:], lambda r: list_concat(['    <tr>'], list_transform(r, lambda c: concat('      <td>', c, '</td>')), ['    </tr>']))), ['  </tbody>', '</table>']), chr(10))
else array_to_string(list_concat([concat('| ', array_to_string(p[1], ' | '), ' |'), concat('| ', array_to_string(list_transform(range(w), lambda i: '---'), ' | '), ' |')], list_transform(p[2:], lambda r: concat('| ', array_to_string(r, ' | '), ' |'))), chr(10)) end as markup from pad""")
def table_markup(spark, d):
    return order_cells(spark, d).select("l_orderkey", TB.table_markup(F.col("cells")).alias("markup"))


_CELL_LINES = f"""with src as (select distinct page_id, coalesce(raw_text, '') as t from analysis),
line as (select page_id, unnest(string_split(t, chr(10))) as l, generate_subscripts(string_split(t, chr(10)), 1) as line_no from src),
cut as (select page_id, line_no, l, case when contains(l, chr(9)) then list_transform(string_split(l, chr(9)), lambda c: {_s('c')}) else list_filter(list_transform(string_split_regex({_s('l')}, '[ \\x{{3000}}]{{2,}}'), lambda c: {_s('c')}), lambda c: c <> '') end as cells from line)"""
_CELL_LIKE = r"(regexp_matches(c, '^-?[\p{Nd},]+\.?\p{Nd}*%?$') or regexp_matches(c, '(?i)^[\p{Nd}.]+x$') or regexp_matches(c, '^[\x{4e00}-\x{9fff}/（）\p{L}\p{M}\p{Nd}\p{Pc}]{1,10}$') or regexp_matches(c, '(?i)^(?:yoy|Q[1-4]|YTD|\p{Nd}{4}[EeYy]?)$'))"


@_query(f"{_CELL_LINES} select page_id, cast(line_no as bigint) as line_no, array_to_string(cells, '¦') as cells, cast(len(list_filter(cells, lambda c: c <> '' and {_CELL_LIKE})) as bigint) as like_cells from cut where len(cells) >= 2")
def split_cells(spark, d):
    src = read_table(spark, d, "analysis").select("page_id", F.coalesce("raw_text", F.lit("")).alias("t")).distinct()
    line = src.select("page_id", F.posexplode(F.split("t", "\n", -1)).alias("i", "l")).withColumn("c", TB.line_cells(F.col("l"))).where(F.size("c") >= 2)
    return line.select("page_id", big(F.col("i") + 1).alias("line_no"), F.array_join("c", "¦").alias("cells"), big(F.size(F.filter("c", TB.is_cell_like))).alias("like_cells"))


@_query(f"""{_CELL_LINES},
kind as (select *, len(cells) >= 2 and len(list_filter(cells, lambda c: c <> '' and {_CELL_LIKE})) >= len(cells) * 0.5 as is_row, {_s('l')} = '' as is_blank from cut),
class as (select *, (is_row or is_blank) as inside, (is_row or is_blank) and len(cells) >= 3 and not regexp_matches({_s('l')}, '^(\\||<|!\\[|#)') as starts from kind),
run as (select *, sum(case when inside then 0 else 1 end) over (partition by page_id order by line_no) as run_no from class),
began as (select *, min(case when starts then line_no end) over (partition by page_id, run_no) as first_no from run),
block as (select *, coalesce(inside and line_no >= first_no, false) as in_block from began),
counted as (select *, sum(case when in_block and is_row then 1 else 0 end) over (partition by page_id, run_no) as n_rows, max(case when in_block and is_row then len(cells) end) over (partition by page_id, run_no) as w, row_number() over (partition by page_id, run_no, in_block, is_row order by line_no) as k from block),
shown as (select page_id, line_no, case when not in_block or n_rows < 3 then l when not is_row then null
  else concat('| ', array_to_string(list_concat(cells, list_transform(range(w - len(cells)), lambda i: '')), ' | '), ' |', case when k = 1 then concat(chr(10), '| ', array_to_string(list_transform(range(w), lambda i: '---'), ' | '), ' |') else '' end) end as o from counted)
select page_id, string_agg(o, chr(10) order by line_no) as fixed from shown where o is not null group by 1""")
def plain_table_fix(spark, d):
    return analysis_rows(spark, d).select("page_id", plain_tables(F.coalesce("raw_text", F.lit(""))).alias("fixed"))


_RULE = r"^[\s\p{Z}\x{0b}\x{85}]*\|[\s\p{Z}\x{0b}\x{85}\-:|]+\|"


@_query(f"""with src as (select distinct page_id, replace(coalesce(markdown, ''), ' |  | ', ' | ') as t from pages),
line as (select page_id, unnest(string_split(t, chr(10))) as l, generate_subscripts(string_split(t, chr(10)), 1) as line_no from src),
seen as (select *, starts_with({_s('l')}, '|') as pipe, coalesce(regexp_matches(lead(l) over (partition by page_id order by line_no), '{_RULE}'), false) as before_rule from line),
run as (select *, sum(case when pipe then 0 else 1 end) over (partition by page_id order by line_no) as run_no from seen),
began as (select *, min(case when pipe and before_rule then line_no end) over (partition by page_id, run_no) as first_no from run),
block as (select *, coalesce(pipe and line_no >= first_no, false) as in_block, string_split(regexp_replace({_s('l')}, '^\\|+|\\|+$', '', 'g'), '|') as cells from began),
wide as (select *, max(case when in_block then len(cells) end) over (partition by page_id, run_no) as w from block)
select page_id, string_agg(case when not in_block then l when line_no = first_no + 1 and regexp_matches(l, '{_RULE}') then concat('| ', array_to_string(list_transform(range(w), lambda i: '---'), ' | '), ' |')
  else concat('| ', array_to_string(list_transform(list_concat(cells, list_transform(range(w - len(cells)), lambda i: '')), lambda c: {_s('c')}), ' | '), ' |') end, chr(10) order by line_no) as fixed from wide group by 1""")
def pipe_table_align(spark, d):
    t = F.replace(F.coalesce("markdown", F.lit("")), F.lit(" |  | "), F.lit(" | "))
    return page_rows(spark, d).select("page_id", align_pipe_tables(t).alias("fixed"))


@_query(f"""with src as (select distinct page_id, coalesce(raw_text, '') as t from analysis),
parts as (select page_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda l: {_s('l')}), lambda l: l <> '') as ls from src),
cell as (select page_id, t, case when page_id % 3 = 0 then list_reverse(ls) else ls end as c from parts),
place as (select page_id, list_filter(list_transform(c, lambda l: instr(t, l) - 1), lambda p: p >= 0) as p from cell)
select page_id, len(list_filter(range(1, len(p)), lambda i: p[i + 1] < p[i])) = 0 as reliable from place""")
def cell_order_reliable(spark, d):
    t = F.coalesce("raw_text", F.lit(""))
    lines = F.filter(F.transform(F.split(t, "\n", -1), TX.strip_u), lambda l: F.length(l) > 0)
    cell = F.array_join(F.when(F.col("page_id") % 3 == 0, F.reverse(lines)).otherwise(lines), "\n")
    return read_table(spark, d, "analysis").select("page_id", TB.order_is_reliable(t, F.array(F.array(cell))).alias("reliable")).distinct()


# Layout --------------------------------------------------------------------------------------------------------------


def order_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages, gathered once: ``l_orderkey, spans, tables, images``.

    A line item is a block of two spans, its size from the quantity, bold where the tax is high; a returned one has a
    table over its height, a new one an image at its top.
    """
    item = F.struct(*LINE_ORDER, "l_returnflag", "l_linestatus", "l_quantity", "l_tax")
    rows = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("r"))
    top = lambda x: x["l_linenumber"] * 20.0

    def span(x, i, k, text):
        return F.struct((i + 1).alias("block_no"), F.lit(1).alias("line_no"), F.lit(k).alias("span_no"), text.alias("text"), (x["l_quantity"] / 2).alias("size"), F.when(x["l_tax"] > 0.04, 16).otherwise(0).alias("flags"), top(x).alias("y0"), (top(x) + 12).alias("y1"))

    two = lambda x, i: F.array(span(x, i, 1, F.concat(x["l_returnflag"], F.lit("# "))), span(x, i, 2, F.concat(x["l_linestatus"], F.lit(" "), x["l_partkey"].cast("string"), F.lit("  "))))
    table = lambda x, i: F.when(x["l_returnflag"] == "R", F.struct((i + 1).alias("table_no"), (top(x) + 1).alias("y0"), (top(x) + 9).alias("y1"), F.concat(F.lit("<table>"), (i + 1).cast("string"), F.lit("</table>")).alias("content")))
    image = lambda x, i: F.when(x["l_returnflag"] == "N", F.struct(x["l_partkey"].alias("xref"), (i + 1).alias("rect_no"), top(x).alias("y0")))
    there = lambda f: F.filter(F.transform("r", f), lambda x: x.isNotNull())
    return rows.select("l_orderkey", F.flatten(F.transform("r", two)).alias("spans"), there(table).alias("tables"), there(image).alias("images"))


_SPANS = f"""{_LINES}, spans as (select l_orderkey, pos, k, case k when 1 then concat(l_returnflag, '# ') else concat(l_linestatus, ' ', l_partkey, '  ') end as text, l_quantity / 2 as size, case when l_tax > 0.04 then 16 else 0 end as flags, l_linenumber * 20.0 as y0, l_linenumber * 20.0 + 12 as y1 from lines cross join (values (1), (2)) v(k)),
sized as (select l_orderkey, round_even(size, 1) as s, sum(length({_s('text')})) as w, min(pos * 10 + k) as first from spans group by 1, 2),
body as (select l_orderkey, s as body_size from sized qualify row_number() over (partition by l_orderkey order by w desc, first) = 1)"""


@_query(f"with {_SPANS} select l_orderkey, round(body_size, 1) as body_size from body")
def body_font_size(spark, d):
    size = layout.body_size(layout.ordered_spans("spans"))
    return order_pages(spark, d).select("l_orderkey", F.round(size, 1).alias("body_size"))


_OUT = f"""{_SPANS}, rects as (select l_orderkey, pos, l_linenumber * 20.0 + 1 as y0, l_linenumber * 20.0 + 9 as y1 from lines where l_returnflag = 'R'),
blocks as (select distinct l_orderkey, pos, y0, y1 from spans),
outside as (select * from blocks b where not exists (select 1 from rects r where r.l_orderkey = b.l_orderkey and (b.y0 + b.y1) / 2 between r.y0 - 2 and r.y1 + 2))"""


@_query(f"with {_OUT} select l_orderkey, cast(pos as bigint) as block_no from outside")
def blocks_outside_tables(spark, d):
    blocks = layout.let(layout.ordered_spans("spans"), layout.blocks_of)
    outside = F.filter(blocks, lambda b: layout.is_outside(b["y0"], b["y1"], F.col("tables")))
    return order_pages(spark, d).select("l_orderkey", F.explode(F.transform(outside, lambda b: b["block_no"])).alias("block_no")).select("l_orderkey", big("block_no").alias("block_no"))


@_query(f"""with {_OUT},
level as (select s.*, case when size / body_size >= 1.8 then 1 when size / body_size >= 1.4 then 2 when size / body_size >= 1.15 then 3 else 0 end as lv from spans s join body using (l_orderkey)),
line as (select l_orderkey, pos, max(lv) as lv, regexp_replace(string_agg(case when flags = 16 and lv = 0 then concat('**', text, '**') else text end, '' order by k), '{BLANK}+$', '') as t from level group by 1, 2),
texts as (select l_orderkey, pos, case when lv > 0 then concat(repeat('#', lv), ' ', regexp_replace(t, '^[# ]+', '')) else t end as t from line),
fragments as (select o.l_orderkey, o.y0, 2 as kind, o.pos, t from outside o join texts using (l_orderkey, pos) union all select l_orderkey, y0, 0, pos, concat('<table>', pos, '</table>') from rects
  union all select l_orderkey, l_linenumber * 20.0, 1, pos, concat('<!-- IMG_OCR:xref-', l_partkey, ' -->') from lines where l_returnflag = 'N')
select o_orderkey as l_orderkey, coalesce(string_agg(t, chr(10) || chr(10) order by y0, kind, pos), '[空白页]') as markdown from orders left join fragments on o_orderkey = l_orderkey group by 1""")
def page_layout_markdown(spark, d):
    pages = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return pages.join(order_pages(spark, d), "l_orderkey", "left").select("l_orderkey", layout.page_markdown("spans", F.col("tables"), F.col("images")).alias("markdown"))


# Repeated texts ------------------------------------------------------------------------------------------------------


def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each page as blocks of height 1."""
    lines = F.split("raw_text", "\n", -1)
    return analysis_rows(spark, d).where("length(raw_text) > 0").select("doc_id", "page_number", F.size(lines).alias("page_height"), F.posexplode(lines).alias("y0", "text")).withColumn("y1", F.col("y0") + 1)


_REPEATS = f"""{_LATEST}, line as (select doc_id, page_number, len(string_split(raw_text, chr(10))) as h, unnest(string_split(raw_text, chr(10))) as l, generate_subscripts(string_split(raw_text, chr(10)), 1) - 0.5 as mid from latest_analysis where length(raw_text) > 0),
zone as (select doc_id, page_number, {_s('l')} as text, h, mid from line),
once as (select distinct doc_id, page_number, text, 'header' as zone from zone where mid <= h * 0.15 and length(text) > 1 union select distinct doc_id, page_number, text, 'footer' from zone where mid >= h * 0.90 and length(text) > 1),
total as (select doc_id, count(distinct page_number) as n from line group by 1 having count(distinct page_number) >= 3),
repeated as (select doc_id, text, zone, count(*) as pages, n from once join total using (doc_id) group by 1, 2, 3, n having count(*) / n >= 0.5)"""


@_query(f"with {_REPEATS} select doc_id, text, zone, cast(pages as bigint) as pages from repeated")
def repeated_lines(spark, d):
    return repeats.repeated_texts(line_blocks(spark, d)).select("doc_id", "text", "zone", big("pages").alias("pages"))


@_query(f"with {_REPEATS} select doc_id, array_to_string(list_sort(list(distinct text)), ';') as texts from repeated group by 1")
def repeated_by_document(spark, d):
    return repeats.repeated_by_document(repeats.repeated_texts(line_blocks(spark, d))).select("doc_id", F.array_join("repeated_texts", ";").alias("texts"))


def _listed_sql(fold: str, start: str) -> str:
    return f"list_reduce(list_transform(list_sort(list_transform(list_filter(coalesce(m.repeated_texts, []), lambda r: r <> ''), lambda r: {{'n': -length(r), 'r': r}})), lambda x: x.r), lambda acc, r: {fold}, {start})"


@_query(f"""with {_LATEST} select page_id, {_s(_listed_sql("replace(acc, r, '')", "coalesce(raw_text, '')"))} as body from latest_analysis a left join latest_manifest m using (doc_id)""")
def strip_repeated(spark, d):
    listed = manifest_rows(spark, d).select("doc_id", "repeated_texts")
    return analysis_rows(spark, d).join(listed, "doc_id", "left").select("page_id", TX.strip_listed(F.coalesce("raw_text", F.lit("")), F.col("repeated_texts")).alias("body"))


@_query(f"""with {_LATEST} select page_id, {_listed_sql("case when not contains(acc, r) and contains(coalesce(a.raw_text, ''), r) then concat(r, chr(10), chr(10), acc) else acc end", "coalesce(p.markdown, '')")} as text from latest_pages p join latest_analysis a using (page_id) left join latest_manifest m on m.doc_id = p.doc_id""")
def header_reinsert(spark, d):
    listed = manifest_rows(spark, d).select("doc_id", "repeated_texts")
    raw = analysis_rows(spark, d).select("page_id", "raw_text")
    return page_rows(spark, d).join(raw, "page_id").join(listed, "doc_id", "left").select("page_id", TX.reinsert_listed(F.coalesce("markdown", F.lit("")), F.coalesce("raw_text", F.lit("")), F.col("repeated_texts")).alias("text"))


@_query(f"""with {_GARBLED}, {_REPEATS},
page as (select page_id, a.doc_id, a.page_number, {_s("coalesce(a.raw_text, '')")} as raw, a.table_count, a.image_blocks, g.garbled from latest_analysis a join (select page_id, bool_or(garbled) as garbled from garbled group by 1) g using (page_id)),
m as (select doc_id, list(distinct text) as repeated_texts from repeated group by 1)
select page_id, cast(length(raw) as bigint) as raw_text_length, {_s(_listed_sql("replace(acc, r, '')", "raw"))} as body_text, raw <> '' as has_native_text, coalesce(table_count, 0) > 0 as has_tables, coalesce(image_blocks, 0) > 0 as has_images, length(raw) >= 30 and not garbled as native_candidate, garbled from page left join m using (doc_id)""")
def page_analysis(spark, d):
    rows = analysis_rows(spark, d)
    repeated = repeats.repeated_by_document(repeats.repeated_texts(line_blocks(spark, d)))
    out = repeats.analyse_pages(rows.select("doc_id", "page_number", "raw_text", "table_count", "image_blocks"), repeated)
    ids = rows.select("doc_id", "page_number", "page_id")
    return out.join(ids, ["doc_id", "page_number"]).select("page_id", big("raw_text_length").alias("raw_text_length"), "body_text", "has_native_text", "has_tables", "has_images", "native_candidate", "garbled")


# Coordinates ---------------------------------------------------------------------------------------------------------


def supplier_words(spark: SparkSession, d: str) -> DataFrame:
    """A page of words for each supplier: five field names of two words at the left, line items in columns to their right."""
    from pyspark.sql import Window

    items = read_table(spark, d, "lineitem").withColumn("word_no", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", *LINE_ORDER)))
    column = F.col("l_partkey") % 9
    data = items.select(F.lit("doc").alias("doc_id"), F.col("l_suppkey").alias("page_number"), "word_no", (110 + column * 20 + F.col("l_orderkey") % 3 + F.when(F.col("l_partkey") % 23 == 0, 7).otherwise(0)).cast("double").alias("x0"), (500 - 100 * (F.col("l_linenumber") % 5) + F.col("l_orderkey") % 90 - 30).cast("double").alias("y0"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    names = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(coords.REQUIRED)))
    # each name in two words, the second a little lower
    half = lambda f, k: F.struct((-10 + 2 * f["i"] + k).alias("word_no"), (500.0 - 100 * f["i"] - 6 * k).alias("y0"), (F.substring(f["n"], 3, 9) if k else F.substring(f["n"], 1, 2)).alias("text"))
    halves = F.flatten(F.transform(names, lambda f: F.array(half(f, 0), half(f, 1))))
    fields = read_table(spark, d, "supplier").select(F.lit("doc").alias("doc_id"), F.col("s_suppkey").alias("page_number"), F.explode(halves).alias("f")).select("doc_id", "page_number", F.col("f.word_no").alias("word_no"), F.lit(90.0).alias("x0"), F.col("f.y0").alias("y0"), F.col("f.text").alias("text"))
    return data.unionByName(fields)


@_query("""with items as (select l_suppkey, 110 + l_partkey % 9 * 20 + l_orderkey % 3 + case when l_partkey % 23 = 0 then 7 else 0 end as x from lineitem),
total as (select l_suppkey, count(*) as n from items group by 1),
hist as (select l_suppkey, cast(round_even(x / 5.0, 0) * 5 as integer) as b, count(*) as c from items group by 1, 2),
peak as (select h.l_suppkey, h.b, h.c, row_number() over (partition by h.l_suppkey order by h.b) as i from hist h join total t using (l_suppkey) left join hist l on l.l_suppkey = h.l_suppkey and l.b = h.b - 5 left join hist r on r.l_suppkey = h.l_suppkey and r.b = h.b + 5 where h.c >= greatest(8, t.n // 80) and h.c >= coalesce(l.c, 0) and h.c >= coalesce(r.c, 0)),
fold as (with recursive f(l_suppkey, i, kept, b, c) as (
  select l_suppkey, i, [b], b, c from peak where i = 1
  union all
  select p.l_suppkey, p.i, case when p.b - f.b < 10 then case when p.c > f.c then list_concat(f.kept[:len(f.kept) - 1], [p.b]) else f.kept end else list_concat(f.kept, [p.b]) end, case when p.b - f.b < 10 and p.c <= f.c then f.b else p.b end, case when p.b - f.b < 10 and p.c <= f.c then f.c else p.c end
  from f join peak p on p.l_suppkey = f.l_suppkey and p.i = f.i + 1) select * from f)
select l_suppkey, array_to_string(arg_max(kept, i), ' ') as centres from fold group by 1""")
def coord_peaks(spark, d):
    centres = coords.column_centres(supplier_words(spark, d).where("x0 >= 110"))
    return centres.select(F.col("page_number").alias("l_suppkey"), F.array_join(F.transform("centres", lambda c: c.cast("int").cast("string")), " ").alias("centres"))


@_query("""with items as (select l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as word_no, 110 + l_partkey % 9 * 20 + l_orderkey % 3 + case when l_partkey % 23 = 0 then 7 else 0 end as x, 500 - 100 * (l_linenumber % 5) + l_orderkey % 90 - 30 as y, concat(l_returnflag, l_linenumber) as text from lineitem),
total as (select l_suppkey, count(*) as n from items group by 1),
hist as (select l_suppkey, cast(round_even(x / 5.0, 0) * 5 as integer) as b, count(*) as c from items group by 1, 2),
peak as (select h.l_suppkey, h.b, h.c, row_number() over (partition by h.l_suppkey order by h.b) as i from hist h join total t using (l_suppkey) left join hist l on l.l_suppkey = h.l_suppkey and l.b = h.b - 5 left join hist r on r.l_suppkey = h.l_suppkey and r.b = h.b + 5 where h.c >= greatest(8, t.n // 80) and h.c >= coalesce(l.c, 0) and h.c >= coalesce(r.c, 0)),
fold as (with recursive f(l_suppkey, i, kept, b, c) as (
  select l_suppkey, i, [b], b, c from peak where i = 1
  union all
  select p.l_suppkey, p.i, case when p.b - f.b < 10 then case when p.c > f.c then list_concat(f.kept[:len(f.kept) - 1], [p.b]) else f.kept end else list_concat(f.kept, [p.b]) end, case when p.b - f.b < 10 and p.c <= f.c then f.b else p.b end, case when p.b - f.b < 10 and p.c <= f.c then f.c else p.c end
  from f join peak p on p.l_suppkey = f.l_suppkey and p.i = f.i + 1) select * from f),
centre as (select l_suppkey, unnest(k) as cx from (select l_suppkey, arg_max(kept, i) as k from fold group by 1)),
field as (select i, 500 - 100 * i as fy, name from (values (0, '公司全称'), (1, '公司简称'), (2, '投资日期'), (3, '行业'), (4, '总投资成本')) v(i, name)),
guard as (select distinct l_suppkey from items where abs(y - 500) <= 30),
placed as (select w.l_suppkey, w.word_no, w.text, (select c.cx from centre c where c.l_suppkey = w.l_suppkey order by abs(c.cx - w.x), c.cx limit 1) as cx, (select f.fy from field f order by abs(f.fy - w.y), f.i limit 1) as fy, w.y from items w semi join guard g on g.l_suppkey = w.l_suppkey),
cell as (select l_suppkey, cx, fy, string_agg(text, ' ' order by word_no) as t from placed where cx is not null and abs(fy - y) <= 60 group by 1, 2, 3),
line as (select l_suppkey, cx, concat('| ', string_agg(coalesce(t, ''), ' | ' order by i), ' |') as l from (select distinct l_suppkey, cx from cell) k cross join field f left join cell using (l_suppkey, cx, fy) group by 1, 2)
select l_suppkey, concat('| 公司全称 | 公司简称 | 投资日期 | 行业 | 总投资成本 |', chr(10), '| --- | --- | --- | --- | --- |', chr(10), string_agg(l, chr(10) order by cx)) as markdown from line group by 1""")
def coord_table(spark, d):
    return coords.rebuild(supplier_words(spark, d)).select(F.col("page_number").alias("l_suppkey"), "markdown")


# Names and corrections -----------------------------------------------------------------------------------------------

_NAMES = f"""{_LATEST}, texts as (select doc_id, raw_text as t from latest_analysis where not coalesce(garbled, false) and length(raw_text) > 0),
found as (select doc_id, unnest(list_concat(regexp_extract_all(t, '{HAN_SQL}{{2,}}(?:有限合伙）|有限公司|股份有限公司|有限责任公司)'), regexp_extract_all(t, '{HAN_SQL}{{2,}}(?:合伙企业|投资中心|基金)'))) as noun from texts),
full_names as (select doc_id, noun, count(*) as n from found where length(noun) >= 6 group by 1, 2 having count(*) >= 2)"""


def native_texts(spark: SparkSession, d: str) -> DataFrame:
    return analysis_rows(spark, d).where("not coalesce(garbled, false) and length(raw_text) > 0").select("doc_id", F.col("raw_text").alias("text"))


@_query(f"""with {_NAMES}, run as (select distinct doc_id, regexp_replace(noun, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g') as r from full_names),
piece as (select distinct doc_id, substr(r, i, 4) as noun from (select doc_id, r, unnest(range(1, length(r) - 2)) as i from run where length(r) >= 4)),
short as (select doc_id, noun, cast(sum((length(t) - length(replace(t, noun, ''))) / 4) as bigint) as n from piece join texts using (doc_id) where contains(t, noun) group by 1, 2 having sum((length(t) - length(replace(t, noun, ''))) / 4) >= 5)
select doc_id, noun, cast(n as bigint) as n, 'full' as kind from full_names union all select doc_id, noun, n, 'short' from short anti join full_names using (doc_id, noun)""")
def proper_nouns(spark, d):
    texts = native_texts(spark, d)
    full = nouns.names(texts)
    return full.select("doc_id", "noun", big("n").alias("n"), F.lit("full").alias("kind")).unionByName(nouns.short_forms(texts, full).select("doc_id", "noun", big("n").alias("n"), F.lit("short").alias("kind")))


@_query()
def fix_text_layer(spark, d):
    raw = analysis_rows(spark, d).where("not coalesce(garbled, false) and length(raw_text) > 0").select("page_id", "raw_text")
    both = page_rows(spark, d).where("method = 'vision' and length(markdown) > 0").join(raw, "page_id")
    return correct.correct_by_text_layer(both, "markdown", "raw_text").select("page_id", F.col("markdown").alias("text"))


@_query()
def fix_nouns(spark, d):
    known = nouns.known_nouns(native_texts(spark, d))
    both = page_rows(spark, d).where("method = 'vision' and length(markdown) > 0").join(known, "doc_id")
    return correct.correct_names(both.withColumn("raw", F.lit("")), "markdown", "nouns", "raw").select("page_id", F.col("markdown").alias("text"))


def looped_texts(spark: SparkSession, d: str) -> DataFrame:
    loop = F.repeat(F.concat(F.lit("循环 loop of "), F.col("page_number").cast("string"), F.lit(" words; ")), F.lit(9))
    return page_rows(spark, d).where("markdown is not null").select("page_id", F.when(F.col("page_id") % 11 == 0, F.concat("markdown", loop)).otherwise(F.col("markdown")).alias("text"))


_WINDOWS = f"""{_LATEST}, looped as (select page_id, case when page_id % 11 = 0 then concat(markdown, repeat(concat('循环 loop of ', page_number, ' words; '), 9)) else markdown end as t from latest_pages where markdown is not null),
src as (select page_id, substr(t, 1, 50000) as s from looped),
win as (select unnest([120, 112, 104, 96, 88, 80, 72, 64, 56, 48, 40, 32, 24, 16]) as win),
each as (select page_id, s, win, unnest(range(1, length(s) - win + 2, greatest(1, win // 4))) as i from src cross join win where length(s) >= win),
chunks as (select page_id, win, substr(s, i, win) as chunk, i from each),
windows as (select page_id, cast(win as bigint) as win, chunk, count(*) as n, cast(min(i) - 1 as bigint) as pos from chunks group by 1, 2, 3 having count(*) >= 5 and length(regexp_replace(chunk, '[^\\p{{L}}]', '', 'g')) >= 4)"""


@_query(f"with {_WINDOWS} select * from windows")
def repetition_windows(spark, d):
    return repetition.window_counts(looped_texts(spark, d), "page_id", "text").select("page_id", big("win").alias("win"), "chunk", "n", big("pos").alias("pos"))


@_query(f"""with {_WINDOWS}, held as (select page_id, list({{'n': n, 'at': instr(t, chunk) - 1, 'size': length(chunk)}} order by win desc, pos) as c from windows join looped using (page_id) group by 1),
best as (select page_id, t, list_reduce(coalesce(c, []), lambda b, x: case when x.n > b.n and x.at < b.at then x else b end, {{'n': cast(0 as bigint), 'at': length(t), 'size': cast(0 as bigint)}}) as b from looped left join held using (page_id))
select page_id, case when b.n > 0 then concat(substr(t, 1, b.at + b.size), '{repetition.NOTE.replace(chr(10), "' || chr(10) || '")}') else t end as text from best""")
def repetition_cut(spark, d):
    return repetition.without_loops(looped_texts(spark, d), "text")


# Documents -----------------------------------------------------------------------------------------------------------


@_query("""with src as (select distinct doc_id, page_number, validated from page_record),
gate as (select doc_id, count(distinct page_number) as pages, bool_and(coalesce(validated, false)) as success, list_sort(list(distinct page_number) filter (not coalesce(validated, false))) as bad from src group by 1)
select doc_id, cast(pages as bigint) as pages, success, case when len(bad) > 0 then concat('以下页面未通过校验：', array_to_string(bad, ', ')) end as errors from gate""")
def document_gate(spark, d):
    gate = merge.document_gate(read_table(spark, d, "page_record"))
    return gate.join(merge.error_texts(gate), "doc_id", "left").select("doc_id", big("pages").alias("pages"), "success", "errors")


@_query("""select cast(count(*) filter (coalesce(success, false)) as bigint) as succeeded, cast(count(*) filter (not coalesce(success, false)) as bigint) as failed from (select * from manifest qualify row_number() over (partition by doc_id order by received_at desc nulls last) = 1)""")
def batch_summary(spark, d):
    return cost.batch_summary(manifest_rows(spark, d))


_OUTPUTS = f"""{_LATEST}, gate as (select doc_id from page_record group by 1 having bool_and(coalesce(validated, false))),
outputs as (select p.doc_id, p.page_number, coalesce(p.markdown, '[空白页]') as content from latest_pages p semi join gate g on g.doc_id = p.doc_id),
line as (select doc_id, list_filter(list_transform(string_split({_s(_unmarked('content'))}, chr(10)), lambda l: {_s('l')}), lambda l: l <> '') as ls from outputs),
top as (select doc_id, unnest(ls[:3]) as l, generate_subscripts(ls[:3], 1) - 1 as pos from line),
listed as (select doc_id, unnest(repeated_texts) as l from latest_manifest),
counted as (select doc_id, l, count(*) as c, min(pos) as pos from top t where l not in ('[logo]', '[装饰图片]', '[图片识别失败]') and not exists (select 1 from listed x where x.doc_id = t.doc_id and x.l = t.l) group by 1, 2),
total as (select doc_id, count(*) as n from outputs group by 1),
brand as (select doc_id, list(l order by pos, c desc, l) as b from counted join total using (doc_id) where c >= n * 0.4 group by 1),
lacking as (select o.*, list_filter(coalesce(b, []), lambda l: not contains({_s(_unmarked('content'))}, l)) as m, instr(content, chr(10)) as cut_at from outputs o left join brand using (doc_id)),
branded as (select doc_id, page_number, case when cut_at > 1 and len(m) > 0 then concat(substr(content, 1, cut_at), array_to_string(m, chr(10)), chr(10), chr(10), substr(content, cut_at + 1)) else content end as content from lacking),
canonical as (select m.doc_id, concat({_s("concat('<!-- source: ', coalesce(any_value(m.source_pdf), ''), ' -->', chr(10), chr(10), string_agg(content, chr(10) || chr(10) order by page_number, content))")}, chr(10)) as markdown from latest_manifest m join branded using (doc_id) group by 1)"""


def gated_outputs(spark: SparkSession, d: str) -> DataFrame:
    gate = merge.document_gate(read_table(spark, d, "page_record")).where("success").select("doc_id")
    return page_rows(spark, d).join(gate, "doc_id", "left_semi").select("doc_id", "page_number", F.coalesce("markdown", F.lit(TX.EMPTY_PAGE)).alias("content"))


@_query(f"with {_OUTPUTS} select doc_id, array_to_string(b, chr(10)) as brand from brand")
def brand_header(spark, d):
    return merge.brand_lines(gated_outputs(spark, d), manifest_rows(spark, d)).select("doc_id", F.array_join("brand", "\n").alias("brand"))


@_query(f"with {_OUTPUTS} select doc_id, markdown from canonical")
def canonical_merge(spark, d):
    return merge.canonical(gated_outputs(spark, d), manifest_rows(spark, d))


@_query(f"""with {_OUTPUTS}, asset as (select distinct doc_id, unnest(assets) as asset from page_record)
select a.doc_id, asset from asset a left join canonical c using (doc_id) where not coalesce(contains(markdown, regexp_replace(asset, '^.*/', '')), false)""")
def orphan_assets(spark, d):
    assets = read_table(spark, d, "page_record").select("doc_id", F.explode("assets").alias("asset")).distinct()
    return merge.orphan_assets(assets, merge.canonical(gated_outputs(spark, d), manifest_rows(spark, d)))


@_query(f"with {_LATEST} select doc_id, source_pdf from latest_manifest where not coalesce(success, false)")
def resume_anti_join(spark, d):
    rows = manifest_rows(spark, d).select("doc_id", "source_pdf", "success")
    return unfinished(rows, rows.where("success")).select("doc_id", "source_pdf")


@_query("""select distinct r.page_id, r.page_number from page_record r where validated and not exists (select 1 from pages p where p.doc_id = r.doc_id and p.page_number = r.page_number and p.markdown is not null)""")
def missing_outputs(spark, d):
    outputs = read_table(spark, d, "pages").select("doc_id", "page_number", F.col("markdown").alias("content"))
    return merge.missing_outputs(read_table(spark, d, "page_record"), outputs).select("page_id", "page_number").distinct()


_PRICES = (("model-0", 0.4, 1.6), ("model-1", 1.0, 4.0), ("model-2", 0.25, 2.0))


@_query(f"""with calls as (select concat('model-', page_id % 4) as model, cast(length(coalesce(raw_text, '')) as bigint) as i, case when page_id % 5 > 0 then cast(length(coalesce(body_text, '')) as bigint) end as o from analysis),
price as (select * from (values {', '.join(f"('{m}', {a}, {b})" for m, a, b in _PRICES)}) v(model, input, output))
select model, count(*) as calls, cast(sum(i) as bigint) as prompt_tokens, cast(sum(coalesce(o, 0)) as bigint) as completion_tokens, round((sum(i) * coalesce(any_value(input), 0) + sum(coalesce(o, 0)) * coalesce(any_value(output), 0)) / 1e6::double, 6) as cost from calls left join price using (model) group by 1""")
def token_cost(spark, d):
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    calls = read_table(spark, d, "analysis").select(F.format_string("model-%d", F.col("page_id") % 4).alias("model"), size("raw_text").alias("prompt_tokens"), F.when(F.col("page_id") % 5 > 0, size("body_text")).alias("completion_tokens"))
    return cost.usage_cost(calls, spark.createDataFrame(_PRICES, "model string, input double, output double"))


@_query(f"""with {_GARBLED}, flag as (select page_id, bool_or(length(t) < 30 or garbled) as scan from garbled group by 1), rows_ as (select source, scan from (select * from analysis qualify row_number() over (partition by page_id order by analyzed_at desc nulls last) = 1) join flag using (page_id))
select source, count(*) as pages, cast(count(*) filter (scan) as bigint) as scan_pages, round(count(*) filter (scan) * ((1200 * 1.0 + 800 * 4.0) / 1e6)::double, 6) as cost from rows_ group by rollup (source)""")
def dry_run_estimate(spark, d):
    return cost.dry_run(analysis_rows(spark, d).select("source", "raw_text"), "source")


@_query(f"with {_LATEST} select doc_id, to_json({{'doc_id': doc_id, 'pages': 1, 'text': coalesce(source_pdf, '')}}) as json from latest_manifest")
def manifest_json(spark, d):
    return manifest_rows(spark, d).select("doc_id", F.to_json(F.struct("doc_id", F.lit(1).alias("pages"), F.coalesce("source_pdf", F.lit("")).alias("text"))).alias("json"))


def ladder_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the analysis with their text as native Markdown, and what the manifest says of their document."""
    listed = manifest_rows(spark, d).select("doc_id", "repeated_texts")
    a = analysis_rows(spark, d).join(listed, "doc_id", "left")
    native = F.coalesce("body_text", "raw_text", F.lit(""))
    return a.withColumn("raw_text", F.coalesce("raw_text", F.lit(""))).withColumn("native_markdown", native).withColumn("coords_markdown", F.when(F.col("page_number") % 10 == 0, F.col("raw_text")))


_VISION = _listed_sql("case when not contains(acc, r) and contains(raw, r) then concat(r, chr(10), chr(10), acc) else acc end", "regexp_replace(t, '(^|[^\\p{L}\\p{N}_])(20[012])\\s+年\\s+(\\d+\\s+月)', '\\1\\2? 年 \\3', 'g')")


@_query(f"""with {_LATEST},
src as (select a.doc_id, a.page_number, coalesce(a.raw_text, '') as raw, a.body_text, a.has_tables, a.native_candidate, coalesce(body_text, raw_text, '') as native, case when a.page_number % 10 = 0 then coalesce(a.raw_text, '') end as co, m.repeated_texts from latest_analysis a left join latest_manifest m using (doc_id)),
w1 as (select *, case when native_candidate then {_page_warnings_sql('native', "'native'", 'has_tables', 'body_text', 'raw')} end as nw from src),
w2 as (select *, case when coalesce(len(list_filter(nw, lambda x: regexp_matches(x, '短行|表格'))) > 0, false) and co is not null then {_page_warnings_sql('co', "'native'", 'has_tables', 'body_text', 'raw')} end as cw from w1),
way as (select *, case when len(nw) = 0 then 'native' when len(cw) = 0 then 'native-coords' end as way from w2),
local_out as (select doc_id, page_number, way as method, concat('<!-- page:', page_number, ' method:', way, ' -->', chr(10), case when {_s("case when way = 'native' then native else co end")} = '' then '[空白页]' when way = 'native' then native else co end) as content, true as validated, '' as warnings from way where way is not null),
reply as (select doc_id, page_number, {_unmarked("coalesce(markdown, '')")} as t, case when page_number % 13 = 0 then 'no answer' end as error from latest_pages),
vision as (select m.*, coalesce(r.t, '') as t, r.error from way m left join reply r using (doc_id, page_number) where way is null),
text as (select * exclude (t), {_VISION.replace('m.repeated_texts', 'repeated_texts')} as t from vision),
made as (select *, concat('<!-- page:', page_number, ' method:vision -->', chr(10), case when {_s('t')} = '' then '[空白页]' else t end) as content from text),
judged as (select *, {_page_warnings_sql('content', "'vision'", 'has_tables', 'body_text', 'raw')} as w from made),
back as (select *, len(list_filter(w, lambda x: contains(x, '不足源文本'))) > 0 and length(raw) > 500 as back from judged)
select * from local_out union all
select doc_id, page_number, case when error is null then case when back then 'native-fallback' else 'vision' end end, case when error is null then case when back then concat('<!-- page:', page_number, ' method:native-fallback -->', chr(10), raw) else content end end, error is null, case when error is not null then error when back then '{Q.FELL_BACK}' else array_to_string(w, ';') end from back""")
def routing_ladder(spark, d):
    return _ladder(spark, d, ladder_pages(spark, d), repairs=False)


@_query()
def routing_ladder_repaired(spark, d):
    """The ladder with all repairs of transcribed pages; no SQL."""
    return _ladder(spark, d, ladder_pages(spark, d), repairs=True)


def _ladder(spark, d, pages, repairs):
    replies = page_rows(spark, d).select("doc_id", "page_number", TX.strip_markers(F.coalesce("markdown", F.lit(""))).alias("text"), F.when(F.col("page_number") % 13 == 0, "no answer").alias("error"))
    out = route(pages, transcripts=replies, repairs=repairs)
    return out.select("doc_id", "page_number", "method", "content", "validated", F.array_join("warnings", ";").alias("warnings"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Pages through the routing ladder with all repairs, then canonical texts of the documents of which every page passes."""
    listed = manifest_rows(spark, d).select("doc_id", "source_pdf", F.coalesce("repeated_texts", F.array().cast("array<string>")).alias("repeated_texts"))
    replies = page_rows(spark, d).select("doc_id", "page_number", TX.strip_markers(F.coalesce("markdown", F.lit(""))).alias("text"), F.lit(None).cast("string").alias("error"))
    outputs = materialize(route(ladder_pages(spark, d), transcripts=replies))
    good = merge.document_gate(outputs).where("success").select("doc_id")
    return merge.canonical(outputs.join(good, "doc_id", "left_semi"), listed)


def queries() -> dict[str, Query]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
