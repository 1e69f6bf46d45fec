"""Queries of the training-data operators, over whole tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import chunking, encoding, langid, mixing, ocr_repair, packing, residue, site_lines, tokens, truncation
from pagemill.operators.merge import latest
from pagemill.plans.storage import materialize, read_table


def _limit(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    row = read_table(spark, d, "limits").where(F.col("name") == name).first()
    return row.max_size, row.overlap


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.noisy(ocr_repair.repair(*_p1_tables(spark, d))).select("field", "page_id").distinct()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.repair(*_p1_tables(spark, d), once=True).drop("row")


def _p1_tables(spark, d):
    return read_table(spark, d, "analysis"), read_table(spark, d, "pages"), read_table(spark, d, "manifest")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    size, overlap = _limit(spark, d, "page_chunk")
    return chunking.split_items(read_table(spark, d, "pages"), "page_id", "markdown", size, overlap)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 2").select("page_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    size, overlap = _limit(spark, d, "page_chunk")
    # pages that come twice are told by their keys, so neither texts nor pieces are exchanged
    pages = latest(read_table(spark, d, "pages").select("page_id", "markdown", "written_at"), ["page_id"], "written_at", 0)
    return chunking.split_items(pages, "page_id", "markdown", size, overlap)


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each page put together again from its pieces, and whether they are as long and share as much as they should: the check of p2_pieces."""
    size, overlap = _limit(spark, d, "page_chunk")
    pieces = p2_pieces(spark, d)
    ordered = F.sort_array(F.collect_list(F.struct("piece_no", "start", "end", "piece")))
    kept = pieces.groupBy("page_id").agg(ordered.alias("p"))
    before = F.concat(F.array(F.lit(0)), F.transform("p", lambda x: x["end"]))
    fits = F.forall(F.transform("p", lambda x, i: (F.length(x["piece"]) <= size) & (F.length(x["piece"]) == x["end"] - x["start"]) & ((x["start"] == F.get(before, i) - overlap) | (i == 0))), lambda ok: ok)
    text = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], F.lit(overlap + 1), F.length(x["piece"])))), "")
    return kept.select("page_id", F.size("p").alias("n"), text.alias("text"), fits.alias("fits")).select("page_id", "text", "fits", (F.col("n") > 1).alias("cut"))


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.find_repeated(read_table(spark, d, "analysis"), read_table(spark, d, "manifest"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _repeated(spark, d).select("field", "record_key", "line_no").distinct()


def p3_lines(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_by_source(_repeated(spark, d))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.without_repeated(read_table(spark, d, "analysis"), _repeated(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(read_table(spark, d, "pages"), "page_id", "markdown").select("page_id").distinct()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(read_table(spark, d, "pages"), "page_id", "markdown")


def _owners(spark: SparkSession, d: str) -> DataFrame:
    """The source of each report."""
    return read_table(spark, d, "manifest").groupBy("doc_id").agg(F.min("source").alias("source"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    texts = truncation.cut_texts(read_table(spark, d, "pages")).select(F.lit("pages.markdown").alias("field"), "page_id")
    warnings = truncation.cut_warnings(read_table(spark, d, "page_record"), _owners(spark, d)).select(F.lit("page_record.warnings").alias("field"), "page_id")
    return texts.unionByName(warnings).distinct()


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    pages, records = read_table(spark, d, "pages"), read_table(spark, d, "page_record")
    texts = truncation.share_by_source(pages.where("markdown is not null").select("page_id", "source"), truncation.cut_texts(pages))
    keys = records.select("page_id", "doc_id").join(_owners(spark, d), "doc_id", "left").select("page_id", "source")
    warned = truncation.share_by_source(keys, truncation.cut_warnings(records, _owners(spark, d)))
    return texts.withColumn("field", F.lit("pages.markdown")).unionByName(warned.withColumn("field", F.lit("page_record.warnings")))


def _restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore_text(read_table(spark, d, "analysis"), "page_id", "raw_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).where("spans + lost > 0").select("page_id").distinct()


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).where("spans + lost > 0").distinct()


def _sizes(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return tokens.token_sizes(read_table(spark, d, "documents"), "doc_id", "text", *keep)


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), "doc_id", _limit(spark, d, "pack")[0])


def p7_pack_small(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), "doc_id", _limit(spark, d, "pack_small")[0])


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialize(_sizes(spark, d))
    rows = [packing.report(packing.pack(sizes, "doc_id", cap), cap).withColumn("name", F.lit(name)) for name in ("pack", "pack_small") for cap in (_limit(spark, d, name)[0],)]
    return rows[0].unionByName(rows[1])


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.draw(_sizes(spark, d, "source"), read_table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_shares_reachable(spark: SparkSession, d: str) -> DataFrame:
    """The report of the largest mixture in which every target that has documents is met."""
    return mixing.draw(_sizes(spark, d, "source"), read_table(spark, d, "mix_targets"), "reachable")[1]


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(read_table(spark, d, "documents"), read_table(spark, d, "lang_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.label_issues(_languages(spark, d)).select("doc_id", "issue").distinct()


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("doc_id", "label", "lang", "confidence")


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).where("size(segments) > 1").select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_repaired, p2_found, p2_pieces, p2_rejoined, p3_found, p3_lines, p3_clean, p4_found, p4_clean, p5_found, p5_shares, p6_found, p6_restored, p7_pack, p7_pack_small, p7_report, p8_mix, p8_shares, p8_shares_reachable, p9_found, p9_languages, p9_segments)
    return {f.__name__: f for f in named}


_WIDE_SQL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_ASCII_SQL = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_FORM = rf"lower(translate(regexp_replace(line, '[\s\x{{0b}}\x{{85}}\x{{1c}}-\x{{1f}}\p{{Z}}\x{{200b}}\x{{2060}}\x{{feff}}]+', '', 'g'), '{_WIDE_SQL}', '{_ASCII_SQL}'))"
_REPEATED = f"""
with lines as (
  select 'analysis.body_text' as field, cast(page_id as varchar) as record_key, source, doc_id, unnest(string_split(body_text, chr(10))) as line, generate_subscripts(string_split(body_text, chr(10)), 1) as line_no
  from analysis where body_text is not null and source is not null
  union all
  select 'manifest.repeated_texts', doc_id, source, doc_id, unnest(repeated_texts), generate_subscripts(repeated_texts, 1)
  from manifest where repeated_texts is not null and source is not null
), forms as (select *, {_FORM} as form from lines),
nodes as (
  select source, form, count(distinct doc_id) as reports from forms where form <> '' group by 1, 2
), total as (select source, count(distinct doc_id) as n from manifest where source is not null group by 1),
kept as (select source, form, reports from nodes join total using (source) where reports >= 3 and reports >= 0.15 * n),
found as (select field, record_key, source, cast(line_no as integer) as line_no, line, form, reports from forms join kept using (source, form))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "select distinct page_id from pages where length(markdown) > (select max_size from limits where name = 'page_chunk')",
        "p2_rejoined": "select distinct page_id, markdown as text, true as fits, length(markdown) > (select max_size from limits where name = 'page_chunk') as cut from pages where markdown is not null",
        "p3_found": _REPEATED + "select distinct field, record_key, line_no from found",
        "p3_clean": _REPEATED
        + """, gone as (select distinct cast(record_key as bigint) as page_id, line_no from found where field = 'analysis.body_text'),
        body as (select page_id, any_value(body_text) as body_text from analysis group by 1),
        split as (select page_id, unnest(string_split(body_text, chr(10))) as line, generate_subscripts(string_split(body_text, chr(10)), 1) as line_no from body where body_text is not null),
        kept_lines as (select s.page_id, string_agg(line, chr(10) order by s.line_no) as t from split s anti join gone g on s.page_id = g.page_id and s.line_no = g.line_no group by 1),
        n as (select page_id, count(*) as removed from gone group by 1)
        select page_id, case when n.removed is null then body_text else coalesce(t, '') end as body_text, cast(coalesce(n.removed, 0) as integer) as removed
        from body left join n using (page_id) left join kept_lines using (page_id)""",
        "p3_lines": _REPEATED.replace("with lines", "with recursive lines", 1).replace("found as (select field,", "found as (select field, doc_id,", 1)
        + """, follow as (select source, doc_id, form, reports, lead(form) over w as form2, lead(reports) over w as reports2, lead(rank) over w = rank + 1 as next_to
          from (select f.field, f.record_key, f.doc_id, f.source, f.form, f.reports, r.rank from found f join ranked r using (field, record_key, line_no)) window w as (partition by field, record_key order by rank)),
        edge as (select source, form, form2 from follow where next_to and form <> form2 group by source, form, form2, least(reports, reports2) having count(distinct doc_id) >= 3 and count(distinct doc_id) * 2 >= least(reports, reports2)),
        both_ways as (select source, form, form2 from edge union select source, form2, form from edge),
        reach as (select source, form, form as other from kept union select r.source, r.form, b.form2 from reach r join both_ways b on b.source = r.source and b.form = r.other),
        block as (select source, form, min(other) as block from reach group by 1, 2)
        select source, block, min(line) as line, reports, count(*) as occurrences from found join block using (source, form) group by source, block, form, reports""".replace("join ranked r", "join (select field, record_key, cast(line_no as integer) as line_no, row_number() over (partition by field, record_key, copy order by line_no) - 1 as rank from (select *, row_number() over (partition by field, record_key, line_no order by line) as copy from forms where form <> '') where copy = 1) r"),
    }
