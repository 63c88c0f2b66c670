"""Queries: splits, gates, lines, shards, runs and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators import archive, bands, lines, order, quality, runs, shards
from glyphmill.operators.alphabet import Alphabet, histogram
from glyphmill.plans.vocabulary import COUNTS
from glyphmill.sources import labels
from glyphmill.tables import table

VAL, TEST, GAP = 1200, 1400, 50


def split_two_way(spark, d):
    return table(spark, d, "meta").select("doc_id", "src_doc", "written_at", bands.two_way(F.col("src_doc"), VAL, GAP).alias("split"))


def split_bands(spark, d):
    return table(spark, d, "meta").select("doc_id", "src_doc", "written_at", bands.three_way(F.col("src_doc"), VAL, TEST, GAP).alias("split"))


def band_stats(spark, d):
    return bands.stats(table(spark, d, "meta"), "src_doc", bands.three_way(F.col("src_doc"), VAL, TEST, GAP))


def split_disjoint(spark, d):
    """Works in several splits: none by bands; by the documents' own split as they stand."""
    m, docs = table(spark, d, "meta"), table(spark, d, "documents")
    a = bands.disjoint(m, "src_doc", bands.three_way(F.col("src_doc"), VAL, TEST, GAP)).withColumn("rule", F.lit("bands"))
    return a.unionByName(bands.disjoint(docs, "src_doc", F.col("split")).withColumn("rule", F.lit("documents")))


def coverage_guard(spark, d):
    return bands.coverage_guard(table(spark, d, "meta"), "src_doc", VAL, TEST, GAP)


def duplicate_gate(spark, d):
    return quality.duplicate_keys(table(spark, d, "meta"), "doc_id")


def gate_report(spark, d):
    m = table(spark, d, "meta")
    a = Alphabet.from_counts(histogram(m), 10)
    return quality.gate_report(m, "doc_id", "text", bands.three_way(F.col("src_doc"), VAL, TEST, GAP), 256, F.coalesce(a.covers(F.col("text")), F.lit(False)))


def font_coverage(spark, d):
    """Rows of each font, known or not. The fonts table is small and joins by AQE's choice."""
    f = table(spark, d, "fonts").where("font is not null").select("font", "face_no").distinct()
    return table(spark, d, "meta").groupBy("font").agg(F.count("*").alias("n")).join(f, "font", "left").select("font", "n", "face_no")


def split_router(spark, d):
    """Documents routed to val and test, with what was seen of each."""
    docs = table(spark, d, "documents").where("src_doc is not null").withColumn("route", bands.three_way(F.col("src_doc"), VAL, TEST, GAP))
    return docs.where("route in ('val', 'test')").groupBy("route").agg(F.count("*").alias("n"), F.count_distinct("src_doc").alias("n_docs"), F.min("src_doc").alias("lo"), F.max("src_doc").alias("hi"))


def filter_keep(spark, d):
    """Split and coverage in one predicate, before anything costly."""
    m = table(spark, d, "meta")
    a = Alphabet.from_counts(histogram(m), 10)
    return m.where((bands.three_way(F.col("src_doc"), VAL, TEST, GAP) == "train") & a.covers(F.col("text"))).groupBy("font").agg(F.count("*").alias("n"))


def segment_lines(spark, d):
    return lines.segment(table(spark, d, "documents").select("doc_id", "text"))


def line_length_stats(spark, d):
    return segment_lines(spark, d).agg(F.count("*").alias("n"), F.sum(F.char_length("line")).alias("chars"), F.min(F.char_length("line")).cast("bigint").alias("lo"), F.max(F.char_length("line")).cast("bigint").alias("hi"))


def doc_numbering(spark, d):
    return lines.document_numbers(table(spark, d, "documents").select("doc_id", "text"), [F.col("doc_id")]).select("doc_id", F.col("src_no").alias("number"))


def render_plan(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return lines.render_plan(docs.withColumnRenamed("doc_id", "n"), F.col("n"), 2, 12, 5).select("n", "doc_id", "variant", "font_idx", "seed")


def page_plan(spark, d):
    """Pages of 3 to 7 consecutive lines across column labels."""
    c = order.numbered(table(spark, d, "column_labels").select("idx").distinct(), [F.col("idx")], "pos")
    return lines.pages(c, "pos", 3, 7, 1).groupBy("page").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("slot").alias("last_slot"))


def bucket_of(spark, d):
    b = F.coalesce(F.nullif(F.col("bucket"), F.lit("")), archive.bucket_of(F.col("doc_id")))
    return table(spark, d, "meta").select("doc_id", "written_at", b.alias("bucket"), archive.bucket_of(F.col("doc_id")).alias("derived"))


def _files(spark, d) -> DataFrame:
    return table(spark, d, "page_files").groupBy("path").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_rows").alias("n_rows"))


def pack_bytes(spark, d):
    """Files rolled into shards of 16 kB, in ranges of 500 files."""
    size = F.col("n_bytes") + shards.MEMBER_HEADER
    return shards.roll_bytes(_files(spark, d), [F.col("path")], size, 16_384, rows=500).select("path", "pos", "chunk", "shard")


def pack_count(spark, d):
    return shards.roll_count(_files(spark, d).select("path"), [F.col("path")], 100).select("path", "shard")


def pack_totals(spark, d):
    p = shards.roll_count(_files(spark, d), [F.col("path")], 100)
    return shards.pack_totals(p, F.col("n_bytes").isNull() | (F.col("n_rows") == 0))


def chunk_ranges(spark, d):
    c = shards.chunked(_files(spark, d), [F.col("path")], 7)
    return c.groupBy("chunk", "base").agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


def missing_images(spark, d):
    """Labels whose prediction is missing, by font (predictions stand for images)."""
    w = shards.with_images(table(spark, d, "meta"), table(spark, d, "predictions").select(F.col("key").alias("doc_id")), "doc_id")
    return w.groupBy("font").agg(F.count("*").alias("n"), F.count_if("missing").alias("n_missing"))


def resume_anti(spark, d):
    return shards.resume(table(spark, d, "meta").select("doc_id").distinct(), table(spark, d, "predictions").select(F.col("key").alias("doc_id")), "doc_id")


def repack_meta(spark, d):
    """Metadata lines without key and time, the bucket filled in, as the packer writes them."""
    m = table(spark, d, "meta").withColumn("bucket", F.coalesce(F.nullif(F.col("bucket"), F.lit("")), archive.bucket_of(F.col("doc_id"))))
    return m.select("doc_id", "written_at", labels.to_line(m, ("doc_id", "written_at", "part_file", "text", "font")).alias("line"))


def status_tally(spark, d):
    """Outcomes: a null text is an error, an empty one is empty, the rest is fine."""
    s = F.when(F.col("text").isNull(), "dropped").when(F.col("text") == "", "empty").otherwise("ok")
    return table(spark, d, "meta").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


def _runs(spark, d) -> DataFrame:
    m = table(spark, d, "meta").where("doc_id is not null and src_doc is not null").groupBy("doc_id").agg(F.max_by("src_doc", F.struct("written_at", "src_doc")).alias("src_doc"), F.max_by("text", F.struct("written_at", "src_doc", "text")).alias("text"))
    return runs.runs(m, [F.col("doc_id")], "src_doc")


def run_groups(spark, d):
    return _runs(spark, d).select("doc_id", "src_doc", "run", "ord")


def run_stats(spark, d):
    return runs.length_stats(runs.run_lengths(_runs(spark, d), "src_doc"))


def group_eligibility(spark, d):
    return runs.eligible(runs.run_lengths(_runs(spark, d), "src_doc"), 5).groupBy("src_doc").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"))


def column_windows(spark, d):
    """Windows of five lines from the middle of each eligible run, built into columns."""
    r = _runs(spark, d)
    plan = runs.eligible(runs.run_lengths(r, "src_doc"), 5).select(F.col("run").alias("idx"), "run", F.floor((F.col("n") - 5) / 2).cast("bigint").alias("start"), F.lit(5).alias("k"))
    c = runs.columns(r.withColumn("text", F.coalesce("text", F.lit(""))), plan)
    return c.select("idx", "n_lines", "text")


def column_plan(spark, d):
    """A seeded plan of 200 columns."""
    return runs.column_plan(runs.run_lengths(_runs(spark, d), "src_doc"), 200, 5, 8, 11)


def column_check(spark, d):
    """Columns whose text or number of lines doesn't fit their lines."""
    c = table(spark, d, "column_labels").where("line_texts is not null")
    joined = F.array_join("line_texts", " ")
    return c.select("idx", "column_key", (F.size("line_texts") == F.col("n_lines")).alias("n_ok"), (joined == F.col("text")).alias("text_ok")).distinct()


def strided_sample(spark, d):
    return order.strided(table(spark, d, "predictions").select("key", "ref", "pred").distinct(), [F.col("key"), F.col("ref"), F.col("pred")], 20)


def tail_limit(spark, d):
    """The last three part files' rows."""
    m = table(spark, d, "meta")
    last = m.where("part_file is not null").select("part_file").distinct().orderBy(F.desc("part_file")).limit(3)
    return m.join(last, "part_file", "left_semi").select("part_file", "doc_id", "font_px")


def sample_keys(spark, d):
    """Keys and metadata of one split, the font defaulting to empty."""
    m = table(spark, d, "meta")
    return m.where(bands.three_way(F.col("src_doc"), VAL, TEST, GAP) == "val").select("doc_id", "src_doc", "text", F.coalesce("font", F.lit("")).alias("font"))


def seeded_order(spark, d):
    """Every label with its position in a seeded shuffle."""
    return order.seeded_positions(table(spark, d, "meta").select("doc_id").distinct(), F.col("doc_id"), 3)


def batching(spark, d):
    p = table(spark, d, "predictions").select("key", "ref", "pred").distinct()
    b = order.batches(p, [F.col("key"), F.col("ref"), F.col("pred")], 128, partial=False)
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max(F.char_length(F.coalesce("ref", F.lit("")))).cast("bigint").alias("padded"))


QUERIES = {
    f.__name__: f
    for f in (split_two_way, split_bands, band_stats, split_disjoint, coverage_guard, duplicate_gate, gate_report, font_coverage, split_router, filter_keep, segment_lines, line_length_stats, doc_numbering, render_plan, page_plan, bucket_of, pack_bytes, pack_count, pack_totals, chunk_ranges,
              missing_images, resume_anti, repack_meta, status_tally, run_groups, run_stats, group_eligibility, column_windows, column_plan, column_check, strided_sample, tail_limit, sample_keys, seeded_order, batching)
}

_BANDS = f"case when src_doc >= {TEST} then 'test' when src_doc >= {VAL} and src_doc < {TEST - GAP} then 'val' when src_doc < {VAL - GAP} then 'train' end"
_WS = "\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
from glyphmill.plans.archive import _BUCKET as _B  # noqa: E402

_F = "f as (select path, max(n_bytes) as n_bytes, max(n_rows) as n_rows from page_files group by path), p as (select *, row_number() over (order by path) - 1 as pos from f)"
_RUNS = """m as (select doc_id, max_by(src_doc, {'w': written_at, 's': src_doc}) as src_doc, max_by(coalesce(text, chr(1)), {'w': written_at, 's': src_doc, 't': coalesce(text, '')}) as text from meta where src_doc is not null group by doc_id),
s as (select *, case when lag(src_doc) over (order by doc_id) = src_doc then 0 else 1 end as st from m),
g as (select *, (sum(st) over (order by doc_id) - 1)::bigint as run from s), o as (select *, row_number() over (partition by run order by doc_id) - 1 as ord from g), l as (select run, any_value(src_doc) as src_doc, count(*) as n from o group by run)"""
_LINES = f"""n as (select doc_id, string_split(regexp_replace(regexp_replace(text, '[\\n\\r\\t ]+', ' ', 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g'), ' ') as w from documents where length(text) >= 20),
r as (select doc_id, list_reduce(list_transform(list_append(w, repeat('x', 29)), lambda v: {{'cur': v, 'ls': []::varchar[]}}), lambda a, x:
  case when length(x.cur) > 28 then {{'cur': '', 'ls': case when length(a.cur) >= 8 then list_append(a.ls, a.cur) else a.ls end}}
    when a.cur = '' then {{'cur': x.cur, 'ls': a.ls}}
    when length(a.cur) + 1 + length(x.cur) > 28 then {{'cur': x.cur, 'ls': case when length(a.cur) >= 8 then list_append(a.ls, a.cur) else a.ls end}}
    else {{'cur': a.cur || ' ' || x.cur, 'ls': a.ls}} end, {{'cur': '', 'ls': []::varchar[]}}).ls as ls from n),
l as (select doc_id, unnest(ls) as line, unnest(range(0, len(ls))) as line_no from r)"""


def _seed(base: int, x: str) -> str:
    return f"(({base} * 1000003 + (({x}) % 1073741824) * 2654435761 + 12345) % 1073741824)"


SQL = {
    "segment_lines": f"with {_LINES} select doc_id, line_no::int as line_no, line from l",
    "line_length_stats": f"with {_LINES} select count(*) as n, sum(length(line))::bigint as chars, min(length(line)) as lo, max(length(line)) as hi from l",
    "pack_bytes": f"""with {_F}, c as (select path, pos, coalesce(n_bytes, 0) + case when n_bytes is null then 0 else 512 end as size, 500 as z from p),
      g as (select pos // z as chunk, any_value(z) as z, list(path order by pos) as paths, list(pos order by pos) as ps, list({{'s': size::bigint, 't': 0::bigint, 'o': []::bigint[]}} order by pos) as sz from c group by 1),
      q as (select chunk, paths, ps, list_reduce(sz, lambda a, x: case when a.t + x.s >= 16384 then {{'s': a.s + 1, 't': 0::bigint, 'o': list_append(a.o, a.s)}} else {{'s': a.s, 't': a.t + x.s, 'o': list_append(a.o, a.s)}} end,
        {{'s': (chunk * (z // 50000 + 100))::bigint, 't': 0::bigint, 'o': []::bigint[]}}).o as o from g)
      select unnest(paths) as path, unnest(ps) as pos, chunk, unnest(o) as shard from q""",
    "split_two_way": f"select doc_id, src_doc, written_at, case when src_doc >= {VAL} then 'eval' when src_doc < {VAL - GAP} then 'train' end as split from meta",
    "split_bands": f"select doc_id, src_doc, written_at, {_BANDS} as split from meta",
    "band_stats": f"select coalesce({_BANDS}, 'gap') as split, count(*) as n_rows, count(distinct src_doc) as n_docs, min(src_doc) as min_doc, max(src_doc) as max_doc from meta group by 1",
    "split_disjoint": f"""select 'bands' as rule, count(*) filter (n > 1) as n_shared from (select src_doc, count(distinct {_BANDS}) as n from meta where src_doc is not null group by 1)
      union all select 'documents', count(*) filter (n > 1) from (select src_doc, count(distinct split) as n from documents where src_doc is not null and split is not null group by 1)""",
    "coverage_guard": f"select *, n_val > 0 and n_test > 0 and coalesce(min_doc < {VAL}, false) as ok from (select count(*) filter ({_BANDS} = 'val') as n_val, count(*) filter ({_BANDS} = 'test') as n_test, min(src_doc) as min_doc from meta)",
    "duplicate_gate": "select count(doc_id) as n_rows, count(distinct doc_id) as n_keys, count(doc_id) - count(distinct doc_id) as n_duplicates from meta",
    "gate_report": f"""with {COUNTS}, bad as (select distinct text from (select distinct text, unnest(regexp_extract_all(text, '(?s).')) as ch from meta where text is not null) where ch not in (select ch from vocab))
      select *, max_len <= 256 as frames_ok, max_len <= 256 and n_duplicates = 0 and n_val > 0 and n_test > 0 as ok from (select max(length(text)) as max_len, count(*) - count(distinct doc_id) as n_duplicates, avg(case when text is null or text in (select text from bad) then 1.0 else 0.0 end) as oov_rate,
      count(*) filter ({_BANDS} = 'val') as n_val, count(*) filter ({_BANDS} = 'test') as n_test from meta where doc_id is not null)""",
    "font_coverage": "select font, n, face_no from (select font, count(*) as n from meta group by font) left join (select distinct font, face_no from fonts) using (font)",
    "split_router": f"select case when src_doc >= {TEST} then 'test' else 'val' end as route, count(*) as n, count(distinct src_doc) as n_docs, min(src_doc) as lo, max(src_doc) as hi from documents where src_doc >= {TEST} or (src_doc >= {VAL} and src_doc < {TEST - GAP}) group by 1",
    "filter_keep": f"with {COUNTS}, bad as (select distinct text from (select distinct text, unnest(regexp_extract_all(text, '(?s).')) as ch from meta where text is not null) where ch not in (select ch from vocab)) select font, count(*) as n from meta where {_BANDS} = 'train' and text is not null and text not in (select text from bad) group by font",
    "doc_numbering": "select doc_id, row_number() over (order by doc_id) - 1 as number from documents where length(text) >= 20",
    "render_plan": "select n, format('line_{:08d}_v{}', n, v) as doc_id, v::int as variant, (v % 12)::int as font_idx, ((5 * 1000003 + ((n * 2 + v) % 1073741824) * 2654435761 + 12345) % 1073741824)::bigint as seed from (select doc_id as n, unnest([0, 1]) as v from documents)",
    "page_plan": """with c as (select idx, row_number() over (order by idx) - 1 as pos, count(*) over () as total from (select distinct idx from column_labels)),
      s as (select p as page, 3 + ((1 * 1000003 + p * 2654435761 + 12345) % 1073741824) % 5 as size from (select unnest(range(0, (select max(total) from c))) as p)),
      e as (select page, (sum(size) over (order by page) - size)::bigint as lo, (sum(size) over (order by page))::bigint as hi from s)
      select page, count(*) as n, min(idx) as first, max(pos - lo) as last_slot from c join e on pos >= lo and pos < hi where hi <= total group by page""",
    "bucket_of": f"select doc_id, written_at, coalesce(nullif(bucket, ''), {_B}) as bucket, {_B} as derived from meta",
    "pack_count": f"with {_F} select path, pos // 100 as shard from p",
    "pack_totals": f"with {_F} select count(*) filter (not bad) as packed, count(distinct shard) filter (not bad) as shards, count(*) filter (bad) as errors from (select pos // 100 as shard, n_bytes is null or n_rows = 0 as bad from p)",
    "chunk_ranges": f"with {_F}, z as (select path, pos, ceil((select count(*) from f) / 7.0)::bigint as size from p) select pos // size as chunk, (pos // size) * (size // 50000 + 100) as base, count(*) as n, min(path) as first, max(path) as last from z group by 1, 2",
    "missing_images": "select font, count(*) as n, count(*) filter (doc_id is null or doc_id not in (select key from predictions where key is not null)) as n_missing from meta group by font",
    "resume_anti": "select distinct doc_id from meta where doc_id not in (select key from predictions where key is not null)",
    "repack_meta": f"select doc_id, written_at, to_json({{'kind': kind, 'src_doc': src_doc, 'bucket': coalesce(nullif(bucket, ''), {_B}), 'font_px': font_px}})::varchar as line from meta",
    "status_tally": "select case when text is null then 'dropped' when text = '' then 'empty' else 'ok' end as status, count(*) as n from meta group by 1",
    "run_groups": f"with {_RUNS} select doc_id, src_doc, run, ord from o",
    "run_stats": f"with {_RUNS} select count(*) as n_runs, min(n) as min_n, max(n) as max_n, list_sort(list(n))[count(*) // 2 + 1] as median_n from l",
    "group_eligibility": f"with {_RUNS} select src_doc, count(*) as n_runs, max(n) as longest from l where n >= 5 group by src_doc",
    "column_windows": f"with {_RUNS} select o.run as idx, count(*) as n_lines, string_agg(replace(text, chr(1), ''), ' ' order by ord) as text from o join l using (run) where n >= 5 and ord >= (n - 5) // 2 and ord < (n - 5) // 2 + 5 group by o.run",
    "column_plan": f"""with {_RUNS}, a as (select run, n, row_number() over (order by {_seed(11, 'run')}, run) - 1 as rank from l where n >= 5 order by rank limit 200),
      c as (select i as idx, run, n, 5 + {_seed(12, 'i * 2')} % (least(8, n) - 4) as k from (select unnest(range(0, 200)) as i) join a on rank = i % (select count(*) from a))
      select idx, run, ({_seed(12, 'idx * 2 + 1')} % (n - k + 1))::bigint as start, k::bigint as k from c""",
    "column_check": "select distinct idx, column_key, len(line_texts) = n_lines as n_ok, array_to_string(list_filter(line_texts, lambda x: x is not null), ' ') = text as text_ok from column_labels where line_texts is not null",
    "strided_sample": "with p as (select distinct key, ref, pred from predictions), r as (select *, row_number() over (order by key, ref nulls first, pred nulls first) - 1 as pos, count(*) over () as n from p) select key, ref, pred from r where pos % greatest(1, n // 20) = 0",
    "tail_limit": "select part_file, doc_id, font_px from meta where part_file in (select distinct part_file from meta where part_file is not null order by part_file desc limit 3)",
    "sample_keys": f"select doc_id, src_doc, text, coalesce(font, '') as font from meta where {_BANDS} = 'val'",
    "batching": "with p as (select distinct key, ref, pred from predictions), r as (select *, row_number() over (order by key, ref nulls first, pred nulls first) - 1 as pos, count(*) over () as n from p) select pos // 128 as batch, count(*) as n, min(key) as first, max(length(coalesce(ref, ''))) as padded from r where pos // 128 < n // 128 group by 1",
}
