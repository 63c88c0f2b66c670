"""Queries: text functions and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import alphabet as A
from glyphmill.tables import table

MIN_COUNT = 10


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(table(spark, d, "meta"))


def nominal_fold(spark, d):
    """Labels and recognized texts, folded."""
    return table(spark, d, "predictions").select("key", T.nominal_fold(F.col("ref")).alias("ref"), T.nominal_fold(F.col("pred")).alias("pred"))


def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


def presentation(spark, d):
    return table(spark, d, "meta").select("doc_id", "written_at", T.presentation(F.col("text")).alias("text"))


def tokenize(spark, d):
    w = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.try_element_at(w, F.lit(1)).alias("first"), F.try_element_at(w, F.lit(-1)).alias("last"))


def u_plus_labels(spark, d):
    c = _counts(spark, d)
    return c.select(T.u_plus(F.col("ch")).alias("label"), "ch", "n", F.substring(F.repeat("ch", 80), 1, 70).alias("shown"))


def derive_seed(spark, d):
    return table(spark, d, "column_labels").select("idx", T.derive_seed(7, F.col("idx") * 1000003).alias("seed")).distinct()


def char_histogram(spark, d):
    return _counts(spark, d)


def alphabet_ids(spark, d):
    return A.ids(_counts(spark, d), MIN_COUNT)


def alphabet_sha(spark, d):
    return A.sha(_counts(spark, d), MIN_COUNT)


def curation_summary(spark, d):
    return A.curation(_counts(spark, d), MIN_COUNT)


def dropped_top20(spark, d):
    return A.dropped_top(_counts(spark, d), MIN_COUNT)


def _alphabet(spark, d):
    return A.Alphabet.from_counts(_counts(spark, d), MIN_COUNT)


def oov_flags(spark, d):
    return table(spark, d, "predictions").select("key", "ref", _alphabet(spark, d).covers(F.col("ref")).alias("covered"))


def oov_rate_by_font(spark, d):
    m = table(spark, d, "meta").where("text is not null")
    return m.groupBy("font").agg(F.count("*").alias("n"), F.avg(F.when(_alphabet(spark, d).covers(F.col("text")), 0.0).otherwise(1.0)).alias("oov_rate"))


def encode_ids(spark, d):
    ids = _alphabet(spark, d).encode(F.col("ref"))
    return table(spark, d, "predictions").where("ref is not null").select("key", "ref", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


def decode_ids(spark, d):
    """Reference texts rebuilt from ids: characters out of vocabulary are gone."""
    a = _alphabet(spark, d)
    return table(spark, d, "predictions").where("ref is not null").select("key", "ref", a.decode(a.encode(F.col("ref"))).alias("text"))


def oov_set(spark, d):
    """Characters of documents that the labels' vocabulary lacks."""
    docs = A.histogram(table(spark, d, "documents"))
    return docs.join(A.ids(_counts(spark, d), MIN_COUNT), "ch", "left_anti")


def label_policies(spark, d):
    """Labels written as JSON lines with bad rows between, scanned again with the errors counted."""
    from glyphmill.sources.labels import parsed

    m = table(spark, d, "meta")
    n = F.char_length("text")
    line = F.when(n % 7 == 3, F.concat(F.lit("{torn"), F.coalesce("text", F.lit("")))).when(n % 7 == 5, F.lit('{"text": 5}')).otherwise(F.to_json(F.struct("text")))
    return parsed(m.select(line.alias("raw"))).groupBy(F.coalesce("_error", F.lit("ok")).alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).cast("bigint").alias("n_chars"))


QUERIES = {f.__name__: f for f in (nominal_fold, normalize_text, presentation, tokenize, u_plus_labels, derive_seed, char_histogram, alphabet_ids, alphabet_sha, curation_summary, dropped_top20, oov_flags, oov_rate_by_font, encode_ids, decode_ids, oov_set, label_policies)}

_MARKS = "''||" + "||".join(f"chr({ord(c)})" for c in T.FOLD_DELETES)


def fold_sql(x: str) -> str:
    return f"translate({x}, chr(8239)||{_MARKS}, ' ')"


_WS = "\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{_WS}]+'), lambda w: w <> '')"


COUNTS = "counts as (select ch, count(*) as n from (select unnest(regexp_extract_all(text, '(?s).')) as ch from meta) group by ch), vocab as (select ch from counts where n >= 10)"
_ENC = "ids as (select ch, row_number() over (order by ch) - 1 as id from vocab), r as (select distinct ref from predictions where ref is not null), e as (select ref, string_agg(id::varchar, ' ' order by pos) as ids, string_agg(ch, '' order by pos) as txt from (select ref, unnest(c) as ch, unnest(range(1, len(c) + 1)) as pos from (select ref, regexp_extract_all(ref, '(?s).') as c from r)) join ids using (ch) group by ref)"
SQL = {
    "nominal_fold": f"select key, {fold_sql('ref')} as ref, {fold_sql('pred')} as pred from predictions",
    "normalize_text": f"select doc_id, regexp_replace(regexp_replace(text, '[\\n\\r\\t ]+', ' ', 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g') as text from documents",
    "presentation": """select doc_id, written_at, case when text is null then null when text = '' then '' else (
      select string_agg(case when c = chr(6158) and not (a in (chr(6176), chr(6177)) and not coalesce(unicode(b) between 6176 and 6314 and b <> '', false)) then ' ' else c end, '' order by i)
      from (select i, substr(text, i, 1) as c, substr(text, i + 1, 1) as a, substr(text, i + 2, 1) as b from (select unnest(range(1, length(text) + 1)) as i))) end as text from meta""",
    "tokenize": f"select doc_id, len(w) as n_tokens, w[1] as first, w[len(w)] as last from (select doc_id, {tokens_sql('text')} as w from documents)",
    "u_plus_labels": f"with {COUNTS} select 'U+' || lpad(upper(to_hex(unicode(ch))), greatest(4, length(to_hex(unicode(ch))))::int, '0') as label, ch, n, repeat(ch, 70) as shown from counts",
    "derive_seed": "select distinct idx, ((7 * 1000003 + ((idx * 1000003) % 1073741824) * 2654435761 + 12345) % 1073741824)::bigint as seed from column_labels",
    "char_histogram": f"with {COUNTS} select * from counts",
    "alphabet_ids": f"with {COUNTS} select ch, (row_number() over (order by ch) - 1)::int as id from vocab",
    "alphabet_sha": f"with {COUNTS} select count(*) as n_chars, sha256(string_agg(ch, '' order by ch)) as sha256 from vocab",
    "curation_summary": f"with {COUNTS} select count(*) filter (n >= 10) as kept, count(*) filter (n < 10) as dropped, coalesce(sum(n) filter (n < 10), 0)::bigint as dropped_occurrences, sum(n)::bigint as code_points from counts",
    "dropped_top20": f"with {COUNTS} select ch, n from counts where n < 10 order by n desc, ch limit 20",
    "oov_flags": f"with {COUNTS}, bad as (select distinct ref from (select distinct ref, unnest(regexp_extract_all(ref, '(?s).')) as ch from predictions) where ch not in (select ch from vocab)) select key, ref, case when ref is not null then ref not in (select ref from bad) end as covered from predictions",
    "oov_rate_by_font": f"with {COUNTS}, bad as (select distinct text from (select distinct text, unnest(regexp_extract_all(text, '(?s).')) as ch from meta where text is not null) where ch not in (select ch from vocab)) select font, count(*) as n, avg(case when text in (select text from bad) then 1.0 else 0.0 end) as oov_rate from meta where text is not null group by font",
    "encode_ids": f"with {COUNTS}, {_ENC} select key, ref, coalesce(e.ids, '') as ids from predictions left join e using (ref) where ref is not null",
    "decode_ids": f"with {COUNTS}, {_ENC} select key, ref, coalesce(txt, '') as text from predictions left join e using (ref) where ref is not null",
    "oov_set": f"with {COUNTS} select ch, count(*) as n from (select unnest(regexp_extract_all(text, '(?s).')) as ch from documents) where ch not in (select ch from vocab) group by ch",
    "label_policies": """select s as status, count(*) as n, coalesce(sum(case when s = 'ok' then length(text) end), 0)::bigint as n_chars from (select text, case when length(text) % 7 = 3 then 'json' when length(text) % 7 = 5 or text is null then 'text' else 'ok' end as s from meta) group by s""",
}

