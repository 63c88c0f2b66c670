"""DuckDB SQL of the queries that SQL can express."""

_P1 = """
with c as (select 'meta.text' as field, term, count(*) as occurrences, count(distinct r) as records,
    (select count(*) from meta) as n, 10 as rare, 0.5 as common
  from (select r, unnest(regexp_extract_all(text, '(?s).')) as term from (select row_number() over () as r, text from meta)) group by term),
w as (select 'documents.text' as field, term, count(*) as occurrences, count(distinct r) as records,
    (select count(*) from documents) as n, 3 as rare, 0.1 as common
  from (select r, unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) as term from (select row_number() over () as r, text from documents)) group by term),
t as (select * from c union all select * from w),
m as (select *, 'rare' as mark from t where occurrences < rare union all select *, 'common' as mark from t where records > common * n),
"""
SQL = {
    "p1_found": _P1 + "o as (select field, term, mark from m) select * from o",
    "p1_frequencies": _P1 + """o as (select field, term, occurrences, records, mark from m union all
      select field, term, occurrences, records, null from t where not (occurrences < rare or records > common * n)) select * from o""",
}


# Fixed values, of the SQL's own: letters that look like those above or below them in LATIN, script by script.
_TWINS = (
    ("АВСЕНІЈКМОРԚЅТԜХҮԌѴасеһіјорԛѕԝхуԁӏѵ", "ABCEHIJKMOPQSTWXYGVacehijopqswxydlv"),
    ("ΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖϲϳον", "ABCEHIJKMNOPTXYZcjov"),
    ("ԼՕՏՍցհյոօզս", "LOSUghjnoqu"),
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    ("ⲀⲂⲤⲎⲒⲔⲘⲚⲞⲢⲦⲬⲨⲌⲥⲟⲣⲭ", "ABCHIKMNOPTXYZcopx"),
)
#: marks that don't show: those of the nominal fold, soft hyphen, joiners, directions, variation selectors
_GONE = "\u180b\u180c\u180d\u180e\u180f\u200c\u200d\ufeff\ufffe\u00ad\u034f\u061c\u200b\u200e\u200f\u2060\u2061\u2062\u2063\u2064" + "".join(map(chr, range(0xFE00, 0xFE10)))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _plain_sql(x: str) -> str:
    """Full width, kinds of space, dashes and marks undone."""
    spaces = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
    pairs = [(chr(c), " ") for c in spaces] + [(chr(c + 0xFEE0), chr(c)) for c in range(0x21, 0x7F)] + [("\u2010", "-"), ("\u2011", "-")]
    x = f"replace(replace({x}, chr(64257), 'fi'), chr(64258), 'fl')"
    return f"nfc_normalize(translate({x}, {_lit(''.join(a for a, _ in pairs) + _GONE)}, {_lit(''.join(b for _, b in pairs))}))"


def _twins(to_cyrillic: bool = False) -> dict[str, str]:
    """Letters, with and without marks, to their Latin twins, or all to the Cyrillic ones."""
    from unicodedata import normalize

    like = {a: b for twins, latin in _TWINS for a, b in zip(twins, latin, strict=True)}
    if to_cyrillic:
        back = {b: a for a, b in zip(*_TWINS[0])}
        like = {a: back[b] for a, b in like.items() if b in back} | back
    for c, to in list(like.items()):
        for mark in map(chr, range(0x300, 0x315)):
            a, b = normalize("NFC", c + mark), normalize("NFC", to + mark)
            if len(a) == len(b) == 1:
                like[a] = b
    return like


def _look_sql(x: str) -> str:
    """A form in which equal looks are equal: by character instead of by token, so it is another route to
    the same classes as the operator's spelling, with tables of its own."""
    like = _twins()
    return f"nfc_normalize(translate({_plain_sql(x)}, {_lit(''.join(like))}, {_lit(''.join(like.values()))}))"


def _word_sql(x: str) -> str:
    """The spelling of one word: Latin if all its letters can be, else Cyrillic if they can, else letter by letter. Needed
    where case is folded afterwards, as capitals have twins that their small letters lack."""
    latin, cyrillic = _look_sql(x), f"nfc_normalize(translate({_plain_sql(x)}, {_lit(''.join(_twins(True)))}, {_lit(''.join(_twins(True).values()))}))"
    return f"case when not regexp_matches({latin}, '[\\p{{Cyrillic}}\\p{{Greek}}]') then {latin} when not regexp_matches({cyrillic}, '[\\p{{Latin}}\\p{{Greek}}]') then {cyrillic} else {latin} end"


_STOCK = f"stock as (select distinct {_look_sql('text')} as k from stock_lines where text <> '')"
SQL["p4_found"] = f"""with {_STOCK}, m as (select distinct doc_id as key, text as raw, {_look_sql('text')} as k from meta where doc_id is not null and text <> ''),
c as (select distinct column_key as key, line_texts as raw, list_transform(line_texts, lambda t: {_look_sql('t')}) as k from column_labels where column_key is not null and len(line_texts) > 0)
select distinct 'meta.text' as field, a.key as key_a, b.key as key_b from m a join m b on a.k = b.k and a.key < b.key and a.raw <> b.raw where a.k not in (select k from stock)
union all select distinct 'column_labels.line_texts', a.key, b.key from c a join c b on a.k = b.k and a.key < b.key and a.raw <> b.raw"""
_CLASSES = "y as (select field, k, min(key) as class, count(distinct key) as n_keys, count(distinct raw) as n_spellings from x group by field, k having count(distinct raw) > 1)"
SQL["p4_classes"] = f"""with {_STOCK}, x as (select 'meta.text' as field, doc_id as key, text as raw, [{_look_sql('text')}] as k from meta where doc_id is not null and text <> '' and {_look_sql('text')} not in (select k from stock)
  union all select 'column_labels.line_texts', column_key, array_to_string(list_transform(line_texts, lambda t: coalesce('+' || t, '-')), chr(30)), list_transform(line_texts, lambda t: {_look_sql('t')}) from column_labels where column_key is not null and len(line_texts) > 0), {_CLASSES}
select distinct field, key, class, n_keys, n_spellings from x join y using (field, k)"""
SQL["p2_found"] = f"""with recursive {_STOCK}, h as (select distinct src_doc, {_look_sql('text')} as k from meta where src_doc is not null and text <> ''),
e as (select distinct a.src_doc as a, b.src_doc as b from h a join h b using (k) where k not in (select k from stock) and a.src_doc <> b.src_doc),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select min(b) as group_src_doc, a as src_doc from r group by a having min(b) < a"""

_WORDS = f"list_filter(list_transform(regexp_extract_all(text, '[^\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda t: regexp_replace(lower({_word_sql('t')}), '[\\p{{P}}\\p{{Cc}}]', '', 'g')), lambda t: t <> '')"
SQL["p3_coverage"] = f"""with w as (select doc_id, split, source, {_WORDS} as f from documents where split in ('train', 'val', 'test')
    and len(regexp_extract_all(text, '[^\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+')) >= 10),
  g as (select doc_id, split = 'train' as tr, 5 as k, unnest(range(1, len(f) - 3)) as i, f from w union all select doc_id, split = 'train', 4, unnest(range(1, len(f) - 2)), f from w where len(f) <= 10),
  s as (select doc_id, tr, k, i, f[i:i + k - 1] as g from g),
  hit as (select distinct doc_id, unnest(range(i, i + k)) as p from s where not tr and (k, g) in (select (k, g) from s where tr)),
  c as (select doc_id, count(*) as n from hit group by doc_id),
  e as (select w.*, case when f in (select f from w where split = 'train') then len(f) else coalesce(n, 0) end as covered from w left join c using (doc_id) where split <> 'train')
select split, source, count(*) as n_documents, count(*) filter (covered > 0) as n_sharing, sum(len(f))::bigint as n_words, sum(covered)::bigint as n_covered from e group by split, source"""

SQL["p2_units"] = f"""with recursive {_STOCK}, h as (select distinct src_doc, {_look_sql('text')} as k from meta where src_doc is not null and text <> ''),
e as (select distinct a.src_doc as a, b.src_doc as b from h a join h b using (k) where k not in (select k from stock) and a.src_doc <> b.src_doc),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as m from r group by a),
u as (select 'work' as kind, coalesce(least(m, src_doc), src_doc)::varchar as unit from meta left join c on src_doc = a where src_doc is not null
  union all select case when coalesce(k, '') = '' then 'row' else 'look' end, case when coalesce(k, '') = '' then coalesce(doc_id, '') else k end from (select doc_id, {_look_sql('text')} as k from meta where src_doc is null))
select kind, count(*) as n_rows, count(distinct unit) as n_units, 0 as n_torn from u group by kind"""
SQL["p7_check"] = "select count(*) as n_documents, 0 as n_overfull, 0 as n_overlapping, 0 as n_cut, 0 as n_wrong from documents"

# edit distances of words in a band of diagonals around the main one: within d of it, as the distance must be
_TEXT = """w as (select doc_id, split, source, {words} as f from documents where split in ('train', 'val', 'test') and len(regexp_extract_all(text, '[^\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+')) >= 10)""".format(words=_WORDS)
_NEAR = f"""{_TEXT},
  g as (select doc_id, split = 'train' as tr, unnest(range(1, len(f) - 3)) as i, f, 5 as k from w union all select doc_id, split = 'train', unnest(range(1, len(f) - 2)), f, 4 from w where len(f) <= 10),
  s as (select distinct doc_id, tr, f[i:i + k - 1] as g from g),
  met as (select distinct x.doc_id as t, y.doc_id as e from s x join s y using (g) where x.tr and not y.tr),
  two as (select t, e, x.f as a, y.f as b, greatest(len(x.f), len(y.f)) // 8 as d from met join w x on x.doc_id = t join w y on y.doc_id = e where abs(len(x.f) - len(y.f)) <= greatest(len(x.f), len(y.f)) // 8),
  wa as (select t, e, v, count(*) as n from (select t, e, unnest(a) as v from two) group by all), wb as (select t, e, v, count(*) as n from (select t, e, unnest(b) as v from two) group by all),
  cm as (select t, e, sum(least(wa.n, wb.n)) as c from wa join wb using (t, e, v) group by t, e),
  q as (select t, e, a, b, d from two join cm using (t, e) where greatest(len(a), len(b)) - c <= d),
  r as (select t, e, a, b, d, 0::bigint as i, list_transform(range(0, 2 * d + 1), lambda x: case when x >= d then x - d else 1000000 end) as row from q union all
    select t, e, a, b, d, i + 1, list_transform(range(1, 2 * d + 2), lambda x: list_min(list_transform(range(1, x + 1), lambda y: z[y] - y)) + x) from
      (select t, e, a, b, d, i, list_transform(range(0, 2 * d + 1), lambda x: case when i + 1 + x - d < 0 or i + 1 + x - d > len(b) then 1000000 when i + 1 + x - d = 0 then i + 1
        else least(row[x + 1] + (a[i + 1] <> b[i + 1 + x - d])::bigint, coalesce(row[x + 2], 1000000) + 1) end) as z from r where i < len(a))),
  hit as (select t, e from r where i = len(a) and row[len(b) - len(a) + d + 1] <= d union select x.doc_id, y.doc_id from w x join w y on x.f = y.f where x.split = 'train' and y.split <> 'train')"""
SQL["p3_found"] = f"with recursive {_NEAR} select least(t, e) as doc_id_a, greatest(t, e) as doc_id_b from hit"
SQL["p3_report"] = f"with recursive {_NEAR} select split, source, count(*) as n_documents, count(*) filter (doc_id in (select e from hit)) as n_overlapping from documents where split in ('val', 'test') group by split, source"
