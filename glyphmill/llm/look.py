"""One consistent spelling for text that looks the same on the page.

Method: every token (run without space) gets the intersection of the script sets its letters can be
spelled in. A letter with look-alikes in other scripts counts for all of their scripts, so the
intersection is exactly the set of scripts that can spell the whole token. A token whose own letters
are all of one script but which another script can spell too is a whole-script confusable; one whose
letters come from several scripts is a mixed-script confusable. Either is respelled in one script,
the first of ``SCRIPT_ORDER`` in the intersection; with an empty intersection each letter falls back
to its first look-alike. The choice depends only on how the letters look, so two tokens get the same
spelling exactly if they look the same. Remaining forms (full width, ligatures, separate accents,
invisible marks, kinds of space) are normalized on the way.

Kept apart, since the difference shows: case, digits, raised digits, punctuation marks, and letters
that merely share a glyph in some positions (such as U+1823 and U+1824).

Defined results: null gives null, the empty text the empty text, a text of invisible marks only the
empty text; runs of spaces keep their length.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

# Marks of the nominal fold, and the further invisible format characters.
FOLD_DELETES = (0x180B, 0x180C, 0x180D, 0x180E, 0x180F, 0x200C, 0x200D, 0xFEFF, 0xFFFE)
OTHER_INVISIBLE = (0x00AD, 0x034F, 0x061C, 0x200B, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064)

# Letters drawn alike, one row a shape; columns Latin, Cyrillic, Greek, Armenian, Cherokee, Coptic
# ("." = none). Letters that both occur in words of one orthography stay apart (such as U+0423 and U+04AE).
LOOKALIKES = """
A А Α . Ꭺ Ⲁ
B В Β . Ᏼ Ⲃ
C С Ϲ . Ꮯ Ⲥ
D . . . Ꭰ .
E Е Ε . Ꭼ .
G Ԍ . . Ꮐ .
H Н Η . Ꮋ Ⲏ
I І Ι . . Ⲓ
J Ј Ϳ . Ꭻ .
K К Κ . Ꮶ Ⲕ
L . . Լ Ꮮ .
M М Μ . Ꮇ Ⲙ
N . Ν . . Ⲛ
O О Ο Օ . Ⲟ
P Р Ρ . Ꮲ Ⲣ
Q Ԛ . . . .
R . . . Ꭱ .
S Ѕ . Տ Ꮪ .
T Т Τ . Ꭲ Ⲧ
U . . Ս . .
V Ѵ . . Ꮩ .
W Ԝ . . Ꮃ .
X Х Χ . . Ⲭ
Y Ү Υ . . Ⲩ
Z . Ζ . Ꮓ Ⲍ
a а . . . .
c с ϲ . . ⲥ
d ԁ . . . .
e е . . . .
g . . ց . .
h һ . հ . .
i і . . . .
j ј ϳ յ . .
l ӏ . . . .
n . . ո . .
o о ο օ . ⲟ
p р . . . ⲣ
q ԛ . զ . .
s ѕ . . . .
u . . ս . .
v ѵ ν . . .
w ԝ . . . .
x х . . . ⲭ
y у . . . .
"""
SCRIPT_ORDER = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic")

_ROWS = [line.split() for line in LOOKALIKES.split("\n") if line]
#: letter -> row of its shape
_SHAPE = {c: row for row in _ROWS for c in row if c != "."}
_CACHE_TERMS = 400_000


def _plain_forms() -> dict[int, str | None]:
    """Full- and half-width forms, no-break forms, letters in another style, ligatures, kinds of space and
    invisible marks, by rule from the Unicode data: no other compatibility form is undone."""
    table: dict[int, str | None] = {}
    for cp in (*range(0xA0, 0xD800), *range(0xF900, 0x20000)):
        ch = chr(cp)
        form = unicodedata.decomposition(ch)
        if unicodedata.category(ch) == "Zs":
            table[cp] = " "
        elif form.startswith(("<wide>", "<narrow>", "<noBreak>")) or 0xFB00 <= cp <= 0xFB06 or (form.startswith("<font>") and unicodedata.category(ch)[0] == "L"):
            table[cp] = unicodedata.normalize("NFKC", ch)
    table |= {0x2010: "-", 0x2011: "-"}
    table |= {cp: None for cp in (*FOLD_DELETES, *OTHER_INVISIBLE, *range(0xFE00, 0xFE10))}
    return table


_FORMS = _plain_forms()
_SWAPS = {chr(cp): form or "" for cp, form in _FORMS.items()}
# one class each: beyond U+FFFF a class of single characters would be searched one by one
_SWAPPED = re.compile("[" + "".join(re.escape(c) for c in _SWAPS if c <= "\uffff") + "]")
_BEYOND = re.compile("[\U00010000-\U0001ffff]")


def plain_forms(text: str) -> str:
    """A text with those forms undone (cheaper than ``translate``, as few characters are concerned)."""
    text = _SWAPPED.sub(lambda m: _SWAPS[m[0]], text)
    return _BEYOND.sub(lambda m: _SWAPS.get(m[0], m[0]), text) if _BEYOND.search(text) else text


def token_scripts(token: str) -> tuple[set[str], set[str]]:
    """(scripts that can spell the whole token, scripts its letters come from); letters without a
    look-alike belong to the script that their Unicode name begins with. Digits, marks and
    punctuation are common to all scripts."""
    able: set[str] | None = None
    own: set[str] = set()
    for ch in unicodedata.normalize("NFD", token):
        row = _SHAPE.get(ch)
        if row:
            at = {s for s, c in zip(SCRIPT_ORDER, row) if c != "."}
            own.add(SCRIPT_ORDER[row.index(ch)])
        elif unicodedata.category(ch)[0] == "L":
            at = {unicodedata.name(ch, "UNKNOWN").split(" ", 1)[0].split("-")[0].capitalize()}
            own |= at
        else:
            continue
        able = at if able is None else able & at
    return (able if able is not None else set()), own


#: tokens of these characters only have no look-alike and no other form
_SETTLED = re.compile(r"[\u1800-\u180a\u1810-\u18aa0-9.,()\-\u2500-\u25ff]*")


def _spell(token: str) -> str:
    if _SETTLED.fullmatch(token):
        return token
    able, _ = token_scripts(token)
    return respelled(token, next((s for s in SCRIPT_ORDER if s in able), None))


def respelled(token: str, script: str | None) -> str:
    """The token with its look-alikes in one script; with None each in the first that has its shape."""
    column = SCRIPT_ORDER.index(script) if script else None
    out = []
    for ch in unicodedata.normalize("NFD", token):
        row = _SHAPE.get(ch)
        if row:
            ch = row[column] if column is not None else next(c for c in row if c != ".")
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


def corrected(text: str | None) -> str | None:
    """A text fit for a corpus: forms undone, and every token that several scripts can spell in one script: that of
    most tokens of the text that only one can spell, if it is among them; else a token of one script stays in
    it, and a mixed one takes the script that most of its letters come from. Words that are right in their script
    stay as they are, unlike in the form for comparing."""
    if text is None or text.isascii():
        return text
    tokens = plain_forms(text).split(" ")
    seen: dict[str, tuple[set[str], set[str]]] = {t: token_scripts(t) for t in set(tokens) if t and not _SETTLED.fullmatch(t)}
    sure: dict[str, int] = {}
    for t in tokens:
        if t in seen and len(seen[t][0]) == 1:
            s = next(iter(seen[t][0]))
            sure[s] = sure.get(s, 0) + 1
    main = min(sure, key=lambda s: (-sure[s], s), default=None)
    new = {}
    for t, (able, own) in seen.items():
        script = None
        if len(able) > 1:
            script = main if main in able else next(iter(own)) if len(own) == 1 else max((s for s in SCRIPT_ORDER if s in able), key=lambda s: sum(ch in _SHAPE and ch == _SHAPE[ch][SCRIPT_ORDER.index(s)] for ch in unicodedata.normalize("NFD", t)))
        elif len(able) == 1 and len(own) > 1:
            script = next(iter(able))
        new[t] = respelled(t, script) if script in SCRIPT_ORDER else unicodedata.normalize("NFC", t)
    return " ".join([new.get(t, t) for t in tokens])


def kind_of_token(token: str) -> str:
    """``mixed``: letters of several scripts that one script can spell; ``whole``: letters of one
    script that another can spell; ``plain``: neither."""
    able, own = token_scripts(plain_forms(token))
    if len(own) > 1 and able:
        return "mixed"
    return "whole" if len(own) == 1 and len(able) > 1 else "plain"


class Speller:
    """Consistent spelling with a bounded memory of tokens already seen."""

    def __init__(self, size: int = _CACHE_TERMS):
        self.size, self.seen = size, {}

    def token(self, token: str) -> str:
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) >= self.size:
                self.seen.clear()
            got = self.seen[token] = _spell(token)
        return got

    def text(self, text: str | None) -> str | None:
        if text is None:
            return None
        if text.isascii():
            return text
        text = plain_forms(text)
        # accents may follow a character across nothing but invisible marks, which are gone by now
        seen = self.seen
        return " ".join([seen.get(t) or (self.token(t) if t else "") for t in text.split(" ")])


def consistent(text: str | None) -> str | None:
    """The consistent form of one text."""
    return Speller().text(text)


def corrected_column(spark_df, column: str, to: str):
    """``spark_df`` with ``corrected`` of string column ``column`` as ``to``."""
    schema = T.StructType([f for f in spark_df.schema if f.name != to] + [T.StructField(to, T.StringType())])

    def run(batches):
        for b in batches:
            keep = [n for n in b.schema.names if n != to]
            out = pa.array([corrected(t) for t in b.column(b.schema.get_field_index(column)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in keep] + [out], keep + [to])

    return spark_df.mapInArrow(run, schema)


def look_column(spark_df, column: str, to: str):
    """``spark_df`` with the consistent form of string column ``column`` as ``to`` (Arrow batches, one
    speller for each task)."""
    schema = T.StructType([f for f in spark_df.schema if f.name != to] + [T.StructField(to, T.StringType())])

    def run(batches):
        s = Speller()
        for b in batches:
            out = look_array(b.column(b.schema.get_field_index(column)), s)
            keep = [n for n in b.schema.names if n != to]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in keep] + [out], keep + [to])

    return spark_df.mapInArrow(run, schema)


def look_array(array: pa.Array, s: Speller) -> pa.Array:
    """Consistent forms of an Arrow string array; each distinct text is spelled once."""
    d = pc.dictionary_encode(array)
    spelled = pa.array([s.text(t) for t in d.dictionary.to_pylist()], pa.string())
    return spelled.take(d.indices)


def look_list_array(array: pa.ListArray, s: Speller) -> pa.Array:
    """One key for each non-empty list of texts, elements compared one by one; null for null and
    empty lists. A null element differs from the empty text."""
    values = look_array(array.flatten(), s).to_pylist()
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False))])
    return pa.array(["\x1e".join("\x00" if v is None else "\x01" + v for v in values[a:b]) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string())
