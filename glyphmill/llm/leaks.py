"""Records of evaluation splits that stand, exactly or almost, in the training split.

Method: a suffix array over the texts as sequences of words in consistent form. Its order compares the
first five words of a suffix by a 64-bit hash of them and the next four words by their numbers, so suffixes with
a common prefix of five words and more are neighbours. The suffixes of all texts are partitioned by
ranges of that order and sorted in each range, so a passage that very many texts share is spread over
ranges; runs that cross their borders are closed by a small table of the borders' runs. In each range, neighbours
of different splits with a common prefix of five words or more (nine at most are looked at) are shared
spans. The spans are merged into the coverage of each record.

Deciding on pairs: by the q-gram lemma, a text of n words that differs from another in d words or fewer
shares n - 4 - 5 d of its 5-word spans with it, where d is n // 7 at most for a partner of the allowed
length. So records with fewer shared spans have no partner, which is nearly all of them that share no more
than a passage. Of the others, only as many of the rarest spans are kept as must hold one that a partner
keeps too (prefix filter); partners meet in one of these. A span kept by more than ``FAN`` texts of either side
pairs its texts only if they also share one of their d + 1 rarest words, which texts within d edits do. So a
passage that many unequal texts share gives links in proportion to the texts. An exact word distance of
the pairs follows.

Texts of 10 words and fewer after removal of punctuation, which may share a span of 4 words only, have 4-word
suffixes too. Training suffixes whose first five words stand in no evaluation text are left out early, by a
bitmap of at most ``BITMAP_BITS`` bits; where the bitmap fills up it only lets more through.

Copies: texts with the same words are one class; pairs are found once between classes. ``pairs``
returns class pairs and ``members`` the membership; only ``found`` expands them, as its form demands.

Defined results: texts of fewer than ten words, null texts and those in no split take no part; texts
of the same words are the same. Words and spans are compared by hashes (32 and 64 bits). Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.look import Speller
from glyphmill.tables import SharedTable, shuffle_partitions

PREFIX, SHORT_PREFIX, SHORT = 5, 4, 10
MIN_WORDS, ONE_IN = 10, 8
#: texts of a span and side that are all paired; rows of an unfinished run that a task holds
FAN, HELD_ROWS = 64, 500_000
BITMAP_BITS, SEGMENT_BITS = 1 << 26, 1 << 16
#: candidates of at most this many rows (8 bytes each) are broadcast; more are joined by a shuffle
BROADCAST_ROWS = 500_000
_FORM = "doc_id bigint, side int, m int, k1 bigint, k2 bigint, words binary"
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _dropped() -> dict[int, None]:
    """Punctuation and control characters."""
    return {cp: None for cp in (*range(0x3100), *range(0xFE00, 0x10000)) if unicodedata.category(chr(cp)) in ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Cc")}


_DROPPED = _dropped()


class Words:
    """32-bit numbers of the words of texts; words are cut at white space."""

    def __init__(self, size: int = 400_000):
        self.size, self.seen, self.speller = size, {}, Speller()

    def word(self, raw: str) -> int:
        """The number of a raw word, -1 if nothing is left of it."""
        form = self.speller.text(raw).casefold().translate(_DROPPED)
        if len(self.seen) >= self.size:
            self.seen.clear()
        got = self.seen[raw] = -1 if not form else _crc(form)
        return got

    def of(self, text: str) -> np.ndarray | None:
        """Numbers of the words, None for a text of fewer than ``MIN_WORDS`` raw words."""
        raw = text.split()
        if len(raw) < MIN_WORDS:
            return None
        seen, word = self.seen, self.word
        n = np.array([x if (x := seen.get(w)) is not None else word(w) for w in raw], np.int64)
        return n[n >= 0].astype(np.uint32)


def _crc(form: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(form)


def forms(documents: DataFrame) -> DataFrame:
    """(doc_id, side, m, k1, k2, words): side 0 for train and 1 for val and test; words as 32-bit
    numbers; (k1, k2) a hash of them."""

    def run(batches):
        import xxhash

        w = Words()
        schema = pa.schema([("doc_id", pa.int64()), ("side", pa.int32()), ("m", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("words", pa.binary())])
        for b in batches:
            rows = []
            for doc, side, text in zip(*[c.to_pylist() for c in b.columns]):
                n = w.of(text)
                if n is not None:
                    data = n.tobytes()
                    k = xxhash.xxh3_128_digest(data)
                    rows.append((doc, side, len(n), int.from_bytes(k[:8], "little", signed=True), int.from_bytes(k[8:], "little", signed=True), data))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    split = F.when(F.col("split") == "train", 0).when(F.col("split").isin("val", "test"), 1)
    return documents.select("doc_id", split.alias("side"), "text").where("doc_id is not null and side is not null and text is not null").mapInArrow(run, _FORM)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words from each position on (the last k - 1 are meaningless)."""
    x = (words.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    h = np.zeros(len(x), np.uint64)
    for j in range(k):
        h = h * _STEP
        h[: len(x) - j] += x[j:]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


_SUFFIX = "h bigint, c bigint, d bigint, class bigint, pos int, m int, mask int"


def _flat(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, text, length of the text, position) of every word of the texts one after the other."""
    parts = [np.frombuffer(d, np.uint32) for d in data]
    size = np.array([len(p) for p in parts], np.int64)
    total = int(size.sum())
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return words, np.repeat(np.arange(len(parts)), size), np.repeat(size, size), np.arange(total) - np.repeat(np.cumsum(size) - size, size)


def suffix_keys(words: np.ndarray, length: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index, h, c, d) of the suffixes of concatenated texts: hash of the first five words, the sixth and
    seventh, the eighth and ninth (0 beyond the end). Short texts have suffixes by four words, too."""
    n = len(words)
    at = np.flatnonzero(pos + PREFIX <= length)
    # 31 bits of each number, and 0 for the end of a text, which sorts before any word
    more = np.concatenate([words.astype(np.int64) % ((1 << 31) - 2) + 1, np.zeros(PREFIX + 4, np.int64)])
    ahead = [np.where(pos[at] + k < length[at], more[at + k], 0) for k in range(PREFIX, PREFIX + 4)]
    keys = [(at, gram_hashes(words, PREFIX)[at] if n else np.zeros(0, np.uint64), (ahead[0] << 32) | ahead[1], (ahead[2] << 32) | ahead[3])]
    short = np.flatnonzero((length <= SHORT) & (pos + SHORT_PREFIX <= length))
    if len(short):
        zero = np.zeros(len(short), np.int64)
        keys.append((short, (gram_hashes(words, SHORT_PREFIX)[short] ^ np.uint64(0x5851F42D4C957F2C)) | np.uint64(1), zero, zero))
    at, h, c, d = (np.concatenate(x) for x in zip(*keys))
    # the lowest bit tells 4-word suffixes from 5-word ones
    four = np.arange(len(at)) >= len(keys[0][0])
    h = np.where(four, h | np.uint64(1), h & ~np.uint64(1))
    return at, h.view(np.int64), c, d


def bitmap_of(texts: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the suffix hashes of evaluation texts, put together by segments."""

    def run(batches):
        got = np.zeros(bits, bool)
        for b in batches:
            words, _, length, pos = _flat(b.column(0).to_pylist())
            _, h, _, _ = suffix_keys(words, length, pos)
            for x in _slots(h, bits):
                got[x] = True
        packed = np.packbits(got).reshape(-1, min(bits, SEGMENT_BITS) // 8)
        some = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([packed[i].tobytes() for i in some], pa.binary())], ["segment", "bits"])

    def merge(batches):
        now, held = None, None
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(x, np.uint8)
                if s != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([held.tobytes()])], ["segment", "bits"])
                    now, held = s, x
                else:
                    held = held | x
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([held.tobytes()])], ["segment", "bits"])

    schema = "segment bigint, bits binary"
    rows = texts.where("mask >= 2").select("words").mapInArrow(run, schema).repartition(shuffle_partitions(texts.sparkSession), "segment").sortWithinPartitions("segment").mapInArrow(merge, schema).toArrow()  # BITMAP_BITS at most
    width = min(bits, SEGMENT_BITS) // 8
    out = np.zeros((bits // 8 // width, width), np.uint8)
    for s, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        out[s] = np.frombuffer(x, np.uint8)
    return out.ravel()


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    u = h.view(np.uint64)
    return [((u >> np.uint64(s)) % np.uint64(bits)).astype(np.int64) for s in (1, 33)]


def suffixes(texts: DataFrame, seen, bits: int) -> DataFrame:
    """The suffixes of all classes; those of training texts only if the bitmap has them."""

    def run(batches):
        held = seen.value
        for b in batches:
            cls, mask, data = [c.to_pylist() for c in b.columns]
            # a long text alone, the others together
            for s in _portions([len(d) for d in data]):
                words, text, length, pos = _flat(data[s])
                at, h, c, d = suffix_keys(words, length, pos)
                side = np.array(mask[s], np.int32)[text[at]]
                keep = side >= 2
                hit = np.ones(len(h), bool)
                for x in _slots(h, bits):
                    hit &= (held[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1
                k = np.flatnonzero(keep | hit)
                i = at[k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[k]), pa.array(c[k]), pa.array(d[k]), pa.array(np.array(cls[s], np.int64)[text[i]]), pa.array(pos[i].astype(np.int32)), pa.array(length[i].astype(np.int32)), pa.array(side[k])], ["h", "c", "d", "class", "pos", "m", "mask"]
                )

    return texts.select("class", "mask", "words").mapInArrow(run, _SUFFIX)


def _portions(sizes: list[int], most: int = 2_000_000) -> list[slice]:
    """Ranges of texts of ``most`` bytes together, one text at least."""
    out, a, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            out.append(slice(a, i))
            a, total = i, 0
        total += n
    return [*out, slice(a, len(sizes))] if sizes else []


_SPAN = "h bigint, class bigint, pos int, m int, mask int, n_train bigint, n_eval bigint, prefix int, open int"


def _common(c: np.ndarray, d: np.ndarray, i: np.ndarray, j: np.ndarray, four: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes i and j of a run: five words (four) and those of the next
    four that are equal and no end of a text."""
    n = np.where(four, SHORT_PREFIX, PREFIX)
    same = ~four
    low = (1 << 32) - 1
    for x in (c, d):
        for shift in (32, 0):
            a, b = x[i] >> shift, x[j] >> shift
            if shift == 0:
                a, b = a & low, b & low
            same = same & (a == b) & (a != 0)
            n = n + same
    return n


def _runs(rows: list[np.ndarray], open_first: bool, open_last: bool) -> pa.RecordBatch:
    """Spans of whole runs of equal h. Rows of runs with suffixes of both sides come out with the length of
    their common prefix with the nearest suffix of the other side; an open run (cut by a border) comes
    out whole, with one more row (class null) that holds its counts."""
    h, c, d, cls, pos, m, mask = rows
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    run = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
    train, ev = (mask & 1).astype(np.int64), (mask >> 1).astype(np.int64)
    nt, ne = np.add.reduceat(train, start), np.add.reduceat(ev, start)
    several = np.minimum.reduceat(cls, start) != np.maximum.reduceat(cls, start)
    unfinished = np.zeros(len(start), bool)
    unfinished[0] |= open_first
    unfinished[-1] |= open_last
    both = ((nt > 0) & (ne > 0) & several) | unfinished
    k = np.flatnonzero(both[run])
    at = np.arange(len(h))
    best = np.zeros(len(k), np.int64)
    four = h[k] & 1 == 1
    for flag, needs in ((train, 2), (ev, 1)):
        mine = mask[k] & needs > 0  # needs a neighbour of the other side
        before = np.maximum.accumulate(np.where(flag > 0, at, -1))
        after = np.minimum.accumulate(np.where(flag > 0, at, len(h))[::-1])[::-1]
        before, after = np.concatenate([[-1], before[:-1]])[k], np.concatenate([after[1:], [len(h)]])[k]
        for other in (before, after):
            ok = mine & (other >= 0) & (other < len(h))
            ok &= h[np.clip(other, 0, len(h) - 1)] == h[k]
            best[ok] = np.maximum(best[ok], _common(c, d, k[ok], other[ok], four[ok]))
    u = np.flatnonzero(unfinished)
    null = np.concatenate([np.zeros(len(k), bool), np.ones(len(u), bool)])

    def col(a, b, kind):
        return pa.array(np.concatenate([a, b]).astype(kind))

    zero = np.zeros(len(u), np.int64)
    return pa.RecordBatch.from_arrays(
        [col(h[k], h[start[u]], np.int64), pa.array(np.concatenate([cls[k], zero]), mask=null), col(pos[k], zero, np.int32), col(m[k], zero, np.int32), col(mask[k], zero, np.int32), col(nt[run[k]], nt[u], np.int64), col(ne[run[k]], ne[u], np.int64), col(best, zero, np.int32), col(unfinished[run[k]], zero + 1, np.int32)],
        ["h", "class", "pos", "m", "mask", "n_train", "n_eval", "prefix", "open"],
    )


def _neighbours(batches):
    """Spans of a sorted range of suffixes. A run is held until it ends, or in pieces of ``HELD_ROWS``."""
    held, first = None, True
    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(i).to_numpy() for i in range(7)]
        held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        h = held[0]
        end = int(np.searchsorted(h, h[-1]))  # rows of the last run stay
        if end:
            yield _runs([x[:end] for x in held], first, False)
            held, first = [x[end:] for x in held], False
        elif len(h) > HELD_ROWS:
            yield _runs(held, True, True)
            held, first = None, True
    if held is not None:
        yield _runs(held, first, True)


def spans(texts: DataFrame) -> DataFrame:
    """(h, class, pos, m, mask, n_train, n_eval, prefix): every suffix of a class that shares its first five
    words (four, if h is odd) with a suffix of another class of the other side, with the number of suffixes of
    either side that do, and the longest common prefix with its neighbours."""
    spark = texts.sparkSession
    n = texts.where("mask >= 2").agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    bits = min(BITMAP_BITS, max(1 << 13, 1 << (16 * n).bit_length()))
    seen = spark.sparkContext.broadcast(bitmap_of(texts, bits))
    order = ["h", "c", "d", "class", "pos"]
    array = suffixes(texts, seen, bits).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    all_ = SharedTable(array.mapInArrow(_neighbours, _SPAN)).df
    # few: runs at the borders of ranges
    whole = all_.where("open = 1 and class is null").groupBy("h").agg(F.sum("n_train").alias("nt"), F.sum("n_eval").alias("ne")).where("nt > 0 and ne > 0")
    closed = all_.where("open = 0")
    opened = all_.where("open = 1 and class is not null").join(whole, "h").select("h", "class", "pos", "m", "mask", F.col("nt").alias("n_train"), F.col("ne").alias("n_eval"), F.greatest("prefix", F.when(F.expr("h & 1 = 1"), SHORT_PREFIX).otherwise(PREFIX)).alias("prefix"))
    return closed.drop("open").unionByName(opened)


def coverage(shared: DataFrame) -> DataFrame:
    """(class, m, covered): words of each class in spans shared with the other side."""
    s = shared.groupBy("class", "m").agg(F.array_sort(F.collect_list(F.struct("pos", "prefix"))).alias("s"))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(acc, x):
        to = x["pos"] + x["prefix"]
        return F.struct(F.greatest(acc["end"], to).alias("end"), (acc["total"] + F.greatest(F.lit(0), to - F.greatest(acc["end"], x["pos"]))).alias("total"))

    return s.select("class", "m", F.aggregate("s", none, add)["total"].alias("covered"))


def seeds(shared: DataFrame) -> DataFrame:
    """The spans in which partners must meet (h, class, m, pos, mask, n_train, n_eval), of the classes that
    share enough of them to have one."""
    most = F.floor(F.col("m") / (ONE_IN - 1))
    each = Window.partitionBy("class")
    five = (F.expr("h & 1 = 0")).cast("int")
    s = shared.withColumn("shared", F.sum(five).over(each)).withColumn("rank", F.row_number().over(each.orderBy(F.expr("h & 1"), F.col("n_train") + F.col("n_eval"), "h", "pos")))
    grams = F.col("m") - (PREFIX - 1)
    need = F.greatest(F.lit(1), grams - PREFIX * most)
    keep = F.greatest(F.lit(1), PREFIX * most + 1 - (grams - F.col("shared")))
    return s.where((F.col("m") <= SHORT) | ((F.col("shared") >= need) & (F.col("rank") <= keep))).select("h", "class", "m", "pos", "mask", "n_train", "n_eval")


def _sides(s: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    t = s.where("mask in (1, 3)").select(*key, F.col("class").alias("t"), F.col("m").alias("tm"), F.col("pos").alias("tp"))
    return t, s.where("mask >= 2").select(*key, F.col("class").alias("e"), F.col("m").alias("em"), F.col("pos").alias("ep"))


def rare_words(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, word): of each of ``classes`` the n // 7 + 1 words (counted occurrences) that the fewest of
    them have."""

    def run(batches):
        for b in batches:
            for cls, data in zip(*[c.to_pylist() for c in b.columns]):
                w = np.sort(np.frombuffer(data, np.uint32)).astype(np.int64)
                if len(w):
                    nth = np.arange(len(w)) - np.searchsorted(w, w)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), cls)), pa.array((w << 20) ^ nth), pa.array(np.full(len(w), len(w), np.int32))], ["class", "word", "m"])

    w = SharedTable(texts.join(classes, "class", "left_semi").select("class", "words").mapInArrow(run, "class bigint, word bigint, m int")).df
    df = w.groupBy("word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy("n", "word"))
    return w.join(df, "word").withColumn("rank", rank).where(F.col("rank") <= F.floor(F.col("m") / (ONE_IN - 1)) + 1).select("class", "word")


def candidates(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(t, e) of classes that may be partners; every pair within the distance is among them."""
    s = SharedTable(seeds(shared)).df
    most = F.greatest("tm", "em")
    near = (F.col("t") != F.col("e")) & (F.abs(F.col("tm") - F.col("em")) * ONE_IN <= most) & (F.abs(F.col("tp") - F.col("ep")) * ONE_IN <= most)
    hot = F.least("n_train", "n_eval") > FAN
    t, e = _sides(s.where(~hot), "h")
    met = t.join(e, "h").where(near).select("t", "e")
    many = s.where(hot)
    if not many.isEmpty():
        words = rare_words(texts, many.select("class").distinct())
        t, e = _sides(many.join(words, "class"), "h", "word")
        met = met.unionByName(t.join(e, ["h", "word"]).where(near).select("t", "e"))
    return met.select(F.least("t", "e").alias("a"), F.greatest("t", "e").alias("b")).distinct()


def word_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences, ``most + 1`` if it is larger (furthest points on diagonals)."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    a, b = a.tolist(), b.tolist()

    def slide(i: int, d: int) -> int:
        j = i + d
        while i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        return i

    goal = m - n
    far = {0: slide(0, 0)}
    for e in range(most + 1):
        if far.get(goal, -1) >= n:
            return e
        new = {}
        for d in range(max(-n, -e - 1), min(m, e + 1) + 1):
            i = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1)
            if i >= 0:
                i = min(i, n, m - d)
                if i >= 0:
                    new[d] = slide(i, d)
        far = new
    return most + 1


def _verify(batches):
    for b in batches:
        out = []
        for a, c, x, y in zip(*[col.to_pylist() for col in b.columns]):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            most = max(len(x), len(y)) // ONE_IN
            ux, nx = np.unique(x, return_counts=True)
            uy, ny = np.unique(y, return_counts=True)
            common = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
            shared = int(np.minimum(nx[common[1]], ny[common[2]]).sum())
            if max(len(x), len(y)) - shared > most:
                continue
            e = word_distance(x, y, most)
            if e <= most:
                out.append((a, c, e))
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())])
        yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out) if out else [[]] * 3, schema)], schema=schema)


class Overlaps:
    """``members`` (doc_id, side, class), ``covered`` (class, m, covered) and ``pairs`` (a, b, distance) between
    classes, a < b or, for copies across splits, a = b."""

    def __init__(self, documents: DataFrame):
        made = SharedTable(forms(documents))
        f = made.df
        # copies: a class is named by its smallest doc_id; mask 1: in train, 2: in val or test, 3: in both
        texts = SharedTable(f.groupBy("k1", "k2").agg(F.min("doc_id").alias("class"), F.bit_or(F.col("side") + 1).alias("mask"), F.max("m").alias("m"), F.count("*").alias("n"), F.any_value("words").alias("words"))).df
        copies = texts.where("n > 1").select("k1", "k2", "class")
        self.members = SharedTable(f.select("doc_id", "side", "m", "k1", "k2").join(copies, ["k1", "k2"], "left").select("doc_id", "side", "m", F.coalesce("class", "doc_id").alias("class"))).df
        made.drop()
        both = texts.where("mask = 3")
        shared = spans(texts)
        self.covered = coverage(shared.join(both.select("class"), "class", "left_anti")).unionByName(both.select("class", "m", F.col("m").alias("covered")))
        self.candidates = SharedTable(candidates(texts, shared))
        ids = self.candidates.df.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        if self.candidates.df.count() * 2 <= BROADCAST_ROWS:
            ids = F.broadcast(ids)
        words = SharedTable(texts.select("class", "words").join(ids, "class", "left_semi"))
        c = self.candidates.df
        pair = c.join(words.df.select(F.col("class").alias("a"), F.col("words").alias("x")), "a").join(words.df.select(F.col("class").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y")
        verified = SharedTable(pair.mapInArrow(_verify, "a bigint, b bigint, distance int"))
        words.drop()
        self.pairs = verified.df.unionByName(both.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(0).alias("distance")))

    def found(self) -> DataFrame:
        """(doc_id_a, doc_id_b, distance), a < b: every pair of a training and an evaluation document."""
        m = self.members
        x = m.select(F.col("class").alias("a"), F.col("doc_id").alias("x"), F.col("side").alias("sx"))
        y = m.select(F.col("class").alias("b"), F.col("doc_id").alias("y"), F.col("side").alias("sy"))
        return self.pairs.join(x, "a").join(y, "b").where("sx <> sy and (a <> b or x < y)").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "distance").distinct()

    def classes(self) -> DataFrame:
        """(doc_id, class, n_links): links are classes of the other side with an overlap, itself too if
        it has copies there."""
        p = self.pairs.select("a", "b")
        links = p.select(F.col("a").alias("class"), F.col("b").alias("o")).unionByName(p.where("a <> b").select(F.col("b").alias("class"), F.col("a").alias("o"))).groupBy("class").agg(F.count("*").alias("n_links"))
        return self.members.join(links, "class", "left").select("doc_id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def report(documents: DataFrame, overlaps: Overlaps) -> DataFrame:
    """(split, source, n_documents, n_overlapping) of evaluation documents with an overlap in train."""
    hit = overlaps.classes().where("n_links > 0").select("doc_id", F.lit(1).alias("hit"))
    d = documents.where(F.col("split").isin("val", "test")).select("doc_id", "split", "source")
    return d.join(hit, "doc_id", "left").groupBy("split", "source").agg(F.count("*").alias("n_documents"), F.count("hit").alias("n_overlapping"))


def coverage_report(documents: DataFrame, overlaps: Overlaps) -> DataFrame:
    """(split, source, n_documents, n_sharing, n_words, n_covered) of evaluation documents that take part: those
    with a span shared with train, their words, and their words in such spans."""
    c = overlaps.members.where("side = 1").select("doc_id", "class", "m").join(overlaps.covered.select("class", "covered"), "class", "left")
    d = documents.select("doc_id", "split", "source").join(c, "doc_id")
    return d.groupBy("split", "source").agg(F.count("*").alias("n_documents"), F.count_if(F.col("covered") > 0).alias("n_sharing"), F.sum(F.col("m").cast("bigint")).alias("n_words"), F.coalesce(F.sum(F.col("covered").cast("bigint")), F.lit(0)).alias("n_covered"))
