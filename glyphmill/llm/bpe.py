"""Byte-level BPE over a partition by a pair occurrence index.

Method: the partition's distinct pieces of text are laid out as one array of byte tokens with links to
the previous and next token of the same piece. An index maps each mergeable pair, by its rank, to all
its positions. Active ranks are applied in ascending order (a heap): all positions of a rank merge at
once, left to right where they overlap, and the pairs that appear or vanish around them update the
lists of their ranks. Positions are checked when their rank is applied, so vanished pairs need no
deletion. A piece is encoded once however often it occurs; the memory of pieces is bounded.

The vocabulary and merges come from a public tokenizer file; its folder is a parameter. They are of a
fixed size and are broadcast.

Defined results: empty and null texts have no ids (an empty list); strings that look like special
tokens are ordinary text.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TOKENIZER_DIR = "/opt/tokenizers"
#: characters encoded at once, and pieces remembered, by a task
GROUP_CHARS, KNOWN_PIECES = 2_000_000, 250_000

# The tokenizer's pattern, and White_Space of Unicode for the cut at spaces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WS = "\t-\r \x85\xa0  -     　"
# No token crosses from other characters into space, so the pattern may be applied to each of these.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file: printable Latin-1 stands for itself,
    the other bytes follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Byte ids, and the merges as arrays sorted by pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or file.get("normalizer") or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space"):
            raise ValueError(f"{path} is no byte-level BPE with the pattern built in")
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, np.int32)
        for ch, b in _byte_chars().items():
            self.byte_ids[b] = vocab[ch]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        code = self.left << 20 | self.right
        self.order = np.argsort(code)
        self.codes = code[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge."""
        code = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.order[at], -1)


class _Index:
    """Rank -> lists of positions, with a heap of the ranks that have any."""

    def __init__(self):
        self.lists: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        live = ranks >= 0
        ranks, positions = ranks[live], positions[live]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
            if r in self.lists:
                self.lists[r].append(part)
            else:
                self.lists[r] = [part]
                heapq.heappush(self.heap, r)

    def pop(self) -> tuple[int, np.ndarray]:
        r = heapq.heappop(self.heap)
        parts = self.lists.pop(r)
        return r, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def merge_all(data: bytes, ends: np.ndarray, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first byte of each id) of concatenated pieces; ``ends`` are the pieces' end offsets."""
    n = len(data)
    tok = m.byte_ids[np.frombuffer(data, np.uint8)]
    nxt = np.arange(1, n + 1)
    nxt[ends - 1] = -1
    prv = np.arange(-1, n - 1)
    prv[0] = -1
    prv[ends[:-1]] = -1
    alive = np.ones(n, bool)
    index = _Index()
    start = np.flatnonzero(nxt >= 0)
    index.add(m.ranks(tok[start], tok[start + 1]), start)
    while index.heap:
        r, pos = index.pop()
        a, b = m.left[r], m.right[r]
        pos = pos[alive[pos] & (tok[pos] == a)]
        q = nxt[pos]
        ok = (q >= 0) & (tok[q] == b)
        pos, q = pos[ok], q[ok]
        if not len(pos):
            continue
        if a == b and len(pos) > 1:  # overlapping occurrences: every other one of a run
            head = np.concatenate([[True], pos[1:] != q[:-1]])
            run = np.maximum.accumulate(np.where(head, np.arange(len(pos)), 0))
            keep = (np.arange(len(pos)) - run) % 2 == 0
            pos, q = pos[keep], q[keep]
        tok[pos] = m.made[r]
        alive[q] = False
        after = nxt[q]
        nxt[pos] = after
        has = after >= 0
        prv[after[has]] = pos[has]
        before = prv[pos]
        p = pos[before >= 0]
        before = before[before >= 0]
        left, right = np.concatenate([before, pos[has]]), np.concatenate([p, after[has]])
        index.add(m.ranks(tok[left], tok[right]), left)
    at = np.flatnonzero(alive)
    return tok[at], at


class _Known(dict):
    """Numbers for chunks; those not met before are listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Encoder:
    def __init__(self, merges: Merges):
        import regex

        self.m = merges
        self.split = regex.compile(PATTERN).findall
        self.reset()

    def reset(self) -> None:
        self.known = _Known()
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _learn(self) -> None:
        chunks, self.known.new = self.known.new, []
        if not chunks:
            return
        pieces: list[bytes] = []
        per_chunk = []
        for c in chunks:
            parts = (c,) if c.isalpha() or (c[0] == " " and c[1:].isalpha()) else self.split(c)
            per_chunk.append(len(parts))
            pieces += [p.encode() for p in parts]
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        ids, first = merge_all(b"".join(pieces), ends, self.m)
        chunk_end = ends[np.cumsum(per_chunk) - 1]
        cut = np.searchsorted(first, np.concatenate([[0], chunk_end]))
        self.start = np.concatenate([self.start, cut[:-1] + len(self.ids)])
        self.count = np.concatenate([self.count, np.diff(cut)])
        self.ids = np.concatenate([self.ids, ids])

    def chunks(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(chunk numbers of all texts, chunks of each text)."""
        if len(self.known) > KNOWN_PIECES:
            self.reset()
        known, find = self.known, _CHUNK.findall
        numbers, n = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                row = [known[c] for c in find(t)]
                n[i] = len(row)
                numbers += row
        self._learn()
        return np.array(numbers, np.int64), n

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        numbers, n = self.chunks(texts)
        total = np.concatenate([[0], np.cumsum(self.count[numbers])])
        end = np.cumsum(n)
        return total[end] - total[end - n]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        numbers, n = self.chunks(texts)
        count = self.count[numbers]
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(self.start[numbers] - total[:-1], count) + np.arange(total[-1])]
        end = np.cumsum(n)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], total[end]]).astype(np.int32)), pa.array(flat))


def groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first row, rows, texts): parts of a batch of a bounded number of characters (one text at least)."""
    texts = batch.column(column).to_pylist()
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= GROUP_CHARS or i == len(texts) - 1:
            yield at, i + 1 - at, texts[at : i + 1]
            at, chars = i + 1, 0


def _shared_merges(spark: SparkSession, folder: str, name: str):
    return spark.sparkContext.broadcast(Merges(f"{folder}/{name}.json"))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids) of every row; an empty list for empty and null texts."""
    shared = _shared_merges(df.sparkSession, folder, name)

    def run(batches):
        e = Encoder(shared.value)
        for b in batches:
            for at, n, texts in groups(b, 1):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), e.encode(texts)], ["key", "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, n_tokens) of every row, without building the ids."""
    shared = _shared_merges(df.sparkSession, folder, name)

    def run(batches):
        e = Encoder(shared.value)
        for b in batches:
            for at, n, texts in groups(b, 1):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(e.lengths(texts).astype(np.int64))], ["key", "n_tokens"])

    kind = dict(df.dtypes)[key]
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)
