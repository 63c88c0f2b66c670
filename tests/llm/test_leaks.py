import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import leaks

SCHEMA = "doc_id bigint, text string, split string, source string, class int, m int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(words, k, rng, vocab):
    w = list(words)
    for _ in range(k):
        how, at = rng.choice("adr"), rng.randrange(len(w))
        if how == "a":
            w.insert(at, rng.choice(vocab))
        elif how == "d":
            del w[at]
        else:
            w[at] = rng.choice(vocab)
    return w


def test_word_distance():
    rng = random.Random(1)
    for _ in range(600):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 9))] for _ in "xy")
        d = distance(a, b)
        for most in (0, 1, 3, 9):
            assert leaks.word_distance(np.array(a, np.int64), np.array(b, np.int64), most) == min(d, most + 1)


def test_runs_of_neighbours(monkeypatch):
    """Against a plain search, with runs cut by batches, pieces and ranges."""
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 3, rng.integers(1, 30)).astype(np.uint32) for _ in range(60)]
    mask = rng.integers(1, 4, 60)
    words, text, length, pos = leaks._flat([t.tobytes() for t in texts])
    at, h, c, d = leaks.suffix_keys(words, length, pos)
    rows = np.stack([h, c, d, text[at], pos[at], length[at], mask[text[at]]])
    rows = rows[:, np.lexsort((rows[4], rows[3], rows[2], rows[1], rows[0]))]
    names = ["h", "c", "d", "class", "pos", "m", "mask"]

    def batches(r):
        return [pa.RecordBatch.from_arrays([pa.array(x) for x in r[:, i : i + 7]], names) for i in range(0, r.shape[1], 7)]

    for held, borders in ((10**6, [0, 10**6]), (9, [0, 10**6]), (20, [0, 100, 101, 333, 10**6])):
        monkeypatch.setattr(leaks, "HELD_ROWS", held)
        out = [r for a, z in zip(borders, borders[1:]) for b in leaks._neighbours(iter(batches(rows[:, a:z]))) for r in b.to_pylist()]
        whole = {}
        for r in out:
            if r["class"] is None:
                t, e = whole.get(r["h"], (0, 0))
                whole[r["h"]] = (t + r["n_train"], e + r["n_eval"])
        got = {(r["h"], r["class"], r["pos"]) for r in out if r["class"] is not None and (not r["open"] or min(whole[r["h"]]) > 0)}
        members = {}
        for r in rows.T.tolist():
            members.setdefault(r[0], []).append(r)
        want = {(k, r[3], r[4]) for k, rs in members.items() for r in rs if any(o[6] & 1 for o in rs) and any(o[6] & 2 for o in rs) and len({o[3] for o in rs}) > 1}
        assert want <= got and {k for k in got - want} <= {(r["h"], r["class"], r["pos"]) for r in out if r["open"]}
    # common prefixes, in one piece
    by = {(r[3], r[4]): r for r in rows.T.tolist()}
    for r in (x for b in leaks._runs([rows[i] for i in range(7)], False, False).to_pylist() for x in [b] if b["h"] & 1 == 0):
        a = texts[r["class"]][r["pos"] :]
        best = 0
        for (k, q), o in by.items():
            if (k, q) != (r["class"], r["pos"]) and o[6] & (3 - r["mask"] if r["mask"] < 3 else 3):
                b = texts[k][q:]
                n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                best = max(best, min(n, 9))
        assert r["prefix"] == best, r


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    docs, header = [], " ".join(rng.choice(vocab) for _ in range(30))
    for i in range(110):
        n = rng.choice([3, 9, 10, 11, 15, 16, 24, 50, 120])
        words = [rng.choice(vocab) for _ in range(n)]
        docs.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            docs.append(" ".join(edited(words, rng.randint(0, max(1, n // 5)), rng, vocab)))
        if i % 6 == 0:
            docs.append(header + " " + " ".join(words[: n // 2]))
    docs += ["One, two THREE four five six seven eight nine ten!", "one two three four five six seven eight nine ten", "Оne two three four five six seven eight nine ten", "one two three four five six seven eight nine", "", " ", None, "- " * 12, "x " * 500]
    docs += [docs[0]] * 5
    return [(i, t, rng.choice(["train", "val", "test", None]), rng.choice(["s", None]), 1, 2) for i, t in enumerate(docs)]


def brute(rows):
    w = leaks.Words()
    forms = {i: f.tolist() for i, t, s, *_ in rows if t is not None and s for f in [w.of(t)] if f is not None}
    side = {i: s == "train" for i, _, s, *_ in rows}
    return {(a, b) for a in forms for b in forms if a < b and side[a] != side[b] and distance(forms[a], forms[b]) * 8 <= max(len(forms[a]), len(forms[b]))}


def test_against_brute_force(spark):
    rows = corpus()
    o = leaks.Overlaps(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = [(r["doc_id_a"], r["doc_id_b"]) for r in o.found().collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    classes = {r["doc_id"]: r for r in o.classes().collect()}
    leaking = {x for p in want for x in p}
    assert {d for d, r in classes.items() if r["n_links"]} >= leaking
    rep = leaks.report(spark.createDataFrame(rows, SCHEMA), o).collect()
    assert sum(r["n_documents"] for r in rep) == sum(s in ("val", "test") for _, _, s, *_ in rows)
    # coverage against a plain search
    w = leaks.Words()
    forms = {i: f.tolist() for i, t, s, *_ in rows if t is not None and s for f in [w.of(t)] if f is not None}
    grams = lambda f, k: {tuple(f[j : j + k]) for j in range(len(f) - k + 1)}
    train = {i: f for i, f in forms.items() if rows[i][2] == "train"}
    want = {}
    for i, f in forms.items():
        if rows[i][2] != "train":
            hit = set()
            for k in (5, 4):
                pool = set().union(*(grams(t, k) for t in train.values() if k == 5 or len(t) <= 10))
                if k == 5 or len(f) <= 10:
                    hit |= {p for j in range(len(f) - k + 1) if tuple(f[j : j + k]) in pool for p in range(j, j + k)}
            want[i] = len(f) if f in train.values() else len(hit)
    cov = {r["class"]: r["covered"] for r in o.covered.collect()}
    got = {r["doc_id"]: cov.get(r["class"], 0) for r in o.members.where("side = 1").collect()}
    assert got == want and sum(r["n_covered"] for r in leaks.coverage_report(spark.createDataFrame(rows, SCHEMA), o).collect()) == sum(want.values())


def test_hot_copies(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text if i % 3 == 0 else text.replace("w5 ", "q ") if i == 1 else " ".join(f"u{i}x{j}" for j in range(30)), "train" if i % 2 else "test", "s", 1, 2) for i in range(300)]
    o = leaks.Overlaps(spark.createDataFrame(rows, SCHEMA))
    n = Counter(i % 2 for i in range(0, 300, 3))
    assert o.found().count() == n[0] * n[1] + n[0] and o.pairs.count() == 2


def test_hot_passage_gives_linear_candidates(spark):
    """Unequal texts that share an opening, half a text or all but too many words: candidates in proportion."""
    rng = random.Random(4)
    for shared, own in ((6, 20), (30, 30), (6, 8)):
        head = [f"h{i}" for i in range(shared)]
        rows = [(i, " ".join(head + [f"v{rng.randint(0, 10**6)}" for _ in range(own)]), "train" if i % 2 else "test", "s", 1, 2) for i in range(800)]
        rows += [(1000, rows[0][1], "train", "s", 1, 2), (1001, rows[1][1].replace("h2 ", "q "), "test", "s", 1, 2)]
        o = leaks.Overlaps(spark.createDataFrame(rows, SCHEMA))
        assert o.candidates.df.count() <= 2 * len(rows), (shared, own)
        assert {(r["doc_id_a"], r["doc_id_b"]) for r in o.found().collect()} == {(0, 1000), (1, 1001)}


def test_empty(spark):
    o = leaks.Overlaps(spark.createDataFrame([(1, None, "train", None, 1, 2)], SCHEMA))
    assert o.found().count() == 0 and o.classes().count() == 0 and o.covered.count() == 0
