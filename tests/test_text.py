import random
import re

from pyspark.sql import functions as F

from glyphmill.functions import distance, text

DELETES = [0x180B, 0x180C, 0x180D, 0x180F, 0x180E, 0x200C, 0x200D, 0xFEFF, 0xFFFE]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_fold(spark):
    assert one(spark, text.nominal_fold(F.col("t")), t="a᠋b᠎c‍d e﻿") == "abcd e"
    assert one(spark, text.nominal_fold(F.col("t")), t="".join(map(chr, DELETES))) == ""
    assert one(spark, text.nominal_fold(F.lit(None).cast("string"))) is None


def test_normalize_and_tokens_agree_with_python(spark):
    rng = random.Random(1)
    al = "abᠠ \n\t\r 　 \x1c\x85᠎"
    texts = ["", " ", "\n"] + ["".join(rng.choice(al) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", text.normalize(F.col("t")).alias("n"), text.tokens(F.col("t")).alias("w")).collect()
    for r in rows:
        assert r["n"] == re.sub("[\n\r\t ]+", " ", r["t"]).strip()
        assert r["w"] == r["t"].split()


def test_presentation_against_the_rule(spark):
    def direct(t):
        out = []
        for i, c in enumerate(t):
            vowel = i + 1 < len(t) and t[i + 1] in "ᠠᠡ"
            letter = i + 2 < len(t) and "ᠠ" <= t[i + 2] <= "ᢪ"
            out.append(c if c != "᠎" or (vowel and not letter) else " ")
        return "".join(out)

    rng = random.Random(2)
    texts = ["".join(rng.choice("᠎᠎ᠠᠡᠨ a") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.presentation(F.col("t")).alias("p")).collect()
    assert all(r["p"] == direct(r["t"]) for r in rows)


def test_seed_labels_keys(spark):
    ids = [0, 1, 7, 10**9, 2**40 + 5]
    rows = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", text.derive_seed(9, F.col("i")).alias("s"), text.line_key(F.col("i"), F.lit(1)).alias("k")).collect()
    for r in rows:
        assert r["s"] == (9 * 1000003 + r["i"] * 2654435761 + 12345) & 0x3FFFFFFF
        assert r["k"] == f"line_{r['i']:08d}_v1"
    for c in "aᠠ\U0001f60a":
        assert one(spark, text.u_plus(F.col("c")), c=c) == f"U+{ord(c):04X}"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances(spark):
    rng = random.Random(3)
    pairs = [("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("", "abc")] + [tuple(" ".join(rng.choice(["x", "ᠠ", "yy", "\U0001f60a"]) for _ in range(rng.randint(0, 6))) for _ in "ab") for _ in range(100)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", distance.char_distance(F.col("a"), F.col("b")).alias("c"), distance.token_distance(text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("t")).collect()
    for r in rows:
        assert r["c"] == levenshtein(r["a"], r["b"])
        assert r["t"] == levenshtein(r["a"].split(), r["b"].split())


def test_token_distance_of_many_words(spark):
    a, b = " ".join(f"w{i}" for i in range(45_000)), " ".join(f"w{i}" for i in range(1, 45_000))
    # only the names: the distance of such long lists is not for a unit test
    small = spark.createDataFrame([(a.split()[-60:], b.split()[-60:])], "a array<string>, b array<string>")
    assert small.select(distance.token_distance(F.col("a"), F.col("b"))).first()[0] == 0
    assert one(spark, distance.token_distance(F.array(F.lit("x")), F.array().cast("array<string>"))) == 1


def test_order_statistics(spark):
    for n in (0, 1, 2, 5, 6, 11):
        v = F.array(*[F.lit(float(i)) for i in range(n)]).cast("array<double>")
        got = spark.range(1).select(distance.nearest_rank(v, 90.0).alias("p"), distance.nearest_rank(v, 50.0).alias("m"), distance.upper_median(v).alias("u")).first()
        assert got["p"] == (float(round(0.9 * (n - 1))) if n else 0.0)
        assert got["m"] == (float(round(0.5 * (n - 1))) if n else 0.0)
        assert got["u"] == (float(n // 2) if n else None)
