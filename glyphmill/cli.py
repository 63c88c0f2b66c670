"""Command line: thin wrappers that print what the operators return.

    python -m glyphmill.cli build-alphabet META.jsonl... --out alphabet.json [--min-count 10]
    python -m glyphmill.cli verify 'SHARDS/*.tar' --alphabet alphabet.json --val 434600 --test 435200
    python -m glyphmill.cli extract 'SHARDS/*.tar' --out DIR --val V --test T [--tail N] [--per-shard N]
    python -m glyphmill.cli pack META.jsonl... --images DIR --out DIR [--shard-bytes N] [--workers N]  (0: ranges of 100,000 rows)
    python -m glyphmill.cli lines CORPUS.jsonl... --out DIR
    python -m glyphmill.cli report PREDICTIONS [--by font] [--pairs]
    python -m glyphmill.cli build-columns 'SHARDS/*.tar' --out DIR --val V --test T --split test [--columns N]
    python -m glyphmill.cli eval 'SHARDS/*.tar' --weights W.npz --alphabet alphabet.json --val V --test T --split test
    python -m glyphmill.cli eval-columns DIR --weights W.npz --alphabet alphabet.json
    python -m glyphmill.cli plan-lines CORPUS.jsonl... --out DIR [--variants N] [--fonts N] [--seed N] [--max-lines N]
    python -m glyphmill.cli plan-pages CORPUS.jsonl... --out DIR [--lines-min N] [--lines-max N] [--max-pages N] [--max-lines N]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.text import derive_seed
from glyphmill.operators import alignment, alphabet, bands, imaging, lines, metrics, model, quality, runs, shards
from glyphmill.operators.order import batches, numbered, strided
from glyphmill.sources import columns, labels, tarshard
from glyphmill.tables import SharedTable


def _samples(spark: SparkSession, args) -> DataFrame:
    options = {"tail": args.tail} if getattr(args, "tail", None) else {}
    return tarshard.labelled(tarshard.read(spark, *args.shards, **options))


def _bands(args):
    return bands.three_way(F.col("src_doc"), args.val, args.test, args.gap)


def build_alphabet(spark, args) -> DataFrame:
    text = labels.scan_labels(spark, args.meta)
    counts = alphabet.load_counts(spark, args.counts_in) if args.counts_in else alphabet.histogram(text).cache()
    got = alphabet.curation(counts, args.min_count)
    row = quality.require_rows(counts, "labels") and got.first()
    a = alphabet.Alphabet.from_counts(counts, args.min_count)
    a.save(args.out, ",".join(args.meta), 0 if args.counts_in else text.count(), row["code_points"], args.min_count)
    if args.counts_out:
        alphabet.save_counts(counts, args.counts_out)
    alphabet.dropped_top(counts, args.min_count).show(20, False)
    return got


def verify(spark, args) -> DataFrame:
    """``--window`` looks at the first samples only, in the order of the shards."""
    a = alphabet.Alphabet.load(args.alphabet)
    s = _samples(spark, args)
    if args.window:
        s = s.orderBy("shard", "pos").limit(args.window)
    bands.stats(s, "src_doc", _bands(args)).show()
    s.groupBy("font").count().show()
    bands.disjoint(s, "src_doc", _bands(args)).show()
    return quality.gate_report(s, "key", "text", _bands(args), model.n_frames(args.img_h), a.covers(F.col("text")))


def extract(spark, args) -> DataFrame:
    """Materializes val and test once; the guard fails if the scanned shards don't reach below val."""
    raw = _samples(spark, args)
    guard = bands.coverage_guard(raw, "src_doc", args.val, args.test, args.gap).first()
    if not guard["ok"]:
        raise SystemExit(f"coverage guard failed: {guard.asDict()}")
    s = raw.withColumn("split", _bands(args))
    if args.alphabet:
        s = s.where(alphabet.Alphabet.load(args.alphabet).covers(F.col("text")))
    for split in ("val", "test"):
        part = s.where(F.col("split") == split).drop("shard", "pos")
        tarshard.write(shards.roll_count(part, [F.col("key")], args.per_shard), f"{args.out}/{split}", f"{split}-", 4)
    return bands.stats(s, "src_doc", F.col("split"))


def pack(spark, args) -> DataFrame:
    """Metadata rows and their images, rolled by bytes into shards; rows without image are counted."""
    meta = labels.scan_meta(spark, args.meta)
    img = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(args.images)
    img = img.select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("_k"), F.col("content").alias("png"))
    d = meta.join(img, meta["doc_id"] == F.col("_k"), "left").drop("_k")
    d = d.withColumn("json", labels.to_line(meta, ("doc_id",))).select(F.col("doc_id").alias("key"), "png", "json")
    size = F.coalesce(F.length("png") + 512, F.lit(0)) + F.length(F.encode("json", "UTF-8")) + 512
    packed = shards.roll_bytes(d.where("png is not null"), [F.col("key")], size, args.shard_bytes, args.workers or None)
    tarshard.write(packed, args.out)
    return d.agg(F.count_if(F.col("png").isNotNull()).alias("packed"), F.count_if(F.col("png").isNull()).alias("errors"))


def cut_lines(spark, args) -> DataFrame:
    d = labels.scan_corpus(spark, args.corpus, args.min_doc).withColumn("doc", F.xxhash64("text"))
    cut = lines.segment(d.select("doc", "text"), lo=args.min_chars, hi=args.max_chars, min_doc=args.min_doc)
    cut.write.mode("overwrite").json(args.out)
    return cut.agg(F.count("*").alias("lines"), F.avg(F.char_length("line")).alias("mean_chars"))


def report(spark, args) -> DataFrame:
    p = spark.read.parquet(args.predictions)
    if args.pairs:
        rows = alignment.pair_rows(p, alignment.pair_table(spark))
        rows.show(50, False)
        return alignment.pooled(rows)
    return metrics.report(metrics.scored(p), *([args.by] if args.by else []))


def build_columns(spark, args) -> DataFrame:
    """Runs are found by labels alone; only images of planned windows are decoded. Windows with an image that can't be
    decoded are left out."""
    s = _samples(spark, args).where(_bands(args) == args.split)
    r = runs.runs(quality.require_rows(s, "samples").select("shard", F.col("pos").alias("at"), "src_doc", "text"), [F.col("shard"), F.col("at")], "src_doc")
    plan = runs.column_plan(runs.run_lengths(r, "src_doc"), args.columns, args.lines_min, args.lines_max, args.seed)
    cols = runs.columns(r, plan)
    want = plan.select("idx", "run", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("k") - 1)).alias("ord"))
    planned = r.select("run", "ord", "shard", "at").join(want, ["run", "ord"])
    drawn = s.select("shard", F.col("pos").alias("at"), "png").join(planned, ["shard", "at"]).select("idx", "ord", columns.decoded("png").alias("image"))
    whole = drawn.groupBy("idx").agg(F.count_if(F.col("image.data").isNull()).alias("bad")).where("bad = 0").select("idx")
    img = imaging.stack_groups(drawn.join(whole, "idx"), "idx", "ord", "image", args.line_gap)
    doc = r.groupBy("run").agg(F.first("src_doc").alias("src_doc"))
    out = cols.join(img, "idx").join(doc, "run").withColumn("n_lines", F.col("n_lines").cast("int"))
    columns.write_columns(out, args.out)
    return imaging.column_stats(columns.read_columns(spark, args.out))


def _model(args):
    import numpy as np

    a = alphabet.Alphabet.load(args.alphabet)
    saved = dict(np.load(args.weights, allow_pickle=False))
    if "alphabet" in saved:
        a.require_same(alphabet.Alphabet(tuple(saved.pop("alphabet").tolist())))
    mode = str(saved.pop("mode")) if "mode" in saved else args.mode
    return a, saved, mode


def _samples_shown(df: DataFrame, key: str, show: int) -> None:
    """Prints the first row and others at an even stride: reference and output, 70 characters of each."""
    at = strided(df, [F.col(key)], show)
    rest = [c for c in df.columns if c not in (key, "ref", "pred")]
    at.select(key, *rest, F.substring("ref", 1, 70).alias("ref"), F.substring("pred", 1, 70).alias("pred")).orderBy(key).show(2 * show + 1, False)


def evaluate(spark, args) -> DataFrame:
    """``--max-batches`` reads the first batches of ``--batch-size`` samples only, in the order of keys."""
    a, weights, mode = _model(args)
    s = _samples(spark, args).where((_bands(args) == args.split) & a.covers(F.col("text")))
    if args.max_batches:
        first = batches(s.select("key"), [F.col("key")], args.batch_size, True, max_batches=args.max_batches).select("key").distinct()
        s = s.join(first, "key", "left_semi")
    s = s.select("key", F.col("text").alias("ref"), "font", columns.decoded("png").alias("image")).where("image.data is not null")
    p = model.predict(s, "image", weights, a, args.img_h, args.img_w, mode).drop("image")
    p = _kept(spark, p, args.out)
    _samples_shown(p.select("key", "ref", "pred"), "key", args.show)
    return metrics.report(metrics.scored(p))


def _kept(spark, df: DataFrame, out: str | None) -> DataFrame:
    """Predictions are made once: written to ``out`` or to the shared folder."""
    if not out:
        return SharedTable(df).df
    df.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def eval_columns(spark, args) -> DataFrame:
    """Columns are tiled, tiles read and concatenated in order without separator, then scored. The report covers the
    segmentation's errors, too."""
    a, weights, mode = _model(args)
    t = imaging.tiles(columns.read_columns(spark, args.dir), "image", args.tile, args.window, args.least)
    p = model.predict(t.select("idx", "tile_no", (F.col("bottom") - F.col("top")).alias("height"), F.col("tile").alias("image")), "image", weights, a, args.img_h, args.img_w, mode)
    p = _kept(spark, p.drop("image"), args.out)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile_no", "pred"))), lambda x: x["pred"]), "")
    text = columns.read_columns(spark, args.dir).select("idx", F.col("text").alias("ref"))
    s = metrics.scored(p.groupBy("idx").agg(joined.alias("pred"), F.count("*").alias("n_tiles")).join(text, "idx"))
    s = s.withColumn("cer", F.col("norm_dist") / F.greatest("norm_len", F.lit(1)))
    for name, values in (("cer", s), ("n_tiles", s), ("height", p)):
        metrics.distribution(values, name).withColumn("of", F.lit(name)).show()
    _samples_shown(s.select("idx", "n_tiles", "cer", "ref", "pred"), "idx", args.show)
    return metrics.report(s)


def _cut_corpus(spark, args) -> DataFrame:
    """(n, src_no, line): the lines of a corpus, numbered in the order of their documents."""
    d = labels.scan_corpus(spark, args.corpus, args.min_doc)
    d = lines.document_numbers(d.select("text").distinct(), [F.xxhash64("text"), F.col("text")], min_doc=args.min_doc)
    cut = numbered(lines.segment(d, min_doc=args.min_doc), [F.col("src_no"), F.col("line_no")], "n")
    return cut if not args.max_lines else cut.where(F.col("n") < args.max_lines)


def plan_lines(spark, args) -> DataFrame:
    """Render tasks of lines: every line in each variant, with font and seed."""
    p = lines.render_plan(_cut_corpus(spark, args), F.col("n"), args.variants, args.fonts, args.seed)
    p.select("doc_id", "variant", "font_idx", "seed", "src_no", F.col("line").alias("text")).write.mode("overwrite").json(args.out)
    return spark.read.json(args.out).agg(F.count("*").alias("tasks"), F.count_distinct("src_no").alias("documents"))


def plan_pages(spark, args) -> DataFrame:
    """Render tasks of pages: consecutive lines, with the page's font and seed."""
    at = lines.pages(_cut_corpus(spark, args), "n", args.lines_min, args.lines_max, args.seed, args.max_pages, args.max_lines)
    text = F.transform(F.array_sort(F.collect_list(F.struct("slot", "line"))), lambda x: x["line"])
    p = at.groupBy("page").agg(text.alias("line_texts"), F.min("src_no").alias("src_no"))
    p.select(F.format_string("page_%06d", "page").alias("page_id"), (F.col("page") % args.fonts).alias("font_idx"), derive_seed(args.seed, F.col("page")).alias("seed"), "src_no", "line_texts").write.mode("overwrite").json(args.out)
    return spark.read.json(args.out).agg(F.count("*").alias("pages"), F.sum(F.size("line_texts")).alias("lines"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *positional, **options):
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x.rstrip("+"), nargs="+" if x.endswith("+") else None)
        for k, v in options.items():
            flag = "--" + k.replace("_", "-")
            if v is bool:
                c.add_argument(flag, action="store_true")
            elif isinstance(v, type):
                c.add_argument(flag, type=v, required=True)
            else:
                c.add_argument(flag, type=type(v[0]) if v[0] is not None else v[1], default=v[0])
        c.set_defaults(run=run)

    split = {"val": int, "test": int, "gap": (bands.GAP,), "tail": (None, int)}
    net = {"weights": str, "alphabet": str, "mode": ("mean",), "img_h": (1024,), "img_w": (64,)}
    command("build-alphabet", build_alphabet, "meta+", out=str, min_count=(1,), counts_in=(None, str), counts_out=(None, str))
    command("verify", verify, "shards+", alphabet=str, img_h=(1024,), window=(None, int), **split)
    command("extract", extract, "shards+", out=str, per_shard=(10_000,), alphabet=(None, str), **split)
    command("pack", pack, "meta+", images=str, out=str, shard_bytes=(1 << 30,), workers=(0,))
    command("lines", cut_lines, "corpus+", out=str, min_chars=(lines.MIN_CHARS,), max_chars=(lines.MAX_CHARS,), min_doc=(lines.MIN_DOC,))
    command("report", report, "predictions", by=(None, str), pairs=bool)
    command("build-columns", build_columns, "shards+", out=str, split=str, columns=(200,), lines_min=(40,), lines_max=(60,), line_gap=(20,), seed=(0,), **split)
    command("eval", evaluate, "shards+", split=str, out=(None, str), max_batches=(None, int), batch_size=(64,), show=(15,), **net, **split)
    command("eval-columns", eval_columns, "dir", tile=(imaging.TILE,), window=(imaging.WINDOW,), least=(imaging.LEAST,), out=(None, str), show=(15,), **net)
    corpus = {"out": str, "min_doc": (lines.MIN_DOC,), "fonts": (1,), "seed": (0,), "max_lines": (None, int)}
    command("plan-lines", plan_lines, "corpus+", variants=(2,), **corpus)
    command("plan-pages", plan_pages, "corpus+", lines_min=(3,), lines_max=(7,), max_pages=(None, int), **corpus)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    args = parser().parse_args(argv)
    if spark is None:
        from glyphmill.session import session

        spark = session()
    got = args.run(spark, args)
    got.show(100, False)
    if args.command == "verify" and not got.first()["ok"]:
        sys.exit(1)
    return got


if __name__ == "__main__":
    main()
