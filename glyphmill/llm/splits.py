"""Splits that keep related records together.

Method: works (src_doc) that hold a line of the same look are linked to the smallest work that holds
it; hash-to-min finds the components: each round every node sends its cluster to the cluster's
minimum and the minimum to the cluster, until nothing changes. Clusters are rows, not arrays, so a
component that holds a third of all works is spread over tasks. Weighted rendezvous hashing then
assigns components: every split draws -weight / ln(uniform hash of component and split), the largest
wins. The draw depends on the component, the weights and the seed only, so rows and components that are
added move no other; the price is that a component with a large share of the rows takes the shares with it
wherever it falls (``shares`` reports by how much; another seed draws anew).

Defined results: rows without src_doc join nothing; each look of their text is a unit of its own, and
those without text are a unit for each doc_id. Null, empty and stock texts join nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.look import look_column
from glyphmill.tables import SharedTable


def look_key(column: str = "look") -> list[Column]:
    """128 bits of a look."""
    return [F.xxhash64(F.col(column)).alias("k1"), F.xxhash64(F.lit(7), F.col(column)).alias("k2")]


def looks(df: DataFrame, stock: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``df`` whose text is neither null, empty nor of a stock line's look, with ``look``."""
    some = look_column(df.where(F.col(text).isNotNull() & (F.col(text) != "")), text, "look")
    headers = look_column(stock.select(F.col("text")).where("text is not null and text <> ''"), "text", "look").select("look").distinct()
    return some.join(headers, "look", "left_anti")


def shared_text_edges(meta: DataFrame, stock: DataFrame) -> DataFrame:
    """(src, dst): each work with the smallest work that holds one of its lines."""
    held = SharedTable(looks(meta.select("src_doc", "text").where("src_doc is not null").distinct(), stock).select("src_doc", *look_key()).distinct()).df
    several = held.groupBy("k1", "k2").agg(F.min("src_doc").alias("dst"), F.max("src_doc").alias("top")).where("dst < top").drop("top")
    return held.join(several, ["k1", "k2"]).where("src_doc <> dst").select(F.col("src_doc").alias("src"), "dst").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): hash-to-min over links (src, dst) of integers; component is the smallest
    node. Nodes of no link don't occur. Self-links and repeated links change nothing."""
    def at(a: Column, b: Column) -> Column:
        return F.struct(a.alias("node"), b.alias("member"))

    def print_of(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(node, member))")).first())

    e = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).where("src is not null and dst is not null")
    first = e.select(F.inline(F.array(at(F.col("src"), F.col("dst")), at(F.col("dst"), F.col("src")), at(F.col("src"), F.col("src")), at(F.col("dst"), F.col("dst"))))).distinct()
    state = SharedTable(first)
    before = print_of(state.df)
    for _ in range(max_rounds):
        least = state.df.groupBy("node").agg(F.min("member").alias("m"))
        sent = state.df.join(least, "node").select(F.inline(F.array(at(F.col("m"), F.col("member")), at(F.col("member"), F.col("m"))))).distinct()
        new = SharedTable(sent)
        now = print_of(new.df)
        state.drop()
        state = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    return state.df.groupBy("node").agg(F.min("member").alias("component"))


def _uniform(*of: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") + 0.5) / float(1 << 53)


def rendezvous(unit: Column, weights: dict[str, float], seed: int = 0) -> Column:
    """The split of a unit: the largest of -weight / ln(uniform(unit, split))."""
    live = {s: w for s, w in weights.items() if w > 0}
    if not live:
        raise ValueError("no split has a weight")
    return F.greatest(*[F.struct((F.lit(-float(w)) / F.log(_uniform(F.lit(seed), unit, F.lit(s)))).alias("draw"), F.lit(s).alias("split")) for s, w in live.items()])["split"] if len(live) > 1 else F.lit(next(iter(live)))


def assign_splits(meta: DataFrame, stock: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Every row of ``meta`` with ``unit`` (its component, or what stands for it) and ``split``."""
    if not math.isclose(sum(shares.values()), 1.0) or min(shares.values()) < 0:
        raise ValueError("shares must be positive and sum to one")
    comp = components(shared_text_edges(meta, stock)).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    of_work, alone = meta.where("src_doc is not null"), meta.where("src_doc is null")
    of_work = of_work.join(comp, of_work["src_doc"] == comp["_node"], "left").withColumn("unit", F.concat(F.lit("work:"), F.coalesce("_component", "src_doc").cast("string"))).drop("_node", "_component")
    look = F.concat(F.lit("look:"), F.sha2(F.when(F.col("_look") != "", F.col("_look")), 256))
    alone = look_column(alone, "text", "_look").withColumn("unit", F.coalesce(look, F.concat(F.lit("row:"), F.col("doc_id")), F.lit("row:"))).drop("_look")
    rows = of_work.unionByName(alone)
    return rows.withColumn("split", rendezvous(F.col("unit"), shares, seed))


def shares_of(assigned: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(split, n_rows, n_units, share, target, largest_unit): what each split of ``shares`` holds; largest_unit
    is the share of all rows in its largest unit."""
    spark = assigned.sparkSession
    units = assigned.groupBy("split", "unit").count()
    got = units.groupBy("split").agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_units"), F.max("count").alias("largest"))
    want = spark.createDataFrame(list(shares.items()), "split string, target double")  # a row a split
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(1)))  # over a row a split
    return want.join(got, "split", "left").select("split", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_units", F.lit(0)).alias("n_units"), (F.coalesce("n_rows", F.lit(0)) / total).alias("share"), "target", (F.coalesce("largest", F.lit(0)) / total).alias("largest_unit"))


def unit_report(assigned: DataFrame) -> DataFrame:
    """(kind, n_rows, n_units, n_torn): units by what ties them together (work, look, row) and how many of them
    stand in several splits."""
    u = assigned.groupBy("unit").agg(F.count("*").alias("n"), F.count_distinct("split").alias("s"))
    return u.groupBy(F.split("unit", ":")[0].alias("kind")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_units"), F.count_if(F.col("s") > 1).alias("n_torn"))
