"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sizes are summed by source; weights give targets, and no target exceeds ``most_repeats`` times its source's size:
   the excess is shared again by weight among the others until nothing is above its cap.
2. The mix has ``total / block`` blocks. Highest quotients (target / 1, 3, 5, ...) give them to sources. The method
   adds one block at a time without ever taking one back, so the blocks of output shard h are those between the
   allocations of h and h + 1 shards' worth: integer quotas for each shard that add up to the whole allocation. A block
   has ``block`` words, or less where the smallest source would have fewer than ``least_blocks`` of them.
3. Each source's documents are laid end to end in a seeded order and cut into blocks. A source with q blocks to give
   out of n takes block j as often as floor((j + 1) q / n + u) - floor(j q / n + u), u seeded: exactly q in all, at
   most ceil(q / n) times one. What a document gives follows from its place by arithmetic; no block becomes a row.

Documents are laid out by ranges of a seeded hash: a range has an equal share of any source, a hot one too, and
places follow from sums of the ranges before. So no task holds a source. Only sums by source, one row each, pass
through one task, and sums by range, a row for each ``range_rows`` rows of the input or ``ranges`` a source.
Rows that agree in id and size are told apart by a hash of their text, so reruns agree in texts as well.

Null sources are a source of their own, after all others. Null or blank texts have size 0 and give nothing. Repeated
rows are documents of their own. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.llm.shared import cut, whole_row


@dataclass(frozen=True)
class Mix:
    weights: Sequence[float] = (5, 2, 1)  # of sources in code point order, repeating
    block: int = 32  # words
    least_blocks: int = 16  # of the smallest source: blocks are shorter where it would have fewer
    shards: int = 16  # output shards, each with its integer quotas
    most_repeats: int = 3
    ranges: int = 1024  # ranges of the seeded order in each source, at least
    range_rows: int = 65_536  # and as many as give this number of rows a range when one source holds all
    seed: int = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """From (source, source_size): adds pos, weight and target. One row a source, so these windows stay small.

    The common level L solves sum(least(cap, L * weight)) = total. In the order of cap / weight, a source is capped if
    its own cap is reached at the level that would hold if it and all after it were not.
    """
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.orderBy(F.col("source").isNull(), "source")
    by_ratio = W.orderBy("ratio", "pos")
    k = len(mix.weights)
    weighed = (
        sizes.withColumn("pos", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), F.pmod("pos", F.lit(k)) + 1))
        .withColumn("cap", F.col("source_size") * float(mix.most_repeats))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
    )
    level = (
        weighed.withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_after", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weights_after"))
        .withColumn("free", F.col("ratio") > F.col("level"))
        .withColumn("common", F.max(F.when(F.col("free"), F.col("level"))).over(every))
    )
    return level.withColumn("target", F.when(F.col("free"), F.col("common") * F.col("weight")).otherwise(F.col("cap"))).select("source", "source_size", "pos", "weight", "total", "target")


def apportion(targets: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Sainte-Laguë seats: adds n_blocks (of the source's stream) and, for each shard, the seats after it (seats[h]).

    Rounding target / d with d = total / blocks is right up to few seats, at most one for two sources. The highest
    quotients that wait, or the lowest that were given, settle those; both lists have a few rows a source.
    """
    every = W.partitionBy("h").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    house = F.floor(F.floor(F.col("total") / mix.block + 0.5) * (F.col("h") + 1) / mix.shards)
    start = (
        targets.withColumn("n_blocks", F.ceil(F.col("source_size") / mix.block))
        .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(mix.shards - 1))))
        .withColumn("house", house)
        .withColumn("share", F.when(F.col("total") > 0, F.col("target") / F.col("total") * F.col("house")).otherwise(0.0))
        .withColumn("seats", F.floor(F.col("share") + 0.5))
        .withColumn("lacks", F.col("house") - F.sum("seats").over(every))
        .withColumn("sources", F.count(F.lit(1)).over(every))
    )
    # A source's next quotients: (share) / (2 seats + 1) and on; its last ones: share / (2 seats - 1) and back.
    step = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    changes = (
        start.filter(F.col("lacks") != 0)
        .select("*", step)
        .withColumn("divisor", F.when(F.col("lacks") > 0, 2 * (F.col("seats") + F.col("k")) + 1).otherwise(2 * (F.col("seats") - F.col("k")) - 1))
        .filter((F.col("divisor") > 0) & (F.col("share") > 0))
        .withColumn("quotient", F.when(F.col("lacks") > 0, -F.col("share") / F.col("divisor")).otherwise(F.col("share") / F.col("divisor")))
        .withColumn("turn", F.row_number().over(W.partitionBy("h").orderBy("quotient", "pos", "k")))
        .filter(F.col("turn") <= F.abs("lacks"))
        .groupBy("h", "pos")
        .agg((F.count(F.lit(1)) * F.signum(F.first("lacks"))).cast("long").alias("change"))
    )
    settled = start.join(changes, ["h", "pos"], "left").withColumn("seats", F.least(F.col("seats") + F.coalesce("change", F.lit(0)), mix.most_repeats * F.col("n_blocks")))
    return settled.groupBy("source", "source_size", "pos", "target", "n_blocks").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "seats"))), lambda x: x["seats"].cast("long")).alias("seats"))


def mix_documents(docs: DataFrame, mix: Mix = Mix(), *, size: Column | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Places every document in its source's stream and says what the mix takes of it.

    The columns ``keep`` (None: all) in the struct doc, then size, source_size, target, taken (words, repeats
    counted), place (words of its source before it), n_blocks, quota (the source's blocks in the mix), turn (the seed
    of its block choice), quotas (the source's blocks by output shard) and block (the words of a block).
    """
    kept = whole_row(keep)
    span = -(-(1 << 32) // max(mix.ranges, docs.count() // mix.range_rows))
    words = word_count(F.col(text)) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    content = F.xxhash64(F.col(text).cast("string") if text in docs.columns else F.lit(None))
    rows = docs.select(kept, F.col(source).cast("string").alias("source"), F.col(doc_id).alias("id"), words.alias("size"), content.alias("content"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(mix.seed), F.col("id"), F.col("size"), F.col("content")))
    rows = rows.withColumn("range", F.floor(F.pmod("order", F.lit(1 << 32)) / span).cast("int"))
    sums = cut(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    sizes = sums.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    least = sizes.filter("source_size > 0").agg(F.min("source_size")).first()[0] or 0
    mix = replace(mix, block=max(1, min(mix.block, least // mix.least_blocks)))
    plan = cut(apportion(source_targets(sizes, mix), mix))
    before = W.partitionBy("s.source").orderBy("s.range").rowsBetween(W.unboundedPreceding, -1)
    last = F.element_at("seats", -1)
    ranges = (
        sums.alias("s")
        .join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
        .select(
            F.col("s.source").alias("of"), F.col("s.range").alias("in_range"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_place"),
            "source_size", "target", "n_blocks", last.alias("quota"), F.pmod(F.xxhash64(F.lit(mix.seed + 1), "pos"), F.greatest("n_blocks", F.lit(1))).alias("turn"),
            F.transform("seats", lambda x, i: x - F.when(i > 0, F.element_at("seats", i)).otherwise(0)).alias("quotas"),
        )
    )
    placed = rows.join(ranges, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in_range")))
    in_range = W.partitionBy("source", "range").orderBy("order", "id", "size", "content").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("place", F.col("range_place") + F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    taken = taken_before(F.col("place") + F.col("size"), mix) - taken_before(F.col("place"), mix)
    return placed.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long")).select("doc", "size", "source_size", "target", "taken", "place", "n_blocks", "quota", "turn", "quotas", F.lit(mix.block).alias("block"))


def picks_before(block: Column) -> Column:
    """How often blocks before this one are taken, all together. Whole numbers of 64 bits do while blocks times quota stay
    below 2^62; sources beyond that take decimals."""
    n, quota, turn = F.greatest("n_blocks", F.lit(1)), F.col("quota"), F.col("turn")
    product = block * quota + turn
    fits = (n.cast("double") + 1) * (F.greatest(quota, F.lit(1)).cast("double") + 1) < 2.0**62
    wide = block.cast("decimal(20,0)") * quota.cast("decimal(17,0)") + turn.cast("decimal(20,0)")
    exact = F.floor((wide - F.pmod(wide, n.cast("decimal(20,0)"))) / n.cast("decimal(20,0)") + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    return F.when(fits, F.call_function("div", product, n)).otherwise(exact)


def taken_before(place: Column, mix: Mix) -> Column:
    """Words taken of a stream's words before a place."""
    block = F.floor(place / mix.block)
    whole = picks_before(block) - picks_before(F.lit(0))
    here = picks_before(block + 1) - picks_before(block)
    return whole * mix.block + here * (place - block * mix.block)


def mixed_texts(docs: DataFrame, mix: Mix = Mix(), *, text: str = "text") -> DataFrame:
    """The mix itself, in the columns of docs: a document comes once for each time that all of it is taken, and a
    document of which the mix takes some blocks once more comes once again with these blocks, each as it stands in the text:
    its words with the blanks and line breaks behind them. A document of size 0 is never taken."""
    m = mix_documents(docs, mix, text=text)
    size = F.col("block")
    first, final = F.floor(F.col("place") / size), F.floor((F.col("place") + F.col("size") - 1) / size)
    blocks = F.transform(F.sequence(first, final), lambda b: F.struct(b.alias("b"), (picks_before(b + 1) - picks_before(b)).alias("times")))
    times = F.transform("blocks", lambda x: x["times"])
    words = F.when(F.col("least") < F.col("most"), F.regexp_extract_all(F.col(f"doc.`{text}`"), F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), F.lit(0)))
    taken = m.filter("taken > 0").withColumn("blocks", blocks).withColumn("most", F.array_max(times)).withColumn("least", F.array_min(times))
    # The words are cut below the explosion, so that Spark can't move the cutting into the loop over blocks.
    passes = taken.withColumn("words", words).withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("most"))))
    passes = passes.withColumn("parts", F.filter("blocks", lambda x: x["times"] >= F.col("pass")))

    def slice_of(b):
        begin = F.greatest(b["b"] * size - F.col("place"), F.lit(0))
        end = F.least((b["b"] + 1) * size - F.col("place"), F.col("size"))
        return F.slice("words", (begin + 1).cast("int"), (end - begin).cast("int"))

    some = F.array_join(F.flatten(F.transform("parts", slice_of)), "")
    new = F.when(F.col("pass") <= F.col("least"), F.col(f"doc.`{text}`")).otherwise(some).alias(text)
    return passes.select(*[new if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
