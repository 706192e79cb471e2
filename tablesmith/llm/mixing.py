"""Mixing sources to target weights by Sainte-Lague apportionment of equal word blocks.

Sizes are words. Each source's target is its weight's share of all words, at most
`max_repeat` times its size; what is above that is shared again by weight. The blocks of
`block_words` words are given to sources by the highest quotients target / (2 j + 1), the
source's blocks to its shards in the same way, and inside a shard the documents stand in
an order drawn from the seed: the quota is taken from the front, whole passes first.

Shards hold about `shard_words` words each, so a source with a third of all rows is split
into many; only one row per shard and per source takes part in the apportionment.

Defined results: a NULL or empty text has size 0 and is taken 0 times; a NULL source is a
source of its own, after all others; equal rows are separate documents; an empty table
gives an empty result. Columns other than the three named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import WORD, text_of

WEIGHTS = (1.0, 2.0, 3.0)


def source_targets(sources: DataFrame, weights: tuple[float, ...], max_repeat: int) -> DataFrame:
    """(src, source_size, target): one row per source in, one out. Sources are few; one task orders them."""
    by_source = Window.orderBy("src")
    everything = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    # fill all sources to one level; those whose cap lies below the level stop at it
    fill = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("capped", F.col("cap") / F.col("w") <= level)
    free = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    return s.select("src", "source_size", "total",
                    F.when(F.col("capped"), F.col("cap")).otherwise(left * F.col("w") / free).alias("target"))


def sainte_lague(parts: DataFrame, within: list[str], order: str, votes: str, seats: Column, out: str) -> DataFrame:
    """Add `out`: each row's seats, `seats` in all for each `within`, by the highest quotients votes / (2 j + 1).

    Seats that no choice of the last ones can change are given at once; only the quotients
    around the limit are ranked, about two for each row.
    """
    group = Window.partitionBy(*(within or [F.lit(0)]))
    m, total = F.count("*").over(group), F.sum(votes).over(group)
    p = parts.withColumn("_n", seats).withColumn("_m", m).withColumn("_v", total)
    sure = F.floor(F.col(votes) * F.greatest(F.col("_n") - F.col("_m") / 2 - 1, F.lit(0.0)) / F.col("_v") + 0.5)
    most = F.floor(F.col(votes) * (F.col("_n") + F.col("_m") / 2 + 1) / F.col("_v") + 0.5)
    none = (F.col("_v") <= 0) | (F.col("_n") <= 0)
    p = p.withColumn("_sure", F.when(none, 0).otherwise(F.when(F.col("_n") <= F.col("_m") / 2 + 1, 0).otherwise(sure)).cast("long"))
    p = p.withColumn("_most", F.when(none, 0).otherwise(most).cast("long"))
    p = p.withColumn("_open", F.col("_n") - F.sum("_sure").over(group))
    q = p.withColumn("_j", F.explode(F.sequence(F.col("_sure"), F.col("_most"))))
    high = Window.partitionBy(*(within or [F.lit(0)])).orderBy(
        (F.col(votes) / (2 * F.col("_j") + 1)).desc(), order, "_j")
    won = (F.row_number().over(high) <= F.col("_open")) & (F.col("_j") < F.col("_most"))
    q = q.withColumn("_won", won.cast("long"))
    keep = parts.columns
    return q.groupBy(*keep).agg((F.max("_sure") + F.sum("_won")).alias(out))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3, block_words: int = 64,
        shard_words: int = 4_000_000, seed: int = 17, doc_id: str = "doc_id", source: str = "source",
        text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), and `keep`."""
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name")).alias("src"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(source), F.col(text)).alias("draw"), *keep)
    per_source = source_targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    per_source = sainte_lague(per_source, [], "src", "target",
                              F.round(F.col("total") / block_words).cast("long"), "blocks")
    per_source = per_source.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    d = sized.join(per_source, "src").withColumn("shard", F.pmod("draw", "shards"))
    shards = d.groupBy("src", "shard", "blocks").agg(F.sum("size").alias("shard_size"))
    quota = sainte_lague(shards, ["src", "blocks"], "shard", "shard_size", F.col("blocks"), "quota")
    quota = quota.select("src", "shard", "shard_size", "quota")
    words = F.least(F.col("quota") * block_words, F.col("shard_size") * max_repeat)
    d = d.join(quota, ["src", "shard"])
    d = d.withColumn("passes", F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0))
    d = d.withColumn("rest", words - F.col("passes") * F.col("shard_size"))
    drawn = Window.partitionBy("src", "shard").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("ahead", F.coalesce(F.sum("size").over(drawn), F.lit(0)))
    part = F.least(F.greatest(F.col("rest") - F.col("ahead"), F.lit(0)), F.col("size"))
    return d.select("doc_id", "size", "source_size", "target",
                    (F.col("passes") * F.col("size") + part).cast("long").alias("taken"), *keep)
