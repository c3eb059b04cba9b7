"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight and a linear schedule over training time t in
[0, 1]: rate(t) = target * (1 + slope * (2t - 1)). Its integral is the
cumulative token demand D(t) = target * (t + slope * (t^2 - t)), and D(1) is
the target whatever the slope. The documents of a source, in the order of a
hash of their id and repeated for whole epochs where the target exceeds the
source, are laid on that demand: the pass that starts at cumulative token c
gets the position t with D(t) = c, in closed form. A range sort by position
gives the training order.

Targets are shares of ``budget`` times all sizes by weight, stopped at
``most_repeats`` times the source's size; the excess is shared again by
weight until none is above. That fixed point is min(cap, level * weight) for
one level, found from running sums over the sources in the order of
cap / weight.

Running sums over documents never put a source in one task: the hash order is
cut into prefix buckets, bucket sums give each bucket its offset, and windows
run inside (source, bucket) only.

Defined cases: a null text or one without words has size 0, takes 0 and sits
at its neighbours' position; a null source is a source of its own, the last;
an empty table gives an empty result; repeated rows count as documents; a row
without an id is dealt by its text, and rows of one id and size come by their
text; a new column whose name the table has gets an underscore.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm._shared import SPACE, free


def with_sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digits: int = 2, name: str = "__m") -> DataFrame:
    """``docs`` with a struct ``name``: size in words, order key and bucket."""
    n = F.size(F.array_remove(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACE + "+"), "")).cast("long")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Rows without an id are dealt by their text, and rows of one id by it too.
    key = F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), t))
    return docs.withColumn(name, F.struct(n.alias("size"), key.alias("key"), F.substring(key, 1, digits).alias("bucket"), F.xxhash64(t).alias("tie")))


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    slopes: tuple[float, ...] = (0.5, 0.0, -0.5),
    budget: float = 1.5,
    most_repeats: float = 2.0,
) -> DataFrame:
    """(source, source_size) to the same with target and slope.

    One row per source: the windows here run over sources, not documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = lambda values: F.element_at(F.array(*map(F.lit, values)), ((F.col("rank") - 1) % len(values) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(order))
    s = s.withColumn("weight", cycle(weights)).withColumn("slope", cycle(slopes)).withColumn("cap", F.col("source_size") * F.lit(float(most_repeats)))
    everything = W.partitionBy(F.lit(1))
    filling = W.partitionBy(F.lit(1)).orderBy("fill", "rank").rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(filling), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(filling), F.lit(0.0)))
        .withColumn("level", (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level"))).over(everything)["level"])
    )
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))
    return s.select("source", "source_size", target.alias("target"), "slope")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    slopes: tuple[float, ...] = (0.5, 0.0, -0.5),
    budget: float = 1.5,
    most_repeats: float = 2.0,
    docs_a_bucket: int = 20_000,
    name: str = "mix",
) -> DataFrame:
    """``docs`` with a struct ``name``: size, source_size, target, start, taken, slope."""
    n = docs.count()
    digits = max(2, math.ceil(math.log(max(1, n / docs_a_bucket), 16)))
    name = free(docs.columns, name)
    # Working columns, named as none of the table's is.
    m, src, key, none, bucket, own, begin = (free([*docs.columns, name], f"__{x}") for x in ("m", "source", "key", "none", "bucket", "own", "begin"))
    sized = with_sizes(docs, text, doc_id, digits, m).withColumn(src, F.col(f"`{source}`"))
    buckets = sized.groupBy(F.col(src).alias("source"), F.col(f"{m}.bucket").alias("bucket")).agg(F.sum(f"{m}.size").alias("n"))
    totals = source_targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, slopes, budget, most_repeats)
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        buckets.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .alias("b")
        .join(totals.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select(F.coalesce(F.col("b.source"), F.lit("")).alias(key), F.col("b.source").isNull().alias(none), F.col("bucket").alias(bucket), F.struct("offset", "source_size", "target", "slope").alias(own))
    )
    keyed = sized.withColumns({key: F.coalesce(src, F.lit("")), none: F.col(src).isNull(), bucket: F.col(f"{m}.bucket")})
    inside = W.partitionBy(key, none, bucket).orderBy(f"{m}.key", F.col(f"`{doc_id}`"), f"{m}.size", f"{m}.tie").rowsBetween(W.unboundedPreceding, -1)
    run = keyed.withColumn(begin, F.coalesce(F.sum(f"{m}.size").over(inside), F.lit(0)))
    whole, size, total = F.floor(f"{own}.target"), F.col(f"{m}.size"), F.col(f"{own}.source_size")
    start = F.col(f"{own}.offset") + F.col(begin)
    # Full passes over the source, then the pass that the target cuts.
    passes = F.when(total > 0, F.floor(whole / total)).otherwise(0)
    rest = F.when(total > 0, whole - passes * total).otherwise(0)
    taken = passes * size + F.least(F.greatest(rest - start, F.lit(0)), size)
    fields = F.struct(size.alias("size"), total.alias("source_size"), F.col(f"{own}.target").alias("target"), start.alias("start"), taken.cast("long").alias("taken"), F.col(f"{own}.slope").alias("slope"))
    return run.join(offsets, [key, none, bucket]).withColumn(name, fields).drop(m, src, key, none, bucket, own, begin)


def position(consumed, target, slope):
    """The t in [0, 1] at which the cumulative demand of a source is ``consumed``."""
    share = F.when(target > 0, F.least(consumed / target, F.lit(1.0))).otherwise(F.lit(0.0))
    b = 1 - slope
    return F.when(slope == 0, share).otherwise(F.abs((F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope)))


def curriculum(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """One row per pass over a document that takes words, in training order.

    Adds ``epoch`` (0 first), ``taken`` (words of this pass; less than the
    size only for the one document of each source that the target cuts) and
    ``position``. Sorted by ranges of position.
    """
    name = free(docs.columns, "__mix")
    epoch, taken, place = (free([*docs.columns, name], x) for x in ("epoch", "taken", "position"))
    of = lambda c: F.col(f"{name}.{c}")
    m = mix(docs, doc_id=doc_id, name=name, **how).filter(of("taken") > 0)
    passes = F.ceil(of("taken") / of("size"))
    m = m.withColumn(epoch, F.explode(F.sequence(F.lit(0), (passes - 1).cast("int"))))
    at = of("start") + F.col(epoch) * of("source_size")
    words = F.least(of("size"), of("taken") - F.col(epoch) * of("size"))
    m = m.withColumn(taken, words).withColumn(place, position(at, of("target"), of("slope"))).drop(name)
    return m.orderBy(place, F.col(f"`{doc_id}`"), epoch)
