"""Catalogue reads and table-to-table mutations of the library store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def search(items: DataFrame, term: str, columns: list[str], limit: int = 200, order: list | None = None) -> DataFrame:
    """LIKE %term%, the term not escaped: % and _ in it are wildcards."""
    test = F.lit(False)
    for c in columns:
        test = test | F.lower(c).like(f"%{term.lower()}%")
    out = items.filter(test)
    return (out.orderBy(*order) if order else out).limit(limit)


def contains(items: DataFrame, term: str, columns: list[str]) -> DataFrame:
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(F.lower(c), F.lit(term.lower()))
    return items.filter(test)


def facets(items: DataFrame, columns: list[str]) -> DataFrame:
    """Total and counts by each column in one pass; null is "(none)"."""
    sets = [F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("value")) for c in columns]
    total = F.struct(F.lit("total").alias("facet"), F.lit("").alias("value"))
    return items.select(F.explode(F.array(total, *sets)).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def page(df: DataFrame, order: list, limit: int | None, offset: int = 0, most: int = 1000, default: int = 200) -> DataFrame:
    """An ordered page: limit clamped to 1..most, offset at least 0."""
    size = default if limit is None else min(max(limit, 1), most)
    return df.orderBy(*order).offset(max(offset, 0)).limit(size)


def optional(column: str, value) -> Column:
    """column = value, or true where no value is asked for."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def full_merge(sources: list[DataFrame], key: str, columns: list[str], trash: DataFrame) -> DataFrame:
    """Full outer merge by key, earlier sources first for each column; trashed
    keys leave, and come back as the trash has them."""
    out = sources[0].select(key, *columns)
    for s in sources[1:]:
        b = s.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
        out = out.join(b, F.col(key) == F.col("_k"), "full_outer").select(F.coalesce(key, "_k").alias(key), *[F.coalesce(c, f"_{c}").alias(c) for c in columns])
    live = out.join(trash.select(key), key, "left_anti").withColumn("trashed", F.lit(False))
    return live.unionByName(trash.select(key, *columns).withColumn("trashed", F.lit(True)))


def both_sides(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys only left, only right, or on both sides."""
    a, b = left.select(*key).distinct().withColumn("_l", F.lit(True)), right.select(*key).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_r").isNull(), "left only").when(F.col("_l").isNull(), "right only").otherwise("both")
    return a.join(b, key, "full_outer").select(*key, side.alias("side"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old: list[str] = (), newer: str | None = None) -> DataFrame:
    """Rows of both; of a key on both sides the new row, except that columns
    in ``keep_old`` keep an old value that isn't null, and with ``newer`` the
    old row stays unless the new one's value is greater."""
    names = [c for c in old.columns if c not in key]
    n = new.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_in"))
    o = old.withColumn("_was", F.lit(True))
    j = o.join(n, [F.col(k) == F.col(f"_{k}") for k in key], "full_outer")
    take = F.col("_in").isNotNull()
    if newer is not None:
        take = take & (F.col("_was").isNull() | (F.col(f"_{newer}") > F.col(newer)))
    value = lambda c: F.when(take, F.coalesce(c, f"_{c}") if c in keep_old else F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(*[F.coalesce(k, f"_{k}").alias(k) for k in key], *map(value, names))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list | None = None) -> DataFrame:
    """Rows of both; of a key that is there the old row stays, of one that
    comes twice the first by ``order`` (by all columns if not given)."""
    w = W.partitionBy(*key).orderBy(*(order or new.columns))
    once = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return old.unionByName(once.join(old, key, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """New child rows replace all of their parents' old ones."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def immutable_violations(old: DataFrame, new: DataFrame, key: list[str], facts: list[str], evidence: list[str]) -> DataFrame:
    """Keys whose facts differ, or whose evidence changes from a value: nulls
    may be filled."""
    n = new.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(c).alias(f"_{c}") for c in [*facts, *evidence]])
    j = old.join(n, [F.col(k) == F.col(f"_{k}") for k in key])
    bad = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in facts] + [F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in evidence]
    return j.select(*key, F.array_compact(F.array(*bad)).alias("changed")).filter(F.size("changed") > 0)


def decision_merge(decisions: DataFrame, severities: list[str], resolutions: list[str]) -> DataFrame:
    """One row for each decision: the highest severity and resolution, the
    first values that aren't null, all evidence."""
    rank = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return decisions.groupBy("decision_id").agg(
        F.max_by("severity", rank("severity", severities)).alias("severity"), F.max_by("resolution", rank("resolution", resolutions)).alias("resolution"),
        first("local_value"), first("cloud_value"), F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"),
    )


def revisions(changes: DataFrame, key: str, order: list) -> DataFrame:
    """Revision numbers from 1 and whether a row is the current one."""
    w = W.partitionBy(key)
    return changes.withColumn("revision_no", F.row_number().over(w.orderBy(*order))).withColumn("current", F.col("revision_no") == F.count("*").over(w))


def supersede(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The newest row of a destination is published, others superseded."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("state", F.when(n == 1, "published").otherwise("superseded"))


def exclusive(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that should be unique and aren't."""
    return rows.groupBy(*key).count().filter("count > 1")


def islands(rows: DataFrame, key: str, n: str) -> DataFrame:
    """Consecutive runs of numbers of each key."""
    r = rows.select(key, n).distinct().withColumn("_g", F.col(n) - F.row_number().over(W.partitionBy(key).orderBy(n)))
    return r.groupBy(key, "_g").agg(F.min(n).alias("first"), F.max(n).alias("last")).drop("_g")


def page_ranges(rows: DataFrame, key: str, n: str) -> DataFrame:
    """Runs as text: "1–4、6"."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("–", F.col("first").cast("string"), F.col("last").cast("string")))
    pairs = F.array_sort(F.collect_list(F.struct("first", one.alias("t"))))
    return islands(rows, key, n).groupBy(key).agg(F.array_join(F.transform(pairs, lambda p: p["t"]), "、").alias("ranges"))


def gap_islands(rows: DataFrame, key: str, order: str, gap: float) -> DataFrame:
    """Split the ordered rows of a key where the step exceeds ``gap``."""
    w = W.partitionBy(key).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def carry_forward(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def multiset_common(left: DataFrame, right: DataFrame, key: list[str], item: str) -> DataFrame:
    """Sum over items of the smaller count, the larger less the smaller."""
    a = left.groupBy(*key, item).agg(F.count("*").alias("_a"))
    b = right.groupBy(*key, item).agg(F.count("*").alias("_b"))
    j = a.join(b, [*key, item], "full_outer").na.fill(0, ["_a", "_b"])
    return j.groupBy(*key).agg(
        F.sum(F.least("_a", "_b")).alias("common"), F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).alias("added"),
        F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))).alias("removed"), F.sum(F.abs(F.col("_a") - F.col("_b"))).alias("symdiff"),
    )


def _dyadic(low: Column, high: Column, bits: int) -> Column:
    """The largest aligned ranges that make up low..high: two at most of each
    size, as structs of level (a range holds 2^level numbers) and node."""
    start = F.struct(low.alias("a"), high.alias("b"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        left, right = (s["a"] <= s["b"]) & (s["a"] % 2 == 1), (s["a"] <= s["b"]) & (s["b"] % 2 == 0)
        node = lambda c: F.struct(level.alias("level"), c.alias("node"))
        picked = F.array_compact(F.array(F.when(left, node(s["a"])), F.when(right & ~(left & (s["a"] == s["b"])), node(s["b"]))))
        a, b = F.when(left, s["a"] + 1).otherwise(s["a"]), F.when(right, s["b"] - 1).otherwise(s["b"])
        # A range that is used up stays so: its ends are moved past each other.
        done = a > b
        return F.struct(F.when(done, F.lit(1).cast("long")).otherwise(F.shiftright(a, 1)).alias("a"), F.when(done, F.lit(0).cast("long")).otherwise(F.shiftright(b, 1)).alias("b"), F.concat(s["out"], picked).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits)), start, step, lambda s: s["out"])


def range_assign(numbers: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """The first segment, in order, whose bounds hold a number.

    Bounds are cut into aligned ranges of powers of two and of each range only
    the first segment is kept; a number looks up the range of each size that it
    lies in. Rows grow with the logarithm of the numbers and not with the
    product of a key's numbers and segments, and no key is one task.
    """
    n = numbers.select(key, F.col("number").cast("long").alias("number"))
    top = n.agg(F.max("number").alias("high"), F.min("number").alias("low")).first()
    base, limit = top["low"] or 0, top["high"] or 0
    bits = max(1, (limit - base).bit_length())
    low, high = F.greatest(F.col("low").cast("long"), F.lit(base)) - base, F.least(F.col("high").cast("long"), F.lit(limit)) - base
    cut = segments.select(key, "segment", low.alias("a"), high.alias("b")).filter("a <= b")
    nodes = cut.select(key, "segment", F.explode(_dyadic(F.col("a"), F.col("b"), bits)).alias("d")).groupBy(key, "d.level", "d.node").agg(F.min("segment").alias("segment"))
    at = F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("number") - base, k).alias("node")))
    asked = n.select(key, "number", F.explode(at).alias("d")).select(key, "number", "d.level", "d.node")
    found = asked.join(nodes, [key, "level", "node"], "left").groupBy(key, "number").agg(F.min("segment").alias("segment"))
    return found.withColumn("number", F.col("number").cast(numbers.schema["number"].dataType))


def set_coverage(declared: Column, actual: Column) -> Column:
    missing, extra = F.array_except(declared, actual), F.array_except(actual, declared)
    return F.when((F.size(declared) == 0) | declared.isNull(), "undetermined").when((F.size(missing) == 0) & (F.size(extra) == 0), "complete").otherwise("missing")


def assign_answers(numbers: DataFrame, segments: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """Numbers with their segment; a document of which under ``least`` of the
    numbers find one falls back to whole pages: no segment at all."""
    placed = range_assign(numbers, segments, key)
    share = placed.groupBy(key).agg((F.count("segment") / F.count("*")).alias("_s"))
    return placed.join(share, key).select(key, "number", F.when(F.col("_s") >= least, F.col("segment")).alias("segment"))
