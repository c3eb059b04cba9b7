"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed once and kept in the shared folder; equal ones are
one node. Two fingerprints within ``radius`` bits agree on at least
``blocks - radius`` of any ``blocks`` blocks, so every choice of that many
blocks is a table keyed by their bits, and a linked pair meets in one of them.
The number of blocks follows from the number of nodes, to keep the mean group
small. A group is compared in tiles: numpy exclusive-or and bit counts over
tile pairs, in the order of population count; a tile pair whose counts differ
by more than the radius is skipped. Groups above ``most`` nodes are dealt to
tile pairs over several tasks. A task gives back, instead of pairs, one edge
from each node to the smallest of its part, so a group of copies costs its
size; components come from those edges.

``near_copies`` is the same for a similarity of word shingles instead of a
radius. At 0.8 a 64-bit fingerprint is no more than a hint, so it takes 256
bits over sets of shingles: pairs at the similarity differ by 39 bits in the
mean and by 52 or less in 99 of 100 cases, unrelated ones by 128. Tables are
samples of as many bits as the number of nodes asks for, and as many of them
as bring ``recall`` of the pairs at the similarity together, more of those
above it. Pairs within the radius are verified on their texts: exactly. In a
first round a node meets its neighbours in the order of fingerprints in each
group; the components of those leave to the second round only pairs of
different components, so a group of copies costs its size.

Defined cases: a null, empty or blank text has the fingerprint zero, linked
like any other; a text under ``width`` words is one shingle; repeated rows
give one row each; a null id is never the smallest while there are others,
and a component of null ids has a null name; ties have no order to decide;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import components
from tallyloom.llm._shared import forget, free, materialise, parts_for
from tallyloom.llm.passages import Words, seeds

_PIECE = 1 << 14


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _PIECE):
        ones += np.unpackbits(h[i : i + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(n: int, radius: int = 4, most_mean: int = 2000) -> list[int]:
    """Bit masks of the tables: the fewest blocks that keep groups small."""
    blocks = radius + 1
    while blocks < 16 and n / 2 ** (64 * (blocks - radius) / blocks) > most_mean:
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(single, blocks - radius)]


def link_tiles(fp: np.ndarray, radius: int, tile: int = 256, against: int | None = None) -> np.ndarray:
    """For each fingerprint the index of the root of its part of the group.

    With ``against`` = k only pairs of one of the first k and one of the rest
    are compared (the halves of a tile pair of a split group)."""
    n = len(fp)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = np.argsort(np.bitwise_count(fp), kind="stable")
    sides = [order] if against is None else [order[order < against], order[order >= against]]
    left, right = sides[0], sides[-1]
    pops = np.bitwise_count(fp).astype(np.int64)
    for i in range(0, len(left), tile):
        a = left[i : i + tile]
        for j in range(i if against is None else 0, len(right), tile):
            b = right[j : j + tile]
            if pops[b[0]] - pops[a[-1]] > radius:
                break
            if pops[a[0]] - pops[b[-1]] > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= radius)
            if not len(x):
                continue
            u, v = root[a[x]], root[b[y]]
            pairs = np.unique((u[u != v].astype(np.int64) << 32) | v[u != v])
            for p in pairs.tolist():
                r, s = find(p >> 32), find(p & 0xFFFFFFFF)
                if r != s:
                    root[max(r, s)] = min(r, s)
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root[:] = up


def _edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(6)]
        t, v, lo, hi, side, fp = columns[:6]
        order = np.lexsort((side, hi, lo, v, t))
        t, v, lo, hi, side, fp = (c[order] for c in columns)
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (v[1:] != v[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        bounds = np.r_[new, len(t)]
        one, two = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a < 2:
                continue
            own = fp[a:b]
            roots = link_tiles(own.view(np.uint64), radius, against=None if lo[a] == hi[a] else int((side[a:b] == 0).sum()))
            linked = np.flatnonzero(roots != np.arange(b - a))
            one.append(own[linked])
            two.append(own[roots[linked]])
        if one:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two))], names=["a", "b"])

    return run


def near_edges(nodes: DataFrame, n: int, radius: int = 4, most: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span every component."""
    probes = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("v")) for i, m in enumerate(block_masks(n, radius))]))
    rows = nodes.select("fp", probes.alias("p")).select("p.t", "p.v", "fp")
    large = rows.groupBy("t", "v").count().filter(F.col("count") > most).select("t", "v", F.ceil(F.col("count") / most).cast("int").alias("n"))
    rows = rows.join(large, ["t", "v"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("t", "v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 100_000))
    return rows.repartition(parts, "t", "v", "lo", "hi").mapInArrow(_edges(radius), "a long, b long")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable."""
    fps = materialise(fingerprints(docs, doc_id, text, width), "simhash")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    edges = materialise(near_edges(nodes, nodes.count(), radius), "simhash-edges")
    roots = components.connected(edges)  # (node, root) of nodes that have an edge
    full = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = full.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = full.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


LONGS = 4  # of 64 bits in a wide fingerprint
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_WIDE = [f"f{i}" for i in range(LONGS)]


def shingles(known: Words, text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; one for fewer words."""
    words = known.of(text.encode()) if text else np.zeros(0, np.uint64)
    return seeds(words, min(width, len(words)), 1)[0] if len(words) else np.zeros(0, np.uint64)


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """A 256-bit SimHash of a set of shingle hashes, as four longs."""
    ones = np.zeros(64 * LONGS, np.int64)
    for i in range(0, len(s), _PIECE):
        h = s[i : i + _PIECE, None] * _MIX
        h ^= h >> np.uint64(32)
        h *= _MIX[::-1]
        ones += np.unpackbits((h ^ (h >> np.uint64(29))).view(np.uint8).reshape(-1, 8 * LONGS), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(s), bitorder="little").view("<u8")


def _wide(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            norms, fps = [], np.zeros((b.num_rows, LONGS), np.uint64)
            for i, text in enumerate(b.column(2)):
                t = text.as_py()
                norms.append(xxhash.xxh3_128_hexdigest(b" ".join((t or "").encode().lower().split())))
                fps[i] = wide_fingerprint(shingles(known, t, width))
            if len(known.known) > 1_000_000:
                known = Words()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(norms), *[pa.array(c) for c in fps.view(np.int64).T]], names=["doc_id", "sha", "norm", *_WIDE])

    return run


def sampled_bits(n: int, similarity: float, recall: float, mean: int = 16) -> np.ndarray:
    """Places of the bits of each table, for ``n`` nodes: groups of ``mean``
    unrelated nodes, and tables until ``recall`` of the pairs meet."""
    overlap = 2 * similarity / (1 + similarity)
    agree = 1 - np.arccos(min(1.0, overlap)) / np.pi
    bits = int(np.clip(np.ceil(np.log2(max(2, n) / mean)), 4, 60))
    tables = int(np.ceil(np.log(1 - recall) / np.log(1 - agree**bits)))
    draw = np.random.Generator(np.random.PCG64(11))
    return np.stack([np.sort(draw.choice(64 * LONGS, bits, replace=False)) for _ in range(max(1, tables))])


def wide_radius(similarity: float) -> int:
    """Bits by which pairs at ``similarity`` may differ, 2.3 deviations over."""
    p = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    return int(64 * LONGS * p + 2.3 * np.sqrt(64 * LONGS * p * (1 - p)))


def _tables(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in _WIDE], 1)
            each = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
            scale = np.int64(1) << np.arange(bits.shape[1], dtype=np.int64)
            for t, at in enumerate(bits):
                v = (each[:, at].astype(np.int64) * scale).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(v), b.column("id"), b.column("class"), *[b.column(c) for c in _WIDE]], names=["t", "v", "id", "class", *_WIDE])

    return run


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints along the last axis."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def cross_pairs(fp: np.ndarray, of: np.ndarray, radius: int, tile: int = 256, against: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group within the radius and of different classes, by tiles
    in the order of population count."""
    order = np.argsort(np.bitwise_count(fp).sum(axis=1), kind="stable")
    pops = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    left, right = (order, order) if against is None else (order[order < against], order[order >= against])
    one, two = [], []
    for i in range(0, len(left), tile):
        a = left[i : i + tile]
        for j in range(i if against is None else 0, len(right), tile):
            b = right[j : j + tile]
            if pops[b[0]] - pops[a[-1]] > radius:
                break
            if pops[a[0]] - pops[b[-1]] > radius:
                continue
            if of[a[0]] == of[b[0]] and (of[a] == of[a[0]]).all() and (of[b] == of[a[0]]).all():
                continue
            x, y = np.nonzero((_apart(fp[a][:, None], fp[b][None, :]) <= radius) & (of[a][:, None] != of[b][None, :]))
            one.append(a[x])
            two.append(b[y])
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def masks(bits: np.ndarray) -> np.ndarray:
    """The sampled bits of each table as a wide fingerprint."""
    on = np.zeros((len(bits), 64 * LONGS), np.uint8)
    np.put_along_axis(on, bits, 1, axis=1)
    return np.packbits(on, axis=1, bitorder="little").view("<u8")


def first_met(x: np.ndarray, y: np.ndarray, table: np.ndarray, of_table: np.ndarray) -> np.ndarray:
    """Whether the table of each pair is the first in which the two agree."""
    out = np.ones(len(x), bool)
    for i in range(0, len(x), _PIECE):
        agree = (((x[i : i + _PIECE] ^ y[i : i + _PIECE])[:, None, :] & of_table[None]) == 0).all(axis=2)
        out[i : i + _PIECE] = agree.argmax(axis=1) == table[i : i + _PIECE]
    return out


def _near(radius: int, ahead: int | None, of_table: np.ndarray):
    """Candidate pairs of ids: each node with the closest of the ``ahead`` next
    ones in the order of fingerprints in its group, or all of different
    classes. A pair is given by the first table that brings it together; what
    the first round so leaves out, the second has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        cols = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in ("t", "v", "lo", "hi", "side", "id", "class", *_WIDE)}
        order = np.lexsort([cols[c] for c in (*_WIDE[::-1], "side", "hi", "lo", "v", "t")])
        cols = {c: x[order] for c, x in cols.items()}
        fp = np.stack([cols[c].view(np.uint64) for c in _WIDE], 1)
        who, of = cols["id"], cols["class"]
        new = np.r_[True, np.any([cols[c][1:] != cols[c][:-1] for c in ("t", "v", "lo", "hi")], axis=0)]
        group = np.cumsum(new)
        one, two = [], []
        if ahead:
            best, to = np.full(len(who), radius + 1, np.int64), np.zeros(len(who), np.int64)
            for d in range(1, ahead + 1):
                a = np.flatnonzero(group[d:] == group[:-d])
                far = _apart(fp[a], fp[a + d])
                a, far = a[far < best[a]], far[far < best[a]]
                best[a], to[a] = far, a + d
            one.append(np.flatnonzero(best <= radius))
            two.append(to[one[0]])
        else:
            cut = np.r_[np.flatnonzero(new), len(who)]
            size = np.diff(cut)
            # Small groups of all tables at once, by the distance in order.
            small = (np.repeat(size, size) <= 64) & (cols["lo"] == cols["hi"])
            for d in range(1, min(64, int(size.max()))):
                a = np.flatnonzero((group[d:] == group[:-d]) & small[:-d] & (of[d:] != of[:-d]))
                a = a[_apart(fp[a], fp[a + d]) <= radius]
                one.append(a)
                two.append(a + d)
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if not small[s] and e - s > 1:
                    x, y = cross_pairs(fp[s:e], of[s:e], radius, against=None if cols["lo"][s] == cols["hi"][s] else int((cols["side"][s:e] == 0).sum()))
                    one.append(x + s)
                    two.append(y + s)
        x, y = (np.concatenate(side).astype(np.int64) if side else np.zeros(0, np.int64) for side in (one, two))
        met = first_met(fp[x], fp[y], cols["t"][x], of_table)
        x, y = who[x[met]], who[y[met]]
        if len(x):
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def _candidates(nodes: DataFrame, n: int, similarity: float, recall: float, ahead: int | None, most: int = 4096) -> DataFrame:
    """Pairs (a, b) of nodes (id, class, fingerprint) that may be near."""
    kinds = "id long, class long, " + ", ".join(f"{c} long" for c in _WIDE)
    bits = sampled_bits(n, similarity, recall)
    rows = nodes.select("id", "class", *_WIDE).mapInArrow(_tables(bits), "t int, v long, " + kinds)
    size = rows.groupBy("t", "v").agg(F.count("*").alias("size"), F.min("class").alias("least"), F.max("class").alias("greatest")).filter(F.col("size") > most)
    large = materialise(size.select("t", "v", F.ceil(F.col("size") / most).cast("int").alias("n"), (F.col("least") == F.col("greatest")).alias("one")), "near-large")
    rows = rows.join(large, ["t", "v"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    if ahead is None:  # large groups of one class are done
        rows = rows.filter(~F.coalesce("one", F.lit(False)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)) if ahead is None else F.col("own"))
    rows = rows.select("t", "v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "class", *_WIDE)
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 10_000))
    return materialise(rows.repartition(parts, "t", "v", "lo", "hi").mapInArrow(_near(wide_radius(similarity), ahead, masks(bits)), "a long, b long").distinct(), "near-pairs")


def _verified(width: int, similarity: float):
    """Pairs whose texts have the similarity: shingles in common over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = Words(), (None, None)
        for t in batches:
            ok = []
            for x, y in zip(t.column("x"), t.column("y")):
                x, y = x.as_py(), y.as_py()
                if x != last[0]:
                    last = (x, shingles(known, x, width))
                s, o = last[1], shingles(known, y, width)
                common = len(np.intersect1d(s, o, assume_unique=True))
                ok.append(common >= similarity * (len(s) + len(o) - common) - 1e-9)
            if len(known.known) > 1_000_000:
                known, last = Words(), (None, None)
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, recall: float = 0.97, few: int = 1 << 20) -> DataFrame:
    """(doc_id, sha, class_id, first): class_id is the smallest id reachable by
    near copies, ``first`` the one row text of the class that stays; ``sha`` is
    of the text as it stands, for ids that have several."""
    t = F.col(f"`{text}`")
    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.sha2(F.coalesce(t, F.lit("")), 256).alias("sha"), t.alias("text"))
    facts = materialise(named.mapInArrow(_wide(width), f"doc_id {kind}, sha string, norm string, " + ", ".join(f"{c} long" for c in _WIDE)), "near-facts")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")
    nodes = facts.groupBy("norm").agg(F.min(place).alias("at"), *[F.first(c).alias(c) for c in _WIDE])
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("id"), "norm", "at", *_WIDE), "near-nodes")
    n = nodes.count()

    def verified(pairs: DataFrame) -> DataFrame:
        # Only texts in pairs move; up to ``few`` of them by a broadcast list.
        asked = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-asked")
        wanted = nodes.join(F.broadcast(asked) if asked.count() <= few else asked, "id", "left_semi").select("id", "at.doc_id", "at.sha")
        wanted = materialise(wanted, "near-wanted")
        one = named.join(F.broadcast(wanted) if wanted.count() <= few // 8 else wanted, (named["doc_id"].eqNullSafe(wanted["doc_id"])) & (named["sha"] == wanted["sha"]))
        held = materialise(one.select("id", "text").dropDuplicates(["id"]), "near-texts")
        x, y = held.select(F.col("id").alias("a"), F.col("text").alias("x")), held.select(F.col("id").alias("b"), F.col("text").alias("y"))
        out = materialise(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified(width, similarity), "a long, b long"), "near-links")
        forget(asked, wanted, held)
        return out

    pairs = _candidates(nodes.withColumn("class", F.col("id")), n, similarity, recall, 4)
    links = verified(pairs)
    roots = components.connected(links).toDF("id", "class")
    known = materialise(nodes.join(roots, "id", "left").withColumn("class", F.coalesce("class", "id")), "near-known")
    rest = materialise(_candidates(known, n, similarity, recall, None).join(pairs, ["a", "b"], "left_anti"), "near-pairs")
    links = links.union(verified(rest))
    roots = components.connected(links).toDF("id", "root")
    full = nodes.join(roots, "id", "left").select("norm", "at", F.coalesce("root", "id").alias("root"))
    least = full.groupBy("root").agg(F.min("at").alias("least"))
    named = materialise(full.join(least, "root").select("norm", "least"), "near-classes")
    forget(pairs, rest, known)
    out = facts.join(named, "norm")
    return out.select("doc_id", "sha", F.col("least.doc_id").alias("class_id"), (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("sha") == F.col("least.sha"))).alias("first"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Of rows that repeat an id and its text one stays; other texts under the id
    of a near copy are judged by themselves. Rows without an id are kept as
    they are. Columns as given.
    """
    i = F.col(f"`{doc_id}`")
    named = docs.filter(i.isNotNull())
    found = materialise(near_copies(named, doc_id, text, **how).filter("first").groupBy("doc_id", "sha").count(), "near-first")
    repeated = not found.filter("count > 1").isEmpty()
    a, b, c = (free(docs.columns, x) for x in ("__id", "__sha", "__first"))
    first = found.select(F.col("doc_id").alias(a), F.col("sha").alias(c))
    kept = named.withColumn(b, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).join(first, (i == F.col(a)) & (F.col(b) == F.col(c)), "left_semi")
    if repeated:
        kept = kept.dropDuplicates([doc_id, b])
    return kept.select(*[F.col(f"`{x}`") for x in docs.columns]).unionByName(docs.filter(i.isNull()))
