"""Near-duplicate lines by a segment-partition edit join, DataFrames only.

Lines are compared trimmed and lower-cased. Equal lines of any length are
collapsed first. A distinct line of ``least_chars`` characters or more is cut
into ``edits`` + 1 even segments; two lines within ``edits`` edits share a
segment of the shorter one, at a place in the longer one that lies within as
many positions as edits fit before and after it. Segments are the index, those
substrings the probes, and the hash of (length, segments kept, characters) the
join key, so only lines of fitting lengths meet. Candidates are verified by a
banded bit-parallel automaton: one bit for each diagonal of the band, one word
for each number of edits, one step for each character.

An index key with more than ``most`` lines would pair its whole group. Those
lines are cut again, into ``finer`` segments, and meet only where they agree
on all but ``edits`` of them: the same theorem with longer keys, so no pair is
lost. Two things keep a group from being paired out there. A line only needs
one earlier neighbour, so each is first compared with the line before it and
the first line under each of its keys, and a line that is decided so asks no
more. The others meet under a key only if the parities of their characters
and of their pairs of neighbours, 64 bits each, leave room for ``edits``
edits: lines with other words in one place never become rows.

A line goes if a line that first occurs earlier, by (document id, hash of the
row's text, line number), is within ``edits`` edits, or is the same line.
Lines without a word stay.

Defined cases: null and empty texts have no lines to remove and stay as they
are; rows that share an id but not their text are documents of their own, and
each loses its own lines; rows that repeat an id and its text keep the same
lines; a null id sorts first; very long lines and documents are whole; an
empty table gives an empty result; extra columns pass through, and a new
column whose name is taken gets an underscore.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm._shared import forget, free, let, materialise


def shapes(edits: int, pieces: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """How a probe may meet the index: for each choice of kept pieces, the
    (length difference, shift of each kept run) to try.

    ``edits`` pieces are left out. A run of c of them in a row takes up to c
    edits, so it moves what follows by at most c, and all runs together by the
    difference of the lengths. Returns (choice as bits, probes).
    """
    out = []
    for left_out in combinations(range(pieces), edits):
        kept = [p for p in range(pieces) if p not in left_out]
        runs = kept_runs(kept)
        gaps = [b[0] - a[1] - 1 for a, b in zip([(-1, -1), *runs], [*runs, (pieces, pieces)])]
        tries = []
        for moves in product(*(range(-g, g + 1) for g in gaps)):
            if 0 <= sum(moves) <= edits:
                at, shifts = 0, []
                for m in moves[:-1]:
                    at += m
                    shifts.append(at)
                tries.append((sum(moves), shifts))
        out.append((sum(1 << p for p in kept), tries))
    return out


def kept_runs(kept: list[int]) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of consecutive piece numbers."""
    runs: list[tuple[int, int]] = []
    for p in kept:
        if runs and runs[-1][1] == p - 1:
            runs[-1] = (runs[-1][0], p)
        else:
            runs.append((p, p))
    return runs


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits: banded, bit-parallel.

    Word e has bit k + edits set at step j if the first j + k characters of
    ``a`` and the first j of ``b`` are within e edits. All words are packed
    into one long.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    start = sum((((1 << (e + 1)) - 1) << edits) << (width * e) for e in range(edits + 1))

    def run(s: Column, t: Column) -> Column:
        def step(state: Column, j: Column) -> Column:
            c = F.get(t, j)
            match = F.lit(0)
            for k in range(-edits, edits + 1):
                match = match + F.when(F.get(s, j + k) == c, 1 << (k + edits)).otherwise(0)

            def moved(m: Column) -> Column:
                def word(e: int) -> Column:
                    return F.shiftright(state, width * e).bitwiseAND(full)

                def chain(e: int, below: Column, packed: Column) -> Column:
                    if e > edits:
                        return packed
                    before = word(e - 1)
                    new = word(e).bitwiseAND(m).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(below, 1)).bitwiseAND(full)
                    return let(new, lambda v: chain(e + 1, v, packed.bitwiseOR(F.shiftleft(v, width * e))))

                return let(word(0).bitwiseAND(m).cast("long"), lambda v: chain(1, v, v))

            return F.when(state == 0, state).otherwise(let(match.cast("long"), moved))

        last = F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), F.lit(start).cast("long"), step)
        at = F.size(s) - F.size(t) + (width * edits + edits)
        return F.call_function("shiftright", last, at).bitwiseAND(F.lit(1)) == 1

    def sized(s: Column) -> Column:
        return let(F.split(b, ""), lambda t: F.when(F.abs(F.size(s) - F.size(t)) > edits, False).otherwise(run(s, t)))

    return let(F.split(a, ""), sized)


def keyed(lines: DataFrame, edits: int, pieces: int, probe: bool) -> DataFrame:
    """``lines`` (line, n and more) with one row for each join key ``k``: as
    the shorter line, or with ``probe`` as the longer (or equally long) one.

    The choices are rows of a literal, and the key one expression over them.
    """
    all_runs = [kept_runs([p for p in range(pieces) if bits >> p & 1]) for bits, _ in shapes(edits, pieces)]
    width = max(map(len, all_runs))
    rows = []
    for (bits, tries), runs in zip(shapes(edits, pieces), all_runs):
        for d, shifts in tries if probe else [(0, [0] * len(runs))]:
            flat = [x for (a, b), shift in zip(runs, shifts) for x in (a, b + 1, shift)]
            rows.append([bits, d, *flat, *[0] * (3 * width - len(flat))])
    c, n = F.col("c"), F.col("n") - F.col("c")[1]

    def start(i: Column) -> Column:
        """0-based start of piece i; the last pieces take the remainder."""
        return (F.floor(n / pieces) * i + F.greatest(F.lit(0), i - (pieces - n % pieces))).cast("int")

    parts, fits = [], F.lit(True)
    for r in range(width):
        a, b, shift = c[2 + 3 * r], c[3 + 3 * r], c[4 + 3 * r]
        part = F.col("line").substr(start(a) + shift + 1, start(b) - start(a))
        parts.append(part if width == 1 else F.when(b > a, part))
        fits = fits & ((b == a) | (start(a) + shift >= 0))
    rest = [x for x in lines.columns if x != "line"]
    every = lines.select("*", F.explode(F.array(*[F.array(*map(F.lit, r)) for r in rows])).alias("c"))
    return every.filter(fits).select(*rest, F.xxhash64(c[0], n, *parts).alias("k")).drop("n")


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, row, no, line, h1, h2) of the lines that hold a word."""
    t = F.col(f"`{text}`")
    lines = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(t).alias("row"), F.posexplode(F.split(t, "\n")).alias("no", "raw"))
    lines = lines.select("doc", "row", "no", F.lower(F.trim("raw", F.lit(" \t\n\x0b\f\r"))).alias("line")).filter("line != ''")
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line")})


def _crowded_pairs(lines: DataFrame, edits: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b), b < a, under keys of ``most`` lines at most, and
    the ids of the lines that meet fuller keys."""
    index = keyed(lines, edits, edits + 1, False)
    hot = materialise(index.groupBy("k").count().filter(F.col("count") > most).select("k"), "line-hot")
    # A crowded key stays as one row with the id -1: who meets it is crowded,
    # as are its own lines, whose keys are among their probes.
    index = index.join(hot, "k", "left_anti").unionByName(hot.withColumn("id", F.lit(-1).cast("long")))
    met = keyed(lines, edits, edits + 1, True).alias("p").join(index.alias("i"), (F.col("p.k") == F.col("i.k")) & (F.col("p.id") != F.col("i.id")))
    pairs = materialise(met.select(F.greatest("p.id", "i.id").alias("a"), F.least("p.id", "i.id").alias("b")).distinct(), "line-pairs")
    forget(hot)
    return pairs.filter("b >= 0"), pairs.filter("b < 0").select(F.col("a").alias("id"))


def parities(line: Column) -> Column:
    """Two words of 64 bits, each bit flipped by every character, or pair of
    neighbours, that hashes to it."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)))
    start = F.struct(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.lit("").alias("last"))

    def step(acc: Column, c: Column) -> Column:
        return F.struct(acc["one"].bitwiseXOR(bit(F.hash(c))).alias("one"), acc["two"].bitwiseXOR(bit(F.hash(acc["last"], c))).alias("two"), c.alias("last"))

    return F.aggregate(F.split(line, ""), start, step, lambda acc: F.struct(acc["one"].alias("one"), acc["two"].alias("two")))


def _alike(x: str, y: str, edits: int) -> Column:
    """Whether parities leave room for ``edits`` edits: an edit changes two
    characters at most, and four pairs of neighbours."""
    apart = lambda f: F.bit_count(F.col(f"{x}.{f}").bitwiseXOR(F.col(f"{y}.{f}")))
    return (apart("one") <= 2 * edits) & (apart("two") <= 4 * edits)


def _few(rows: DataFrame, most: int = 1 << 18) -> DataFrame:
    """Materialised ``rows`` for a join: ``most`` at most are broadcast, so that
    the other side stays where it is; more are dealt by key, whatever the size
    of their files."""
    return F.broadcast(rows) if rows.count() <= most else rows.hint("merge")


def _by_ids(lines: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``lines`` joined with materialised ``ids`` on id."""
    return lines.join(_few(ids), "id", how)


def _linked(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """The ``pairs`` (a, b) of line ids that are within ``edits`` edits; only
    lines in pairs move."""
    asked = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "line-asked")
    held = materialise(_by_ids(lines.select("id", "line"), asked).withColumn("sig", parities(F.col("line"))), "line-held")
    both = pairs.join(held.toDF("a", "line_a", "sig_a"), "a").join(held.toDF("b", "line_b", "sig_b"), "b")
    out = materialise(both.filter(_alike("sig_a", "sig_b", edits) & within(F.col("line_a"), F.col("line_b"), edits)).select("a", "b"), "line-links")
    forget(asked, held)
    return out


def _near_crowded(lines: DataFrame, edits: int, finer: int) -> DataFrame:
    """(id) of crowded lines with an earlier neighbour among them."""
    # Numbers in the order of first places.
    again = lines.orderBy("doc", "row", "no").select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("was"), "line", "n", parities(F.col("line")).alias("sig"))
    again = materialise(again, "lines-crowded")
    # First the neighbours at hand: under each key the line before and the
    # first one of a range of numbers, so that a key is dealt by ranges.
    by = W.partitionBy("k", F.shiftright("id", 33)).orderBy("id")
    at = keyed(again.select("id", "sig", "line", "n"), edits, finer, False)
    at = at.select("id", "sig", F.lag(F.struct("id", "sig")).over(by).alias("x"), F.first(F.struct("id", "sig")).over(by).alias("y"))
    at = at.select("id", "sig", F.explode(F.array("x", "y")).alias("o")).filter("o.id < id").select("id", "sig", "o.*").toDF("a", "sig", "b", "o_sig")
    links = _linked(materialise(at.filter(_alike("sig", "o_sig", edits)).select("a", "b").distinct(), "line-pairs"), again, edits)
    done = materialise(links.select(F.col("a").alias("id")).distinct(), "line-near")
    # Then all that are still undecided, whichever line is the longer one.
    known = _by_ids(again, done.withColumn("done", F.lit(True)), "left").select("id", "sig", F.coalesce("done", F.lit(False)).alias("done"), "line", "n")
    known = materialise(known, "lines-known")
    p, i = keyed(known, edits, finer, True).alias("p"), keyed(known, edits, finer, False).alias("i")
    undecided = F.when(F.col("p.id") > F.col("i.id"), ~F.col("p.done")).when(F.col("p.id") < F.col("i.id"), ~F.col("i.done")).otherwise(False)
    met = p.join(i, (F.col("p.k") == F.col("i.k")) & undecided & _alike("p.sig", "i.sig", edits))
    more = _linked(materialise(met.select(F.greatest("p.id", "i.id").alias("a"), F.least("p.id", "i.id").alias("b")).distinct(), "line-pairs"), again, edits)
    near = materialise(done.union(more.select(F.col("a").alias("id"))).distinct(), "line-near")
    out = materialise(_by_ids(again, near).select(F.col("was").alias("id")), "line-near")
    forget(known, done, near, again)
    return out


def line_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = 2, least_chars: int = 20, most: int = 16, finer: int = 5) -> DataFrame:
    """(h1, h2, doc, row, no, near): the first place of every distinct line
    that occurs twice or is near, and whether it is within ``edits`` of a line
    that first occurs before it."""
    found = _lines(docs, doc_id, text)
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc", "row", "no")).alias("at"), F.first("line").alias("line"), F.count("*").alias("times"))
    first = materialise(first.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "at.*", "times", "line", F.length("line").alias("n")), "lines")
    lines = first.filter(F.col("n") >= least_chars).select("id", "line", "n")
    pairs, crowded = _crowded_pairs(lines, edits, most)
    links = _linked(pairs, lines, edits)
    asked = materialise(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), "line-asked")
    place = materialise(_by_ids(first, asked).select("id", F.struct("doc", "row", "no").alias("at")), "line-places")
    both = links.join(place.toDF("a", "at_a"), "a").join(place.toDF("b", "at_b"), "b")
    near = both.select(F.when(F.col("at_a") > F.col("at_b"), F.col("a")).otherwise(F.col("b")).alias("id"))
    if not crowded.isEmpty():
        near = near.union(_near_crowded(_by_ids(first, crowded), edits, finer))
    near = materialise(near.distinct().withColumn("near", F.lit(True)), "line-near")
    out = _by_ids(first, near, "left").filter("near or times > 1").select("h1", "h2", "doc", "row", "no", F.coalesce("near", F.lit(False)).alias("near"))
    out = materialise(out, "line-verdicts")
    forget(first, pairs, asked, place, near)
    return out


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc, row, removed, n_near): the numbers of the lines that each row
    loses (``row`` is the hash of its text), and how many of them as near and
    not as equal lines."""
    verdicts = line_verdicts(docs, doc_id, text, **how).toDF("h1", "h2", "first_doc", "first_row", "first_no", "near")
    placed = _lines(docs, doc_id, text).drop("line").join(_few(verdicts), ["h1", "h2"])
    first = F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("row") == F.col("first_row")) & (F.col("no") == F.col("first_no"))
    gone = placed.filter(F.col("near") | ~first)
    return gone.groupBy("doc", "row").agg(F.sort_array(F.collect_set("no")).alias("removed"), F.count_distinct(F.when(first, F.col("no"))).alias("n_near"))


def with_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "lines", **how) -> DataFrame:
    """``docs`` plus a struct: n_lines, removed (line numbers), n_near, text."""
    name = free(docs.columns, name)
    doc, row, removed, near = new = [free([*docs.columns, name], x) for x in ("__doc", "__row", "__removed", "__near")]
    gone = removed_lines(docs, doc_id, text, **how).toDF(*new)
    t = F.col(f"`{text}`")
    joined = docs.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(doc)) & (F.xxhash64(t) == F.col(row)), "left")
    numbers = F.coalesce(removed, F.array().cast("array<int>"))
    lines = F.split(t, "\n")
    kept = F.when(F.size(numbers) == 0, t).otherwise(
        let(lines, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), numbers), lambda i: ls[i]), "\n"))
    )
    n = F.when(t.isNull(), F.lit(0)).otherwise(F.size(lines))
    struct = F.struct(n.cast("long").alias("n_lines"), numbers.alias("removed"), F.coalesce(near, F.lit(0)).cast("long").alias("n_near"), kept.alias("text"))
    return joined.withColumn(name, struct).drop(*new)


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Documents without their removed lines; one that loses lines and has no
    word left goes, others stay. Columns as given."""
    name = free(docs.columns, "__lines")
    out = with_verdicts(docs, doc_id, text, name, **how)
    # One or no row of an array: a filter would cut the texts a second time.
    none = F.array().cast("array<string>")
    left = let(F.col(name), lambda v: F.when(v["text"].rlike(r"[^\x20\x09-\x0D]") | (F.size(v["removed"]) == 0), F.array(v["text"])).otherwise(none))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(left).alias(name)).withColumn(text, F.col(name)).drop(name)
