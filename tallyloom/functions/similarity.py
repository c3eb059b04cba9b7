"""Similarity and sequence functions that built-ins can't express: Arrow UDFs."""

from __future__ import annotations

import bisect
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1


def dice(a: str, b: str) -> float:
    """Multiset Dice of character pairs; of characters if either is short."""
    if len(a) < 2 or len(b) < 2:
        x, y = set(a), set(b)
        return 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ratio(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1 - levenshtein(a, b) / longest if longest else 1.0


def lis_length(values: list[int]) -> int:
    """Length of the longest non-decreasing subsequence."""
    tails: list[int] = []
    for v in values:
        at = bisect.bisect_right(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


def fuzzy_find(needle: str, text: str, least: float = 0.8) -> tuple[int, float]:
    """Best window of the needle's length: coarse steps by Dice, then every
    start near the best by edit ratio. (-1, best) below ``least``."""
    size = len(needle)
    if not size or size > len(text):
        return -1, 0.0
    step = max(1, size // 8)
    coarse = max(range(0, len(text) - size + 1, step), key=lambda s: (dice(needle, text[s : s + size]), -s))
    near = range(max(0, coarse - step), min(len(text) - size, coarse + step) + 1)
    best = max(near, key=lambda s: (ratio(needle, text[s : s + size]), -s))
    score = ratio(needle, text[best : best + size])
    return (best if score >= least else -1), score


def match_sentences(parts: list[str], source: str, least: float = 0.8) -> list[tuple[str, int]]:
    """(how, place) of each sentence: exact after the last match, fuzzy after
    it, exact anywhere, fuzzy anywhere, or missing; matches move the cursor."""
    cursor, out = 0, []
    for p in parts:
        at = source.find(p, cursor)
        how = "exact"
        if at < 0:
            at, _ = fuzzy_find(p, source[cursor:], least)
            at, how = (at + cursor if at >= 0 else -1), "fuzzy"
        if at < 0:
            at, how = source.find(p), "exact elsewhere"
        if at < 0:
            at, how = fuzzy_find(p, source, least)[0], "fuzzy elsewhere"
        if at < 0:
            out.append(("missing", -1))
        else:
            out.append((how, at))
            if not how.endswith("elsewhere"):
                cursor = at + len(p)
    return out


def fnv1a(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & MASK
    return h


def seeded_sample(seed: str, n: int, k: int) -> list[int]:
    """k of n indices by a shift-register generator seeded with a hash."""
    state, pool, out = fnv1a(seed) or 1, list(range(n)), []
    for _ in range(min(k, n)):
        state ^= (state << 13) & MASK
        state ^= state >> 7
        state ^= (state << 17) & MASK
        out.append(pool.pop(state % len(pool)))
    return sorted(out)


def utf16_slice(text: str, start: int, stop: int) -> str:
    raw = text.encode("utf-16-le")
    return raw[2 * start : 2 * stop].decode("utf-16-le", "replace")


@F.pandas_udf(T.DoubleType())
def dice_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else dice(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def lis_share_udf(a: pd.Series) -> pd.Series:
    return a.map(lambda v: 1.0 if v is None or len(v) == 0 else lis_length(list(v)) / len(v))


@F.pandas_udf(T.IntegerType())
def lcp_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common prefix in UTF-8 bytes."""

    def lcp(x: str | None, y: str | None) -> int:
        p, q = (x or "").encode(), (y or "").encode()
        low, high = 0, min(len(p), len(q))
        while low < high:  # the longest prefix that agrees, by halves
            middle = (low + high + 1) // 2
            low, high = (middle, high) if p[low:middle] == q[low:middle] else (low, middle - 1)
        return low

    return pd.Series([lcp(x, y) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("score", T.DoubleType())]))
def fuzzy_udf(needles: pd.Series, texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if a is None or b is None else fuzzy_find(a, b) for a, b in zip(needles, texts)], columns=["at", "score"]).astype({"at": "Int32"})


@F.pandas_udf(T.StringType())
def utf16_slice_udf(t: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else utf16_slice(x, int(i), int(j)) for x, i, j in zip(t, a, b)])
