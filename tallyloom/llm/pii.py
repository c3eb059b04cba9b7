"""Personal data by weak supervision, in DataFrame expressions only.

Base spans of four kinds (email, ip, card, phone) come from strict patterns
with a validator each and always stay. Looser patterns run over the text
without the base spans and give further candidates. On all of them labelers
vote for, against or not at all: the strict form (regex), lists of endings,
issuers, calling codes and networks (gazetteer), cue words before the span
(context), the grouping of its characters (shape) and what it touches
(border). The votes are counted over the whole corpus by kind and pattern of
votes; expectation-maximisation over these counts estimates how reliable each
labeler is and how likely each pattern is a true span. With those
probabilities as soft labels a span classifier (naive Bayes over votes and
surface features, counted over the whole corpus) is trained; a candidate that
it gives ``least`` or more is a span too.

What meets on the driver is bounded by the votes and features, not by the
data: 4 kinds x 3^5 patterns, and these by the 84 values of the features.

Defined cases: a null or empty text has no spans; rows are judged one by one,
ids may be null or repeated; other columns are not read; an empty table gives
an empty result. Positions are code points. Patterns are linear in the text:
they start at the border of a run only and never give back what they took.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallyloom.llm._shared import let, materialise

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "shape", "border")
#: Before any data: how often a labeler that votes is right, and the weight of that
#: belief. The validators are the anchor that tells true from false: never re-estimated.
BELIEFS = {"regex": (0.99, math.inf), "gazetteer": (0.8, 20.0), "context": (0.85, 20.0), "shape": (0.8, 20.0), "border": (0.8, 20.0)}

_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
#: The patterns of the base spans, made linear (fixed values).
STRICT = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|\x20?[(\[{]at[)\]}]\x20?|\x20at\x20)", r"(?:\.|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)"
#: Looser forms: written-out addresses, IPv6 and numbers in other groupings.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+" + _AT + r"[A-Za-z0-9-]{1,63}+(?:" + _DOT + r"[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]++(?:\.[0-9]++){3}|(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9])++",
    "phone": r"(?<![0-9A-Za-z+.,/-])(?:\(?[0-9]{2,5}\)?[\x20./-]{1,2}){1,5}[0-9]{2,6}(?![0-9A-Za-z]|[.,:/-][0-9])",
}
#: Endings, issuers and calling codes (fixed values).
TLDS = "com org net edu gov info biz io co uk us de fr es it nl pt pl ru ua cn jp kr in br mx ar ca au ch at be se no dk fi eu".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|30[0-5]|35|6011|62|65)"
CALLING = r"^(?:\+|00)(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Cue words for and against, in English, German, French and Spanish (fixed values).
CUES = {
    "email": r"\b(?:e-?mails?|mail|contact|write|reach|kontakt|courriel|contacto|correo)\b",
    "ip": r"\b(?:ip|ipv[46]|host|server|login|address|adresse|dirección)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|payment|karte|kreditkarte|carte|tarjeta)\b",
    "phone": r"\b(?:tel|phone|call|fax|mobile|cell|whatsapp|telefon|rufnummer|téléphone|teléfono)\b",
}
AGAINST = r"\b(?:version|ver|build|release|section|chapter|isbn|issn|doi|order|invoice|serial|sku|hash|sha|date|datum|fecha)\b"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether 14 to 19 digits pass the check sum."""

    def total(d: Column) -> Column:
        n = F.length(d)

        def add(acc: Column, i: Column) -> Column:
            v = F.substring(d, n - i, F.lit(1)).cast("int") * (1 + i % 2)
            return acc + v - F.when(v > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0

    return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), total(d)).otherwise(False))


def _octets(m: Column) -> Column:
    # Leading zeros count for nothing; what is longer than three digits is over 255.
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda x: (F.length(x) < 4) & (F.substring(x, 1, 3).cast("int") <= 255)))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}

_FOUND = "array<struct<m:string,start:int,end:int,before:string,after:string>>"


def _before(lens: Column) -> tuple[Column, Callable[[Column, Column], Column]]:
    """Sums before each block of 64 lengths; (these, i) -> sum of the first i."""
    add = lambda a, x: a + x
    total = lambda part: F.aggregate(part, F.lit(0), add)
    blocks = F.aggregate(
        F.sequence(F.lit(0), F.floor(F.size(lens) / 64).cast("int")),
        F.array(F.lit(0)),
        lambda acc, j: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(lens, j * 64 + 1, F.lit(64))))),
    )

    def at(b: Column, i: Column) -> Column:
        block = F.floor(i / 64).cast("int")
        return b[block] + total(F.slice(lens, block * 64 + 1, i % 64))

    return blocks, at


def found(text: Column, pattern: str, near: int = 48) -> Column:
    """Matches with their places and what stands before and after each."""

    def placed(x: Column) -> Column:
        gaps, ms = x["gaps"], x["ms"]

        def rows(lens: Column) -> Column:
            blocks, at = _before(lens)
            return let(
                blocks,
                lambda b: F.transform(
                    ms,
                    lambda m, i: let(
                        at(b, i) + F.length(gaps[i]),
                        lambda s: F.struct(m.alias("m"), s.alias("start"), (s + F.length(m)).alias("end"), F.right(gaps[i], F.lit(near)).alias("before"), F.left(gaps[i + 1], F.lit(8)).alias("after")),
                    ),
                ),
            )

        return let(F.transform(ms, lambda m, i: F.length(gaps[i]) + F.length(m)), rows)

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("ms"))
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(F.array().cast(_FOUND))


def without(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """The text, its valid matches replaced by as many NUL characters."""

    def masked(x: Column) -> Column:
        piece = F.transform(x["ms"], lambda m, i: F.concat(x["gaps"][i], F.when(valid(m), F.repeat(F.lit("\0"), F.length(m))).otherwise(m)))
        return F.concat(F.array_join(piece, ""), F.element_at(x["gaps"], -1))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("ms"))
    return F.when(text.rlike(pattern), let(both, masked)).otherwise(text)


def _where(rows: Column, valid: Callable[[Column], Column]) -> Column:
    return F.filter(rows, lambda x: valid(x["m"]))


def _unless_none(kind: str) -> Callable[[Column], Column]:
    """Masks the base spans of a kind in a text that has some."""
    return lambda t: F.when(F.size(f"b_{kind}") > 0, without(t, STRICT[kind], VALID[kind])).otherwise(t)


#: What a loose match must have to be looked at.
PLAUSIBLE: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.lit(True),
    "card": lambda m: F.length(_digits(m)).between(13, 19),
    "phone": lambda m: F.length(_digits(m)).between(7, 15),
}


def _sign(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _regex_vote(kind: str, m: Column, base: bool) -> Column:
    if base:
        return F.lit(1)
    if kind == "email":  # a written-out form is not the strict one, and not against it
        return F.lit(0)
    if kind == "ip":
        six = (F.size(F.split(m, ":")) == 8) | m.contains("::")
        return _sign(F.when(m.contains(":"), six).otherwise(_octets(m)), F.lit(True))
    if kind == "card":
        return _sign(_luhn(m), F.lit(True))
    return _sign(F.lit(False), ~F.length(_digits(m)).between(9, 15))


def _gazetteer_vote(kind: str, m: Column) -> Column:
    if kind == "email":
        known = F.lower(F.regexp_extract(m, "([A-Za-z]+)$", 1)).isin(TLDS)
        return _sign(known, ~known)
    if kind == "ip":
        first = F.regexp_extract(m, r"^0*([0-9]{1,3})\.", 1)
        public = F.when(first == "", False).otherwise(first.cast("int").between(1, 223))
        return _sign(public, ~public & ~m.contains(":"))
    if kind == "card":
        known = _digits(m).rlike(ISSUERS)
        return _sign(known, ~known)
    return _sign(m.rlike(CALLING), F.lit(False))


def _shape_vote(kind: str, m: Column) -> Column:
    if kind == "email":
        return _sign(m.rlike(r"(?i)^[a-z0-9][^@]*(?:@|at[)\]}])") & ~m.contains(".."), m.contains(".."))
    if kind == "ip":
        return _sign(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") | m.rlike("(?i)[a-f].*:|:.*[a-f]"), m.rlike(r"^[0-9]{1,2}:[0-9]{2}:[0-9]{2}$"))
    if kind == "card":
        return _sign(m.rlike(r"^[0-9]{4}([^0-9])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{6}\1[0-9]{5})$"), m.rlike(r"[^0-9]{2}|^[0-9]{1,2}[^0-9]"))
    usual = r"^(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,5}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{4}$|^\+|^00[1-9]"
    return _sign(m.rlike(usual), m.rlike(r"^(?:19|20)[0-9]{2}[./-]|[./-](?:19|20)[0-9]{2}$"))


def _votes(kind: str, x: Column, base: bool) -> Column:
    near, m = F.lower(x["before"]), x["m"]
    touches = x["before"].rlike(r"[\p{L}0-9_=#/]\z") | x["after"].rlike(r"^[\p{L}0-9_=]")
    votes = (_regex_vote(kind, m, base), _gazetteer_vote(kind, m), _sign(near.rlike(CUES[kind]), near.rlike(AGAINST)), _shape_vote(kind, m), _sign(F.lit(False), touches))
    return F.array(*votes)


def _features(x: Column, votes: Column) -> Column:
    """Values of the classifier: five votes, then digits, marks and the two neighbours."""
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"^[\x20\x09-\x0D]"), 1).when(c.rlike(r"^[.,;:!?)\]]"), 2).when(c.rlike(r"^\p{L}"), 3).when(c.rlike("^[0-9]"), 4).otherwise(5)
    m = x["m"]
    digits = F.least(F.length(_digits(m)), F.lit(31))
    marks = F.when(m.contains("@"), 0).when(m.contains(":"), 1).when(m.contains("("), 2).when(m.contains("."), 3).when(m.contains("-"), 4).when(m.contains(" "), 5).otherwise(6)
    return F.concat(F.transform(votes, lambda v: v + 1), F.array(digits, marks, side(F.right(x["before"], F.lit(1))), side(F.left(x["after"], F.lit(1)))))


#: Names of the features and how many values each has.
FEATURES = (*((name, 3) for name in LABELERS), ("digits", 32), ("marks", 7), ("left", 6), ("right", 6))
_CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>>"


def _candidates(kind: str, rows: Column, base: bool) -> Column:
    def row(x: Column) -> Column:
        return let(
            _votes(kind, x, base),
            lambda v: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), v.alias("votes"), _features(x, v).alias("features")),
        )

    # No candidate is evaluated where there is none.
    return F.when(F.size(rows) > 0, F.transform(rows, row)).otherwise(F.array().cast(_CANDIDATE))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, loose): candidates of each document with votes and features."""
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    d = d.select("doc_id", "t", *(_where(found(F.col("t"), STRICT[k]), VALID[k]).alias(f"b_{k}") for k in KINDS))
    rest = F.col("t")
    for k in KINDS:
        rest = let(rest, _unless_none(k))
    d = d.withColumn("rest", F.when(sum((F.size(f"b_{k}") for k in KINDS), F.lit(0)) > 0, rest).otherwise(F.col("t")))
    d = d.select("doc_id", *(f"b_{k}" for k in KINDS), *(_where(found(F.col("rest"), LOOSE[k]), PLAUSIBLE[k]).alias(f"l_{k}") for k in KINDS))
    return d.select("doc_id", F.concat(*(_candidates(k, F.col(f"b_{k}"), True) for k in KINDS)).alias("base"), F.concat(*(_candidates(k, F.col(f"l_{k}"), False) for k in KINDS)).alias("loose"))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def reliabilities(patterns: dict[tuple[int, ...], int], base: dict[tuple[int, ...], int] | None = None, rounds: int = 60) -> tuple[float, list[float]]:
    """Share of true spans and each labeler's reliability, from counted votes of one kind.

    A labeler that votes is right with its reliability, whatever the truth; the
    beliefs count as votes seen before. ``base`` spans are true and tell about
    the labelers only, the share is that of the other candidates.
    """
    sure, share = [BELIEFS[name][0] for name in LABELERS], 0.5
    known = [(votes, count, True) for votes, count in sorted((base or {}).items())]
    open_ = [(votes, count, False) for votes, count in sorted(patterns.items())]
    for _ in range(rounds):
        right, voted, true, n = [0.0] * len(sure), [0.0] * len(sure), 0.0, 0
        for votes, count, sure_one in known + open_:
            p = 1.0 if sure_one else probability(share, sure, votes)
            if not sure_one:
                true, n = true + p * count, n + count
            for k, v in enumerate(votes):
                if v:
                    right[k] += count * (p if v > 0 else 1 - p)
                    voted[k] += count
        share = (true + 5) / (n + 10)
        for k, name in enumerate(LABELERS):
            belief, weight = BELIEFS[name]
            if weight < math.inf:
                sure[k] = min(0.999, max(0.001, (right[k] + belief * weight) / (voted[k] + weight)))
    return share, sure


def probability(share: float, sure: list[float], votes: tuple[int, ...]) -> float:
    z = _logit(min(0.999, max(0.001, share))) + sum(v * _logit(s) for v, s in zip(votes, sure, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def trained(rows: list[Row], least_count: float = 1.0) -> dict[int, tuple[float, list[list[float]]]]:
    """The classifier by kind: bias, and a weight for each value of each feature.

    ``rows`` count the corpus by (kind, base, votes, feature, value); feature
    -1 counts the candidates themselves. Base spans are examples of true ones;
    the bias is that of the other candidates.
    """
    patterns: dict[tuple[int, bool], dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for r in rows:
        if r["feature"] == -1:
            patterns[r["kind"], r["base"]][tuple(r["votes"])] += r["n"]
    models = {}
    for kind in sorted({k for k, _ in patterns}):
        seen, base = patterns[kind, False], patterns[kind, True]
        share, sure = reliabilities(seen, base)
        belief = {(votes, False): probability(share, sure, votes) for votes in seen} | {(votes, True): 1.0 for votes in base}
        yes = sum(belief[v, False] * n for v, n in sorted(seen.items()))
        every = sum(seen.values())
        tables = [[[least_count, least_count] for _ in range(size)] for _, size in FEATURES]
        for r in sorted(rows, key=lambda r: (r["feature"], r["value"], r["base"], tuple(r["votes"]))):
            if r["kind"] == kind and r["feature"] >= 0:
                cell, p = tables[r["feature"]][r["value"]], belief[tuple(r["votes"]), r["base"]]
                cell[0] += p * r["n"]
                cell[1] += (1 - p) * r["n"]
        weights = []
        for table in tables:
            for_, against = sum(c[0] for c in table), sum(c[1] for c in table)
            weights.append([math.log(c[0] / for_) - math.log(c[1] / against) for c in table])
        models[kind] = (math.log((yes + 1) / (every - yes + 1)), weights)
    return models


def counted(found: DataFrame) -> DataFrame:
    """(kind, base, votes, feature, value, n) over the candidates of all documents."""
    one = found.select(F.explode(F.concat("base", "loose")).alias("c")).groupBy("c.kind", "c.base", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n"))
    each = one.select("kind", "base", "votes", "n", F.posexplode(F.concat(F.array(F.lit(0)), "features")).alias("at", "value"))
    return each.groupBy("kind", "base", "votes", (F.col("at") - 1).alias("feature"), "value").agg(F.sum("n").alias("n"))


def _score(models: dict[int, tuple[float, list[list[float]]]], c: Column) -> Column:
    """Log odds of a candidate: its kind's bias and the weights of its features."""
    bias = F.lit([models.get(k, (-99.0, None))[0] for k in range(len(KINDS))])
    none = [[0.0] * size for _, size in FEATURES]
    flat = F.lit([w for k in range(len(KINDS)) for table in models.get(k, (0, none))[1] for w in table])
    starts, per_kind = [], sum(size for _, size in FEATURES)
    for _, size in FEATURES:
        starts.append((starts[-1][0] + starts[-1][1], size) if starts else (0, size))
    offsets = F.lit([s for s, _ in starts])
    return bias[c["kind"]] + F.aggregate(F.zip_with(c["features"], offsets, lambda v, o: flat[c["kind"] * per_kind + o + v]), F.lit(0.0), lambda a, w: a + w)


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.95) -> DataFrame:
    """(doc_id, spans): kind, start, end, base and score, by start and kind."""
    seen = materialise(candidates(docs, doc_id, text), "candidates")
    models = trained(counted(seen).collect())  # 972 patterns by 84 values at most
    added = F.filter("loose", lambda c: _score(models, c) >= _logit(least))
    named = lambda cs: F.transform(cs, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("k"), c["end"].alias("end"), c["base"].alias("base"), _score(models, c).alias("score")))
    kinds = F.lit(list(KINDS))
    out = F.transform(F.sort_array(F.concat(named("base"), named(added))), lambda c: F.struct(kinds[c["k"]].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["score"].alias("score")))
    return seen.select("doc_id", out.alias("spans"))
