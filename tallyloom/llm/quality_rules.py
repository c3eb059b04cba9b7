"""Line-first quality rules, in DataFrame expressions only.

Every line is judged on its own: symbol noise, navigation, shouting, runs of
one word, missing end punctuation and boilerplate phrases each fail a line.
Failed lines are removed and no other, so blank lines stay; a document that
loses too large a share of its word characters is rejected, as is one that
fails the whole-text base rules. Long lines needn't end in punctuation: prose
that is wrapped ends its lines anywhere.

Defined cases: a null or empty text has no words, fails the base rules and
is not kept. Repeated rows are judged one by one. Other columns pass
through unchanged, and the struct with the report takes an underscore more
where its name is taken; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import SPACE, free, let, words

#: Phrases of licence, cookie and page-furniture lines, in English, German,
#: French and Spanish (fixed values).
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "lorem ipsum",
    "subscribe to our",
    "alle rechte vorbehalten",
    "lizenziert unter",
    "nutzungsbedingungen",
    "javascript aktivieren",
    "newsletter abonnieren",
    "tous droits réservés",
    "sous licence",
    "politique de confidentialité",
    "conditions d'utilisation",
    "mentions légales",
    "activer javascript",
    "abonnez-vous",
    "todos los derechos reservados",
    "bajo licencia",
    "política de privacidad",
    "términos de uso",
    "condiciones de uso",
    "aviso legal",
    "activar javascript",
    "suscríbete",
)
#: Words that prose has too: they tell with a year or sign, with what is done
#: with them, or at the head of a short line only (fixed values).
IN_CONTEXT = (
    r"copyright\s*(?:©|\(c\)|(?:19|20)[0-9]{2})|©\s*(?:19|20)[0-9]{2}|^[^a-z]*(?:copyright|©)[^a-z]*$",
    r"(?:^|[^a-z])(?:uses?|using|accepts?|enable|allow|manage|reject|set)(?: all| our| of| the| these)* cookies(?:[^a-z]|$)",
    r"(?:^|[^a-z])cookies? (?:policy|settings|notice|consent|preferences|banner|akzeptieren|zulassen)(?:[^a-z]|$)",
    r"(?:^|[^a-z])(?:verwende[nt]|utilise|utilisons|utiliza|utilizamos)(?: des| las| los)? cookies(?:[^a-z]|$)",
    r"^[^a-z]*(?:impressum|datenschutz(?:erklärung|hinweise)?)(?:[^a-z].{0,40})?$",
)
SYMBOLS = r"[#*$%&|<>]"
#: End punctuation, closing quotes and brackets allowed after it.
ENDS = r"[.!?:;…。！？][\"'”’»)\]]*\s*$"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(
    line: Column,
    symbols_per_word: float = 0.3,
    least_unique: float = 0.3,
    long_line: int = 10,
    short_line: int = 4,
    phrase_chars: int = 200,
) -> Column:
    """True where a line that holds a word breaks a rule."""
    def phrase(low: Column) -> Column:
        found = F.lit(False)
        for p in BOILERPLATE:
            found = found | low.contains(p)
        for p in IN_CONTEXT:
            found = found | low.rlike(p)
        return found

    def judged(ws: Column) -> Column:
        n = F.size(ws)
        return (
            (_count(line, SYMBOLS) > n * symbols_per_word)  # symbol noise, "a | b | c" menus
            | (_count(line, "!!") > n * symbols_per_word)
            | ((n >= long_line) & (line == F.upper(line)) & (line != F.lower(line)))  # shouting
            | ((n >= long_line) & (F.size(F.array_distinct(ws)) < n * least_unique))
            | ((n <= short_line) & ~line.rlike(ENDS))  # menu entries, stray labels
            | ((F.length(line) <= phrase_chars) & let(F.lower(line), phrase))
        )

    return let(words(line), judged)


def _covered(ws: Column) -> Column:
    """Words inside 3-word windows found at least twice in the text.

    Window hashes that are all different prove that no window repeats; only
    other texts pay for the sort, where equal hashes are compared as words.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]))

    def same(a: Column, b: Column) -> Column:
        i, j = a["i"], b["i"]
        return (a["h"] == b["h"]) & (ws[i] == ws[j]) & (ws[i + 1] == ws[j + 1]) & (ws[i + 2] == ws[j + 2])

    def count(hs: Column) -> Column:
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            ordered,
            lambda o: F.transform(
                F.filter(
                    o,
                    lambda x, k: F.when(k > 0, same(x, o[F.greatest(k - 1, F.lit(0))])).otherwise(False)
                    | F.when(k < F.size(o) - 1, same(x, o[F.least(k + 1, F.size(o) - 1)])).otherwise(False),
                ),
                lambda x: x["i"],
            ),
        )
        every = let(starts, lambda s: F.size(F.array_distinct(F.concat(s, F.transform(s, lambda p: p + 1), F.transform(s, lambda p: p + 2)))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(every)

    return F.when(F.size(ws) < 3, F.lit(0)).otherwise(let(hashes, count))


def quality_of(text: str, least_words: int = 50, most_repeated: float = 0.5, most_lost: float = 0.5) -> Column:
    """One struct of counts, the cleaned text and the verdict of a column."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n_space = _count(t, SPACE)

    def of_lines(ls: Column) -> Column:
        good = F.filter(ls, lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~line_fails(x))
        worded = F.filter(ls, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(
            F.struct(good.alias("g"), worded.alias("w")),
            lambda x: F.struct(
                (F.size(x["w"]) - F.size(F.array_distinct(x["w"]))).cast("long").alias("n_dup_lines"),
                (F.size(ls) - F.size(x["g"])).cast("long").alias("n_failed_lines"),
                # A text without failed lines stays as it is.
                F.when(F.size(ls) == F.size(x["g"]), t).otherwise(F.array_join(x["g"], "\n")).alias("clean_text"),
            ),
        )

    lines = F.split(t, "\n")
    raw = let(
        words(t),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            (F.length(t) - n_space).cast("long").alias("word_chars"),
            _count(t, SYMBOLS).cast("long").alias("n_symbols"),
            _covered(ws).cast("long").alias("n_repeat_words"),
            let(lines, of_lines).alias("l"),
        ),
    )
    kept_chars = lambda c: F.length(c) - _count(c, SPACE)

    def verdict(r: Column) -> Column:
        failed = (r["n_words"] < least_words) | (r["n_repeat_words"] > r["n_words"] * most_repeated)
        return F.struct(
            r["n_words"].alias("n_words"),
            r["word_chars"].alias("word_chars"),
            r["n_symbols"].alias("n_symbols"),
            r["l"]["n_dup_lines"].alias("n_dup_lines"),
            r["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (kept_chars(r["l"]["clean_text"]) >= r["word_chars"] * (1 - most_lost))).alias("kept"),
            r["l"]["n_failed_lines"].alias("n_failed_lines"),
            r["l"]["clean_text"].alias("clean_text"),
        )

    return let(raw, verdict)


def quality_report(docs: DataFrame, text: str = "text", name: str = "quality", **how) -> DataFrame:
    """``docs`` plus one struct column of counts, the cleaned text and verdict."""
    return docs.withColumn(free(docs.columns, name), quality_of(text, **how))


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that pass, without their failed lines; columns as given."""
    name = free(docs.columns, "__clean")
    # A filter on the verdict would evaluate the rules again for the text; one
    # or no row of an array does not.
    none = F.array().cast("array<string>")
    kept = let(quality_of(text), lambda q: F.when(q["kept"], F.array(q["clean_text"])).otherwise(none))
    return docs.select("*", F.explode(kept).alias(name)).withColumn(text, F.col(name)).drop(name)
