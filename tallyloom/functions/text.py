"""Text normalisation, keys, tokens and parsers as column expressions.

White space is Unicode white space, as in the source system's rules; Java
needs the (?U) flag for that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are read as one plain character (fixed values).
QUOTES = "‘’‛′“”‟″"
PLAIN_QUOTES = "''''\"\"\"\""
DASHES = "‐‑‒–—―−"
SPACES = "\u00a0\u2002\u2003\u2009\u202f\u3000"
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body`` gets a variable."""
    return F.transform(F.array(value), body)[0]


def squeeze_lower(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def readable(c: Column) -> Column:
    """Quotes, dashes and spaces folded, one space, lower case, right trim."""
    folded = F.translate(c, QUOTES + DASHES + SPACES, PLAIN_QUOTES + "-" * len(DASHES) + " " * len(SPACES))
    return F.rtrim(F.lower(F.regexp_replace(F.replace(folded, F.lit("…"), F.lit("...")), r"(?U)\s+", " ")))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def loose(c: Column) -> Column:
    return F.replace(compact(c), F.lit("-"), F.lit(""))


def alnum_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def review_text(c: Column) -> Column:
    """Quotes, dashes, ligatures and full-width forms folded; spaced dashes
    closed; a leading "questions N-M" removed."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
    out = F.translate(c, QUOTES + DASHES + wide, PLAIN_QUOTES + "-" * len(DASHES) + "".join(chr(ord(x) - 0xFEE0) for x in wide))
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.replace(squeeze_lower(out), F.lit(" - "), F.lit("-"))
    return F.regexp_replace(out, r"^questions? \d+(?:-\d+)?:? ", "")


def spaced_out(c: Column) -> Column:
    """Whether five or more one-letter words stand in a row."""
    return c.rlike(r"(?:^|\s)(?:[A-Za-z]\s+){4}[A-Za-z](?:\s|$)")


def answer_norm(kind: Column, c: Column) -> Column:
    return F.when((kind == "true_false") | spaced_out(c), loose(squeeze_lower(c))).otherwise(squeeze_lower(c))


def compare_key(values: Column) -> Column:
    """Sorted normalised values joined by a bar."""
    return F.array_join(F.array_sort(F.transform(values, squeeze_lower)), "|")


def option_key(labels: Column, assignment: Column) -> Column:
    return F.concat(F.lit("opt:"), F.array_join(F.array_sort(F.transform(labels, lambda x: F.upper(F.trim(x)))), ","), F.lit(":"), assignment)


def display_answer(json: Column, placeholder: str = "—") -> Column:
    """A JSON answer for people: null or blank is the placeholder, arrays
    lose blanks and are joined, a string is itself, other JSON its text."""
    items = F.from_json(json, "array<string>")
    joined = F.array_join(F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != "")), " / ")
    text = F.from_json(F.concat(F.lit('{"v":'), json, F.lit("}")), "v string")["v"]
    value = F.when(json.rlike(r"^\s*\["), joined).when(json.rlike(r'^\s*"'), text).when(F.trim(json) == "null", None).otherwise(json)
    return F.when(value.isNull() | (F.trim(value) == ""), placeholder).otherwise(value)


def label(category: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(category), F.lit("")), F.concat(F.lit("P"), (index + 1).cast("string")))


def task_label(kind: Column, labels: dict[str, str]) -> Column:
    flat = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.create_map(*flat)[kind], kind)


def sentences(c: Column) -> Column:
    """Pieces that end in . ! or ?, else the whole text; blanks dropped."""
    parts = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), F.trim), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.array(F.trim(c))).otherwise(parts)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length, over characters; two empties are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def range_numbers(c: Column, low: int = 1, high: int = 60) -> Column:
    """"a-b", "a to b", "a and b" or "a" as (first, last); null out of bounds."""
    t = F.lower(F.translate(c, DASHES, "-" * len(DASHES)))
    a = F.try_to_number(F.nullif(F.regexp_extract(t, r"(\d{1,3})", 1), F.lit("")), F.lit("999")).cast("int")
    b = F.try_to_number(F.nullif(F.regexp_extract(t, r"\d{1,3}\s*(?:-|to|and)\s*(\d{1,3})", 1), F.lit("")), F.lit("999")).cast("int")
    last = F.coalesce(b, a)
    return F.when((a >= low) & (last <= high) & (a <= last), F.struct(a.alias("first"), last.alias("last")))


def digit_tokens(c: Column, high: int = 200) -> Column:
    runs = F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{1,3})(?!\d)"), F.lit(1))
    return F.filter(F.transform(runs, lambda x: x.cast("int")), lambda x: (x >= 1) & (x <= high))


def answer_rows(c: Column) -> Column:
    """"12. text" lines as (number, answer): short answers only, first wins."""
    pattern = r"^\s*(\d{1,3})[.)\]:-]*\s*(.+)$"
    rows = F.transform(F.split(c, "\n"), lambda l: F.struct(F.try_to_number(F.nullif(F.regexp_extract(l, pattern, 1), F.lit("")), F.lit("999")).cast("int").alias("number"), F.trim(F.regexp_extract(l, pattern, 2)).alias("answer")))
    good = F.filter(
        rows,
        lambda r: r["number"].between(1, 200) & (F.length(r["answer"]) <= 40) & (F.size(tokens(r["answer"])) <= 6) & (r["answer"] != "") & ~r["answer"].rlike(r"(?i)https?://|www\."),
    )
    return F.aggregate(
        good,
        F.array().cast("array<struct<number:int,answer:string>>"),
        lambda acc, r: F.when(F.exists(acc, lambda x: x["number"] == r["number"]), acc).otherwise(F.concat(acc, F.array(r))),
    )


def option_label(c: Column) -> Column:
    """Leading "A.", "(i)" or "1)" as (label, text)."""
    pattern = r"^\s*\(?([A-Za-z]|[ivxIVX]{1,5}|\d{1,2})[.)]\s+(.*)$"
    return F.struct(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).alias("label"), F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 2)).otherwise(c).alias("text"))


def heading(c: Column) -> Column:
    key = alnum_key(c)
    return F.when(key.rlike("^(?:reading)?passage\\d"), "passage").when(key.rlike("^test\\d"), "test").when(key.rlike("^(?:answerkeys?|answers)"), "answers")


def html_strip(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def natural_key(c: Column) -> Column:
    """Sort key with every run of digits padded, so 2 comes before 10."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=\\d)", ""), 12, "0")).otherwise(p)), "")


def safe_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~c.contains("..")


def part_detect(manual: Column, heading_part: Column, numbers: Column, file_name: Column) -> Column:
    """Part by precedence: manual, content heading, number band, file name."""
    lo, hi = F.array_min(numbers), F.array_max(numbers)
    band = F.when((lo >= 1) & (hi <= 13), 1).when((lo >= 14) & (hi <= 26), 2).when((lo >= 27) & (hi <= 40), 3)
    contiguous = F.size(F.array_distinct(numbers)) == hi - lo + 1
    name = F.regexp_extract(F.lower(file_name), r"(?:^|[^a-z0-9])p(?:art|assage)?[ _-]?([1-3])(?:$|[^0-9])", 1)
    return F.coalesce(manual, heading_part, F.when(contiguous, band), F.try_to_number(F.nullif(name, F.lit("")), F.lit("9")).cast("int"))


def token_estimate(c: Column, images: Column | int = 0) -> Column:
    """ceil(0.3 per ASCII character + 0.6 per other), 1024 for an image."""
    other = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    ascii_ = F.length(c) - other
    images = F.lit(images) if isinstance(images, int) else images
    return F.ceil((ascii_ * 3 + other * 6) / 10) + images * 1024


#: Cues of block roles, first match first (fixed values).
ROLES = (
    ("instruction", r"(?i)\b(choose|complete|write|answer) (the|no more|one|your)\b"),
    ("question", r"^\s*\d{1,2}[.)]\s"),
    ("option", r"^\s*[A-H][.)]\s"),
    ("heading", r"^[^a-z.!?]{3,60}$"),
)


def block_role(c: Column) -> Column:
    out = F.when(F.lit(False), "")
    for role, pattern in ROLES:
        out = out.when(c.rlike(pattern), role)
    return out.otherwise("text")
