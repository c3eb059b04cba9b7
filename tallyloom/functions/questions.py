"""Question numbers, answer lines and alignment reports."""

from __future__ import annotations

import re
from collections import Counter

from tallyloom.functions.similarity import lis_length

DASH = re.compile("[‐‑‒–—―−]")
ITEM = re.compile(r"\s*(\d{1,3})(?:\s*(?:-\s*|to\s+)(\d{1,3}))?", re.I)
JOIN = re.compile(r"\s*,\s*(?:and\b\s*)?|\s+and\b\s*", re.I)
HEAD = re.compile(r"^\s*questions?\b[\s:]*", re.I)


def question_numbers(text: str) -> tuple[str, list[int]] | None:
    """(kind, numbers) of "Questions 1–6, 8 and 10": a range, a set of single
    numbers or a mix. None unless every range rises and all numbers strictly
    increase; text after the expression is left alone."""
    rest, at = HEAD.sub("", DASH.sub("-", text)), 0
    spans: list[tuple[int, int]] = []
    while m := ITEM.match(rest, at):
        first, last = int(m[1]), int(m[2] or m[1])
        if m[2] and last <= first:
            return None
        spans.append((first, last))
        if not (j := JOIN.match(rest, m.end())):
            break
        at = j.end()
    if not spans or any(b[0] <= a[1] for a, b in zip(spans, spans[1:])):
        return None
    ranged = [a < b for a, b in spans]
    kind = ("range" if len(spans) == 1 else "mixed") if any(ranged) else "set"
    return kind, [n for a, b in spans for n in range(a, b + 1)]


def answer_pairs(line: str) -> list[tuple[int, str]]:
    """Numbers and answers of a line such as "1 TRUE   14 C". A number right
    after a number is its answer; answers over eight words are dropped."""
    out: list[tuple[int, list[str]]] = []
    for word in line.split():
        bare = word.rstrip(".)")
        number = int(bare) if bare.isascii() and bare.isdigit() and 1 <= int(bare) <= 40 else None
        if number is None:
            if not out:
                return []
            out[-1][1].append(word)
        elif out and not out[-1][1]:
            out[-1][1].append(word)
        else:
            out.append((number, []))
    return [(n, " ".join(a)) for n, a in out if 1 <= len(a) <= 8]


def alignment_report(matches: list[tuple[str, float, int]], source_chars: int, text_chars: int, covered: float) -> dict:
    """Verdicts over (sentence, similarity, place) of a text against a source.

    Sentences under 3 characters don't count. Order is judged over sentences
    of 5 words or more that occur once.
    """
    real = [m for m in matches if len(m[0]) >= 3]
    good = [m for m in real if m[1] >= 0.8]
    invented = sum(m[1] < 0.6 for m in real)
    times = Counter(m[0] for m in real)
    places = [p for t, s, p in good if p >= 0 and len(t.split()) >= 5 and times[t] == 1]
    order = lis_length(places) / len(places) if places else 1.0
    ratio = text_chars / source_chars if source_chars else 0.0
    share = len(good) / len(real) if real else 1.0
    return {
        "matched": share, "matched_ok": share >= 0.8, "invented": invented, "invented_ok": invented <= 2 and invented <= 0.03 * len(real),
        "length_ok": 0.5 <= ratio <= 1.5, "coverage_ok": covered >= 0.7, "order": order, "order_ok": order >= 0.95,
    }


def shuffled(items: list, seed: str, n: int) -> list:
    """n items by a Fisher-Yates shuffle over a 32-bit generator that mixes a
    counter; the same seed gives the same draw."""
    state = 0
    for c in seed.encode():
        state = (state * 31 + c) & 0xFFFFFFFF
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        z = ((state ^ (state >> 15)) * (1 | state)) & 0xFFFFFFFF
        z ^= (z + ((z ^ (z >> 7)) * (61 | z))) & 0xFFFFFFFF
        j = int(((z ^ (z >> 14)) & 0xFFFFFFFF) / 4294967296 * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out[:n]


def dependency_groups(responses: list[tuple[str, str, list[str]]]) -> dict[str, str]:
    """Slot to group for responses (id, assignment, slots) whose answers can't
    be judged slot by slot."""
    return {slot: f"response {rid}" for rid, assignment, slots in responses if (assignment or "per_slot") != "per_slot" for slot in slots}
