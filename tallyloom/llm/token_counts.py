"""Exact token counts at every prefix, by dynamic programming.

For byte-pair merges, a sequence of tokens is the encoding of its bytes if and
only if each two neighbours are the encoding of theirs. So the last token of
the encoding of a prefix is the one vocabulary entry that ends the prefix and
is a valid neighbour of the last token of the prefix before it, and

    count(prefix) = count(prefix without its last token) + 1.

Chunks with characters that the Unicode tables here don't know go to the
library itself, as its tables may be newer.

With word-end symbols a prefix has two states: followed by more of the word
(open), or cut there (closed, its last symbol is the word-end form). Both are
kept, so a text truncated anywhere is answered without encoding it again.
Distinct new words of a batch are sorted; states of a shared prefix are reused.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level files."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(spare)) for b in range(256)]


NEVER = float("inf")
SEPARATORS = regex.compile("[\x1c-\x1f]").search


UNASSIGNED = regex.compile(r"\p{Cn}").search


def strange(chunk: str) -> bool:
    """Whether a chunk holds a character that one of the Unicode tables at
    hand doesn't know: newer tables may class, fold or compose it."""
    return not chunk.isascii() and (UNASSIGNED(chunk) is not None or any(unicodedata.category(c) == "Cn" for c in chunk))


class PrefixCounter:
    """Prefix token counts under one byte-pair vocabulary with word ends."""

    def __init__(self, path: str, most_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: frozenset[str] = frozenset(model["vocab"])
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.letters = str.maketrans({i: c for i, c in enumerate(_byte_letters())})
        self.longest = max(map(len, self.vocab))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)).split if self.special else None
        self.known: dict[str, int] = {}
        self.counts: dict[str, int] = {}
        self.most_words = most_words
        self.joins: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple | None] = {}
        self.path, self.library = path, None

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _edges(self, token: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """The symbols that stand at the left and right edge while the token
        is merged, each with the rank of the merge that takes it; None if
        merging its letters doesn't give the token."""
        if token not in self.edges:
            symbols, left, right = self._symbols(token), [], []
            while len(symbols) > 1:
                at = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), NEVER))
                pair = (symbols[at], symbols[at + 1])
                rank = self.rank.get(pair, NEVER)
                if rank == NEVER:
                    break
                first, final, out, i = symbols[0], symbols[-1], [], 0
                while i < len(symbols):
                    step = 2 if tuple(symbols[i : i + 2]) == pair else 1
                    out.append("".join(symbols[i : i + step]))
                    i += step
                symbols = out
                if symbols[0] != first:
                    left.append((first, rank))
                if symbols[-1] != final:
                    right.append((final, rank))
            whole = symbols == [token]
            self.edges[token] = ([*left, (token, NEVER)], [*right, (token, NEVER)]) if whole else None
        return self.edges[token]

    def _fits(self, left: str, right: str) -> bool:
        """Whether the two tokens are the encoding of what they spell: no
        merge across their border comes before those that take its sides
        (of two equal merges that overlap the left one comes first)."""
        key = (left, right)
        if (known := self.joins.get(key)) is None:
            if len(self.joins) > 1_000_000:
                self.joins.clear()
            a, b = self._edges(left), self._edges(right)
            known = self.joins[key] = (
                a is not None and b is not None and not any((r := self.rank.get((x, y), NEVER)) < gone_x and r <= gone_y and r < NEVER for x, gone_x in a[1] for y, gone_y in b[0])
            )
        return known

    def _last(self, word: str, i: int, ends: str, last: list[str], count: list[int]) -> tuple[str, int]:
        """The last token of word[:i] and the count there."""
        vocab = self.vocab
        for j in range(max(0, i - self.longest), i):
            token = word[j:i] + ends
            if token in vocab and (self._edges(token) is not None if j == 0 else self._fits(last[j], token)):
                return token, count[j] + 1
        raise ValueError(f"no token ends {word[:i]!r}")

    def _spelled(self, word: str) -> str:
        return "".join(map(chr, word.encode())).translate(self.letters)

    def learn(self, words: list[str]) -> None:
        """Count the tokens of new words, each once, in sorted order."""
        word0, last, count = "", [""], [0]
        for word, raw in sorted((self._spelled(w), w) for w in words):
            shared = 0
            for a, b in zip(word0, word):
                if a != b:
                    break
                shared += 1
            shared = min(shared, len(last) - 1)
            del last[shared + 1 :], count[shared + 1 :]
            for i in range(shared + 1, len(word)):
                token, n = self._last(word, i, "", last, count)
                last.append(token)
                count.append(n)
            self.known[raw] = self._last(word, len(word), self.end, last, count)[1]
            word0 = word

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of the word's first byte, first two ... each cut there."""
        word, last, count, out = self._spelled(word), [""], [0], []
        for i in range(1, len(word) + 1):
            out.append(self._last(word, i, self.end, last, count)[1])
            token, n = self._last(word, i, "", last, count)
            last.append(token)
            count.append(n)
        return out

    def pieces(self, text: str) -> list[str | None]:
        """The words of a text, normalised; None for a special token."""
        if "<|" in text and self.special_split:
            parts = [p for p in self.special_split(text) if p]
        else:
            parts = [text]
        out: list[str | None] = []
        for part in parts:
            if part in self.special:
                out.append(None)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
                # One character at a time where context would change the case.
                part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
                out += self.words(part)
            else:
                out += self.words(part.lower())
        return out

    def chunks(self, text: str) -> list[str]:
        """Parts between white space: no word, mark or token crosses it.

        Only the four separators that ``str.split`` takes for white space and
        the vocabulary doesn't keep a text from being cut at all of it.
        """
        return text.split(" ") if SEPARATORS(text) else text.split()

    def count_batch(self, texts: list[str | None]) -> list[int]:
        """Token counts of whole texts; a null text has none."""
        split = [self.chunks(t) if t else [] for t in texts]
        if len(self.counts) > self.most_words:
            self.counts.clear()
        if len(self.known) > self.most_words:
            self.known.clear()
        new: dict[str, list[str | None]] = {}
        for p in split:
            for c in p:
                if c not in self.counts and c not in new:
                    new[c] = self.pieces(c)
        self.learn([w for w in set().union(*new.values()) if w is not None and w not in self.known])
        for c, ws in new.items():
            self.counts[c] = self.by_library(c) if strange(c) else sum(1 if w is None else self.known[w] for w in ws)
        get = self.counts.__getitem__
        return [sum(map(get, p)) for p in split]

    def by_library(self, chunk: str) -> int:
        """The tokenizer library's own count."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return len(self.library.encode(chunk, add_special_tokens=False).ids)

    def prefix_table(self, text: str) -> list[int]:
        """Cumulative token counts at the end of each word of a text."""
        self.count_batch([text])
        total, out = 0, []
        for p in self.pieces(text):
            total += 1 if p is None else self.known[p]
            out.append(total)
        return out


def words_within(prefix: list[int], budget: int) -> int:
    """How many leading words fit a token budget: a search in the table."""
    return bisect_right(prefix, budget)


_counters: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch whose texts hold about ``most`` characters at most."""
    start, texts, size = 0, [], 0
    for i, v in enumerate(batch.column(column)):
        t = v.as_py()
        texts.append(t)
        size += len(t or "")
        if size >= most:
            yield batch.slice(start, len(texts)), texts
            start, texts, size = i + 1, [], 0
    if texts:
        yield batch.slice(start, len(texts)), texts


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    ``path`` names the vocabulary file on every machine. Null and empty texts
    have 0 bytes and 0 tokens; rows are counted one by one, whatever their id,
    null or repeated; other columns are not read; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part, texts in _slices(batch, "text"):
                n = counter.count_batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    t = F.col(text)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("n_bytes"), t.alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def prefix_tables(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, prefix array<int>): the stored table of every text, by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part, texts in _slices(batch, "text"):
                rows = [counter.prefix_table(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "prefix"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, prefix array<int>")
