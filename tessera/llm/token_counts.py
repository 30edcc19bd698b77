"""Token counts at every prefix of a text by dynamic programming over its pre-tokens, equal to the library's own counts."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
#: Words, and pieces of words, whose counts a task keeps, of at most so many characters.
CACHE_WORDS, CACHE_LENGTH = 250_000, 64
#: Fixed values of word_bpe_49k.json: its split pattern and the added tokens that the library finds in the raw text first.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ADDED = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>")
#: Texts of these characters alone are lower-cased by Python as by the library; others go through its normalizer.
PLAIN = regex.compile(r"[\x00-\u024F\u2000-\u206F\u4E00-\u9FFF]*")
ODD = regex.compile("[İ\x1c-\x1f\x85]")
#: No piece goes over white space, so a text is a row of words. What Python's own split takes for white space beside that:
WORD, NO_SPACE = regex.compile(r"\S+"), regex.compile("[\x1c-\x1f]")


def _letters() -> dict[int, str]:
    """The sign that the library's byte-level vocabulary has for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


LETTERS = _letters()


class _Known(dict):
    """Counts by string, bounded; what is asked for and not there is counted."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, text: str) -> int:
        n = self.count(text)
        if len(text) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[text] = n
        return n


class Counter:
    """Counts with one tokenizer file; the counts of words and of their pre-tokens are cached, bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.known = _Known(self._tokens)
        self._piece = self.known.__getitem__  # tokens of one pre-token
        self.words = _Known(lambda word: sum(map(self._piece, SPLIT.findall(word))))
        self.inside: dict[str, list[int]] = {}

    def _tokens(self, piece: str) -> int:
        """Tokens of one pre-token, by the library's own model."""
        plain = piece.isascii() and piece.isprintable()
        return len(self.model.tokenize(piece if plain else piece.encode().decode("latin-1").translate(LETTERS)))

    def _normal(self, text: str) -> str:
        if text.isascii() and not ODD.search(text):
            return text.lower()
        if PLAIN.fullmatch(text) and not ODD.search(text):
            return unicodedata.normalize("NFC", text).lower()
        return self.tok.normalizer.normalize_str(text)

    def prefix(self, text: str) -> tuple[np.ndarray, np.ndarray, str]:
        """(ends, counts, normal text): counts[i] is the number of tokens of the prefix that ends at code point ends[i]
        of the normal text. Prefixes that end between those are ``at`` the piece's own prefix."""
        ends, counts, total, base, whole = [0], [0], 0, 0, []
        at = 0
        spans = [(m.start(), m.end()) for m in ADDED.finditer(text)]
        for start, end in [*spans, (len(text), len(text))]:
            part = self._normal(text[at:start])
            for m in SPLIT.finditer(part):
                total += self._piece(m.group())
                ends.append(base + m.end())
                counts.append(total)
            whole.append(part)
            base += len(part)
            if end > start:
                total += 1
                base += end - start
                whole.append(text[start:end])
                ends.append(base)
                counts.append(total)
            at = end
        return np.array(ends, np.int64), np.array(counts, np.int64), "".join(whole)

    def counts(self, text: str) -> list[int]:
        """Tokens of the prefix that ends with each word, from that before it and the word's own; 0 first."""
        total, at, out = 0, 0, []
        for m in [*ADDED.finditer(text), None] if "<|" in text else [None]:
            part = self._normal(text[at : m.start() if m else len(text)])
            words = WORD.findall(part) if NO_SPACE.search(part) else part.split()
            out += accumulate(map(self.words.__getitem__, words), initial=total)
            if m:
                out.append(out[-1] + 1)
                at = m.end()
            total = out[-1]
        return out

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last of its prefix counts."""
        return self.counts(text)[-1]

    def _inner(self, piece: str) -> list[int]:
        """Tokens of every prefix of a piece, by code points; worked out once a distinct piece."""
        found = self.inside.get(piece)
        if found is None:
            if len(self.inside) >= CACHE_WORDS // 10:
                self.inside.clear()
            found = self.inside[piece] = [sum(map(self._piece, SPLIT.findall(piece[:k]))) for k in range(len(piece) + 1)]
        return found

    def at(self, table: tuple[np.ndarray, np.ndarray, str], n_chars: int) -> int:
        """Tokens of the first n_chars code points of the normal text: the table's count before the piece cut there, and the
        count of that piece's own prefix."""
        ends, counts, text = table
        i = bisect_right(ends, n_chars) - 1
        m = SPLIT.search(text, int(ends[i]))
        inside = n_chars - m.start() if m else 0
        return int(counts[i]) + (self._inner(m.group())[inside] if inside > 0 else 0)

    def fit(self, table: tuple[np.ndarray, np.ndarray, str], limit: int) -> int:
        """Code points of the longest prefix of whole pieces with at most ``limit`` tokens."""
        ends, counts, _ = table
        return int(ends[bisect_right(counts, limit) - 1])

    def fitting(self, text: str, counts: list[int], limit: int) -> int:
        """``fit`` of a text over the limit by its ``counts``: only the word where it is passed is taken apart."""
        if "<|" in text and ADDED.search(text):
            return self.fit(self.prefix(text), limit)
        normal, whole = self._normal(text), bisect_right(counts, limit) - 1
        spans = islice(WORD.finditer(normal), max(0, whole - 1), whole + 1)
        end, total = next(spans).end() if whole else 0, counts[whole]
        for m in SPLIT.finditer(normal, next(spans).start()):
            total += self._piece(m.group())
            if total > limit:
                break
            end = m.end()
        return end


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (normal code points that fit the limit) of every whole text.

    Null texts count as empty. Rows are independent, so repeated rows, null ids and any columns more change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            n_bytes, n_tokens, fits = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                counts = counter.counts(text)
                n = counts[-1]
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_tokens.append(n)
                fits.append(counter.fitting(text, counts, limit) if n > limit else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored tables: doc_id, ends array<long>, counts array<long>; later budget questions read these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            tables = [counter.prefix(v.as_py() or "") for v in batch.column(1)]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t[0] for t in tables], longs), pa.array([t[1] for t in tables], longs)], names=["doc_id", "ends", "counts"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ends array<long>, counts array<long>")
