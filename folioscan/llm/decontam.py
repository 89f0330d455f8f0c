"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and runs of white space become one space. A document is contaminated by a benchmark
item if somewhere it holds the item with at most k edits (insertions, deletions, substitutions of
characters), k = edit_rate of the item's length. An item longer than `most_chars` is looked for in
overlapping pieces of that length. Every item of `least_part` * 4 / 3 characters or more is also looked for in half
overlapping parts of `part_chars` characters or, if fewer, three quarters of its length, so that a contiguous part of it
is found too; shorter items are looked for as a whole only. A place of the whole is reported before one of a part.

By the q-gram lemma a copy of an m-character piece with k edits shares at least m + 1 - q - k q of the
piece's q-grams with it, all on diagonals (text position minus piece position) at most 2 k apart. All q-grams of
a text are hashed at once (four vector operations for q = 12), tested against a bit table and looked up in
the sorted q-grams of the benchmark. Hits are counted in diagonal bands of width 2 w that overlap by w
(w > 2 k), so any such copy falls into one band whole; bands with enough hits are kept, and a banded
alignment decides: the piece against the text around the band, free at both ends. No copy within the
budget is missed; a piece shorter than q characters must occur exactly.

The benchmark is measured first: it is sent to the tasks in blocks of at most `block_chars` characters,
one pass over the documents for each block.

Defined cases: null or empty text is clean; a null, empty or blank item matches nothing; repeated
items are each reported, repeated documents too; a null id keeps its row. Long texts are scanned in
overlapping blocks, so memory does not grow with a text. Empty tables give no rows. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filtered, mix64, share, table, text_slices, tidy


@dataclass(frozen=True)
class Lemma:
    """q: characters of a q-gram (12). edit_rate: edits by character of the item. most_chars: longer items are cut into pieces of this length, half overlapping. part_chars: of the parts that each item is also looked for in; least_part: no part is shorter. block_chars: benchmark characters sent to tasks at once. scan_chars: text characters looked at together."""

    q: int = 12
    edit_rate: float = 0.05
    most_chars: int = 400
    part_chars: int = 200
    least_part: int = 64
    block_chars: int = 4_000_000
    scan_chars: int = 1 << 19

    def budget(self, m: int) -> int:
        """Edits allowed in m characters, at most as many as leave one q-gram that must be shared."""
        return max(0, min(int(m * self.edit_rate), (m - self.q) // self.q))


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def qgrams(a: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams of an array of code points, by doubling."""
    if len(a) < q:
        return np.empty(0, dtype=np.uint64)
    base, width, power = 0x9E3779B97F4A7C15, 1, 0x9E3779B97F4A7C15
    h = a.astype(np.uint64) + np.uint64(1)
    done, have = None, 0
    while True:
        if q & width:
            if done is None:
                done, have = h, width
            else:  # the widths already joined stand before this one
                n = len(a) - have - width + 1
                done = done[:n] * np.uint64(pow(base, width, 1 << 64)) + h[have : have + n]
                have += width
        if have == q:
            return mix64(done[: len(a) - q + 1])
        n = len(h) - width
        h = h[:n] * np.uint64(power) + h[width : width + n]
        width, power = 2 * width, power * power & (1 << 64) - 1


class Index:
    """The q-grams of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], lemma: Lemma):
        self.lemma = lemma
        self.pieces: list[tuple[int, np.ndarray, int]] = []  # item id, code points, edits
        self.part: list[bool] = []  # of a piece: whether it is a part
        self.short: list[tuple[int, str]] = []
        for item, text in items:
            text = normalise(text)
            if text and len(text) < lemma.q:
                self.short.append((item, text))
                continue
            part = min(lemma.part_chars, -(-3 * len(text) // 4))
            for length in [lemma.most_chars] + [part] * (lemma.least_part <= part < lemma.most_chars):
                cuts = [0] if len(text) <= length else [*range(0, len(text) - length, length // 2), len(text) - length]
                for c in cuts if text else []:
                    a = code_points(text[c : c + length])
                    self.pieces.append((item, a, lemma.budget(len(a))))
                    self.part.append(length < lemma.most_chars)
        self.strings = [a.tobytes().decode("utf-32-le", "surrogatepass") for _, a, _ in self.pieces]
        grams = [qgrams(a, lemma.q) for _, a, _ in self.pieces]
        every = np.concatenate([np.empty(0, dtype=np.uint64), *grams])
        piece = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.empty(0, dtype=np.int64)
        at = np.concatenate([np.empty(0, dtype=np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(every, kind="stable")
        self.piece, self.at = piece[order].astype(np.int64), at[order].astype(np.int64)
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.bits = 22
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[(self.grams >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.edits = np.array([k for _, _, k in self.pieces], dtype=np.int64)
        self.least = np.array([len(a) + 1 - lemma.q - k * lemma.q for _, a, k in self.pieces], dtype=np.int64)
        self.band = 2 * self.edits + 1

    def candidates(self, a: np.ndarray) -> list[tuple[int, int]]:
        """(piece, first diagonal of a band of width 2 w) where a text's code points share enough q-grams."""
        h = qgrams(a, self.lemma.q)
        if not len(h) or not len(self.grams):
            return []
        pos = np.flatnonzero(self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(pos):
            return []
        found = np.searchsorted(self.grams, h[pos])
        found[found == len(self.grams)] = 0
        hit = self.grams[found] == h[pos]
        pos, found = pos[hit], found[hit]
        n = self.count[found]
        entry = np.repeat(self.first[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        piece = self.piece[entry]
        low = (np.repeat(pos, n) - self.at[entry]) // self.band[piece]
        # a hit counts in the band that starts at its own stripe and in the one before
        both = np.concatenate([np.stack([piece, low]), np.stack([piece, low - 1])], axis=1)
        order = np.lexsort((both[1], both[0]))
        both = both[:, order]
        start = np.flatnonzero(np.r_[True, (both[:, 1:] != both[:, :-1]).any(axis=0)]) if both.shape[1] else np.empty(0, dtype=np.int64)
        size = np.diff(np.r_[start, both.shape[1]])
        keep = start[size >= self.least[both[0, start]]]
        return [(int(p), int(b * self.band[p])) for p, b in both[:, keep].T]

    def hits(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """item -> (edits, start, end) in the normalised text, the best place of each."""
        text = normalise(text)
        best: dict[int, tuple[int, int, int, int]] = {}  # part or not, and the place
        for item, s in self.short:
            if (at := text.find(s)) >= 0:
                best[item] = min(best.get(item, (9**9,)), (0, 0, at, at + len(s)))
        overlap = 2 * self.lemma.most_chars
        for start in range(0, max(1, len(text) - overlap), self.lemma.scan_chars):
            block = text[start : start + self.lemma.scan_chars + overlap]
            a = code_points(block)
            for p, diagonal in sorted(self.candidates(a), key=lambda c: self.part[c[0]]):  # wholes first
                item, piece, k = self.pieces[p]
                if self.part[p] and item in best and not best[item][0]:
                    continue  # the whole is reported before a part
                width = 2 * int(self.band[p])
                if (at := block.find(self.strings[p], max(0, diagonal - k), max(0, diagonal + width + k - 1 + len(piece)))) >= 0:
                    found = 0, at, at + len(piece)  # an exact copy needs no alignment
                else:
                    found = align(piece, a, diagonal, width, k)
                if found and (found := (self.part[p], found[0], found[1] + start, found[2] + start)) < best.get(item, (9**9,)):
                    best[item] = found
        return {item: place[1:] for item, place in best.items()}


def align(piece: np.ndarray, text: np.ndarray, diagonal: int, width: int, k: int) -> tuple[int, int, int] | None:
    """The piece against the text on the diagonals [diagonal - k, diagonal + width + k): (edits, start, end) of the best place with at most k edits, or None."""
    lo, n = diagonal - k, width + 2 * k
    d = np.arange(n)
    inside = (lo + d >= 0) & (lo + d <= len(text))
    far = 1 << 20
    cost = np.where(inside, 0, far)  # before the piece's first character any text position is free
    padded = np.full(len(piece) + n + 2, np.uint32(0xFFFFFFFF))
    a, b = max(0, lo), min(len(text), lo + len(piece) + n)
    if a < b:
        padded[a - lo : b - lo] = text[a:b]
    begin = lo + d
    for i, c in enumerate(piece):
        match = cost + (padded[i : i + n] != c)
        gone = np.append(cost[1:], far) + 1  # the piece's character is missing in the text
        new = np.minimum(match, gone)
        origin = np.where(match <= gone, begin, np.append(begin[1:], 0))
        run = new - d  # characters only the text has
        least = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == least, d, 0))
        valid = lo + i + 1 + d
        cost = np.where((valid >= 0) & (valid <= len(text)), least + d, far)
        begin = origin[source]
        if cost.min() > k:
            return None
    best = int(np.argmin(cost))
    return int(cost[best]), int(begin[best]), int(lo + len(piece) + best)


def _blocks(benchmark: DataFrame, lemma: Lemma) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, in blocks that are small enough to be sent to the tasks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("trim(text) <> ''")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, -(-chars // lemma.block_chars))
    for k in range(count):
        block = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield [(r["item_id"], r["text"]) for r in block.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, lemma: Lemma = Lemma()) -> DataFrame:
    """(doc_id, item_id, edits, start_char, end_char): the best place of each item in each document that holds it."""
    found = None
    for items in _blocks(benchmark, lemma):
        index = share(docs.sparkSession, Index(items, lemma))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[a + k], item, *at) for a, texts in text_slices(batch.column(1)) for k, t in enumerate(texts) for item, at in index.value.hits(t).items()]
                kinds = (("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()))
                yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds)})

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(scan), "doc_id long, item_id long, edits int, start_char long, end_char long")
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, lemma: Lemma = Lemma()) -> DataFrame:
    """docs' rows, all columns, without the contaminated ones."""
    for items in _blocks(benchmark, lemma):
        index = share(docs.sparkSession, Index(items, lemma))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, texts in text_slices(batch.column("text")):
                    yield batch.slice(a, len(texts)).filter(pa.array([not index.value.hits(t) for t in texts], pa.bool_()))

        docs = filtered(docs, scan)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
