"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

A text is lower-cased and read as letters and single spaces (everything that is not a letter). Each language has an
interpolated Kneser-Ney model of `order` characters: absolute discounting (n1 / (n1 + 2 n2) for each order) of
counts at the highest order and of continuation counts below, down to the uniform distribution. The
n-grams of all languages share one array for each order, sorted by their 64-bit hash and entered by its
leading bits; beside each n-gram stand its log probabilities in every language, beside each context the
log back-off weights. All positions of a batch are looked up at once, order by order, so a text costs
the same whatever the number of languages seen.

The language with the lowest cross-entropy by character is chosen. A text is rejected where that exceeds the
language's threshold, calibrated on training rows left out of the counts (`patience` standard deviations
above their mean). The operator's `language` is then `und`; `nearest` still tells the best one.

The models are fitted on the driver on a bounded sample: at most `max_rows` rows with a known language,
shared evenly between languages, those with the smallest hash of their id; an id gives a language one row, its first text in order, of which `row_chars` characters at most. Scoring is one pass over all rows.

Defined cases: null text or one without any letter is `und` with score 0; without any training row every text is. Ties go to
the first language by name. Every letter seen in training, of whatever script, has a symbol of its own or, beyond the 3,334
most frequent where there are more than 4,093, a pair of symbols. Repeated rows get equal results; an empty table gives no rows. Letters never seen in
training cost every language the same. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of_texts, held_out, materialise, mix64, share, table, text_slices, tidy

BITS = 12  # of a symbol; five of them fit a key
UNKNOWN = (1 << BITS) - 1
TABLE = 0x110000  # code points
LEADS = 380  # where letters outnumber the symbols, the rarer ones are pairs of a lead and a trail, so many of each


@dataclass(frozen=True)
class Languages:
    """order: characters of an n-gram; max_rows: bound of the sample; patience: of the rejection; row_chars: of a sampled text, so that the sample is bounded in characters too."""

    order: int = 5
    max_rows: int = 6000
    patience: float = 8.0
    row_chars: int = 1 << 16


def _letters() -> np.ndarray:
    out = np.full(TABLE, 32, dtype=np.uint32)
    for c in range(TABLE):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Sorted:
    """Rows of values by hash: a sorted array, entered by the hash's leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix64(keys)
        order = np.argsort(h)
        self.hash, self.values = h[order], values[order].astype(np.float32)
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.enter = np.searchsorted(self.hash, np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits < 64 else None
        self.enter[-1] = len(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it has none."""
        h = mix64(keys)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.enter[top], self.enter[top + 1]
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.flatnonzero(at < end)
        at = at[open_]
        while len(open_):
            same = self.hash[at] == h[open_]
            out[open_[same]] = at[same]
            at = at + 1
            more = ~same & (at < end[open_])
            open_, at = open_[more], at[more]
        return out


class Models:
    def __init__(self, rows: list[tuple[str, str]], p: Languages):
        """rows: (language, text), in a fixed order; every fifth of a language is left out of its counts and calibrates its threshold."""
        self.p = p
        self.names = sorted({lang for lang, _ in rows})
        self.fold = _letters()
        self.symbol, self.trail = np.full(TABLE, UNKNOWN, dtype=np.uint16), np.zeros(TABLE, dtype=np.uint16)
        if not self.names:
            return
        by = {lang: [t for g, t in rows if g == lang] for lang in self.names}
        counted = {lang: [t for k, t in enumerate(ts) if k % 5 or len(ts) < 10] for lang, ts in by.items()}
        left = {lang: [t for k, t in enumerate(ts) if k % 5 == 0] for lang, ts in by.items()}
        seen, times = np.unique(np.concatenate([self._folded(t) for ts in counted.values() for t in ts] + [np.array([32], dtype=np.uint32)]), return_counts=True)
        seen, times = seen[seen != 32], times[seen != 32]
        self.symbol[32] = 0
        if len(seen) < UNKNOWN - 1:
            self.symbol[seen] = np.arange(1, len(seen) + 1)
        else:
            own = UNKNOWN - 2 * LEADS - 1
            seen = seen[np.argsort(-times, kind="stable")]
            self.symbol[seen[:own]] = np.arange(1, own + 1)
            lead, trail = np.divmod(np.arange(len(seen) - own), LEADS)
            self.symbol[seen[own:]], self.trail[seen[own:]] = own + 1 + lead, own + 1 + LEADS + trail
        self._fit([self._symbols(counted[lang])[0] for lang in self.names])
        self.limits = np.full(len(self.names), np.inf)
        for k, lang in enumerate(self.names):
            h = self.entropies(left[lang])[0][:, k]
            h = h[np.isfinite(h)]
            if len(h) >= 5:
                self.limits[k] = h.mean() + p.patience * max(h.std(), 0.02)

    def _folded(self, text: str) -> np.ndarray:
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return self.fold[a]

    def _symbols(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols of all texts with order - 1 spaces before each, whether a position counts, text starts)."""
        pad, parts, starts, at = np.zeros(self.p.order - 1, dtype=np.uint64), [], [], 0
        for t in texts:
            a = self._folded(t or "")
            if len(a):
                keep = np.ones(len(a), dtype=bool)
                keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
                a = a[keep]
            s, trail = self.symbol[a].astype(np.uint64), self.trail[a]
            if trail.any():
                after = np.flatnonzero(trail)
                s = np.insert(s, after + 1, trail[after])
            starts.append(at)
            parts += [pad, s]
            at += len(pad) + len(s)
        x = np.concatenate([np.empty(0, dtype=np.uint64), *parts])
        counts = np.ones(len(x), dtype=bool)
        for s in starts:
            counts[s : s + len(pad)] = False
        return x, counts, np.array(starts, dtype=np.int64)

    def _keys(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k-gram that ends at each position from order - 1 on."""
        first = self.p.order - 1
        key = np.zeros(len(x) - first, dtype=np.uint64)
        for j in range(k):
            key = key << np.uint64(BITS) | x[first - k + 1 + j : len(x) - k + 1 + j]
        return key

    def _fit(self, streams: list[np.ndarray]) -> None:
        n, width = self.p.order, np.uint64(BITS)
        mask = lambda k: np.uint64((1 << BITS * k) - 1)
        size = int(len(np.unique(np.concatenate(streams)))) + 1
        stats = []  # of a language and order: sorted keys, p, contexts, back-off
        for x in streams:
            keys, counts = np.unique(self._keys(x, n), return_counts=True)
            levels = [(keys, counts)]
            for k in range(n - 1, 0, -1):
                levels.append(np.unique(levels[-1][0] & mask(k), return_counts=True))
            prob, out = None, []
            for k, (keys, counts) in enumerate(reversed(levels), 1):
                n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                ctx, back = np.unique(keys >> width, return_inverse=True)
                total, kinds = np.bincount(back, counts), np.bincount(back)
                gamma = d * kinds / total
                lower = np.full(len(keys), 1 / size) if k == 1 else prob[np.searchsorted(out[-1][0], keys & mask(k - 1))]
                prob = np.maximum(counts - d, 0) / total[back] + gamma[back] * lower
                out.append((keys, prob, ctx, gamma))
            stats.append(out)
        self.grams, self.contexts = [], []
        lower_keys = lower = None
        for k in range(1, n + 1):
            level = [s[k - 1] for s in stats]
            keys, ctx = (np.unique(np.concatenate([lv[i] for lv in level])) for i in (0, 2))
            weight = np.zeros((len(ctx), len(streams)))
            logp = np.empty((len(keys), len(streams)))
            for j, (own, prob, own_ctx, gamma) in enumerate(level):
                weight[np.searchsorted(ctx, own_ctx), j] = np.log(gamma)
                below = np.full(len(keys), -np.log(size)) if k == 1 else lower[np.searchsorted(lower_keys, keys & mask(k - 1)), j]
                logp[:, j] = weight[np.searchsorted(ctx, keys >> width), j] + below
                logp[np.searchsorted(keys, own), j] = np.log(prob)
            self.grams.append(Sorted(keys, logp))
            self.contexts.append(Sorted(ctx, weight))
            lower_keys, lower = keys, logp
        self.floor = self.contexts[0].values[0] - np.float32(np.log(size))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in nats a character, by text and language; characters), infinite without characters."""
        n = self.p.order
        x, counts, starts = self._symbols(texts)
        if not len(x):
            return np.full((len(texts), len(self.names)), np.inf), np.zeros(len(texts), dtype=np.int64)
        logp = np.zeros((len(x), len(self.names)), dtype=np.float32)
        open_ = np.flatnonzero(counts[n - 1 :])
        for k in range(n, 0, -1):
            key = self._keys(x, k)[open_]
            found = self.grams[k - 1].find(key)
            hit = found >= 0
            logp[open_[hit] + n - 1] += self.grams[k - 1].values[found[hit]]
            open_, key = open_[~hit], key[~hit]
            if not len(open_):
                break
            if k == 1:
                logp[open_ + n - 1] += self.floor
            else:
                found = self.contexts[k - 1].find(key >> np.uint64(BITS))
                hit = found >= 0
                logp[open_[hit] + n - 1] += self.contexts[k - 1].values[found[hit]]
        chars = np.add.reduceat(counts.astype(np.int64), starts)
        total = np.add.reduceat(logp.astype(np.float64), starts, axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(chars[:, None] > 0, -total / chars[:, None], np.inf), chars

    def predict(self, texts: list[str | None]) -> list[tuple[str, str, float, float]]:
        """(language or und, nearest language or und, score, cross-entropy) of each text."""
        out: list[tuple[str, str, float, float]] = []
        for a, b in batches_of_texts(texts, 1 << 18):
            some = [t if t and any(map(str.isalpha, t)) else None for t in texts[a:b]]
            if not self.names:
                out += [("und", "und", 0.0, 0.0)] * len(some)
                continue
            h, chars = self.entropies(some)
            for k, t in enumerate(some):
                if t is None:
                    out.append(("und", "und", 0.0, 0.0))
                    continue
                best = int(h[k].argmin())
                odds = np.exp(-(h[k] - h[k][best]) * min(int(chars[k]), 200))
                within = bool(h[k][best] <= self.limits[best])
                score = float(1 / odds.sum()) * (1.0 if within else 0.5)
                out.append((self.names[best] if within else "und", self.names[best], score, float(h[k][best])))
        return out


def fitted(docs: DataFrame, p: Languages = Languages()) -> Models:
    """Models from at most max_rows rows with text and language outside the test fold."""
    known = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct()  # an id counts once, however many rows carry it
    counts = materialise(ids.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = max(1, p.max_rows // max(1, counts.count()))
    # The smallest hashes of a language: first all below a bound that twice as many pass, so that no task ranks a whole language.
    bound = (F.least(F.lit(1.0), (2 * share + 100) / F.col("n")) * 2 - 1) * float(1 << 63)
    few = ids.join(counts, "lang").where(F.col("h") <= bound)
    turn = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = few.withColumn("k", F.row_number().over(turn)).where(F.col("k") <= share).select("doc_id", "lang", "h")
    rows = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id", "h").agg(F.substring(F.min("text"), 1, p.row_chars).alias("text")).collect()
    return Models([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"]))], p)


def identified(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, language, nearest, score, cross_entropy) of every row."""
    shared = share(docs.sparkSession, models)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_slices(batch.column(1)):
                rows = shared.value.predict(texts)
                columns = {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("language", pa.string()), ("nearest", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64())))}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, len(texts)), **columns})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(predict), "doc_id long, language string, nearest string, score double, cross_entropy double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs, fitted(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "language", "cross_entropy")
