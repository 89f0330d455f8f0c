"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features of a whole text: densities, counts and distinct counts of lexicon words and lexicon stems, the summed
weights of both, how close they stand to second-person words, rates of second-person words, capitals,
punctuation and exclamation marks, rates of obfuscated words (signs or digits inside a word, a lexicon word
behind look-alike signs, letters repeated three times) and the length.

The lexicon is learned: words, and stems of four to seven letters, whose document frequency among
toxic training rows exceeds that among the others by far. To keep a row from scoring its own words, training rows
get their features from a lexicon of the other half of the rows (split by a hash). Trees (logistic loss,
histogram splits) are fitted on those; scores of left-out thirds calibrate the margin by
pool-adjacent-violators, interpolated between blocks.

The classifier is fitted on the driver on a bounded sample: at most `max_rows` labelled rows, those with the
smallest hash of their id; an id gives one row, its first text in order, of which `row_chars` characters at most. Scoring is one pass over all documents without a shuffle.

Defined cases: null and empty texts are scored like any other (all features 0); repeated label rows
of an id count once, toxic if any of them is; labels with null toxic or without a document are not used. With no
training rows, or with one class only, every score is the share of toxic rows (0 without rows). Ties cannot occur;
repeated rows get equal scores; an empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filtered, held_out, share, table, text_slices, tidy

WORDS = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"[^\W\d_]+(?:[0-9@$!*+|.]+[^\W\d_]+)+")
LOOK_ALIKE = str.maketrans("013457@$!|+", "oieastasiit", "*.")
#: Second-person words of the languages at hand.
YOU = frozenset("you your yours yourself youre ya u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen deiner ihr euch euer tú ti tuyo tuya usted ustedes vosotros os".split())
STEMS = (4, 5, 6, 7)
NOTHING = (0.0, 0.0)  # the weights of words outside the lexicon
NAMES = ("log_words", "word_density", "log_word_hits", "distinct_words", "stem_density", "log_stem_hits", "distinct_stems", "weight_density", "log_weight", "top_weight", "near_you", "you_density", "capitals", "punctuation", "exclaim", "obfuscated", "unmasked", "repeats")


@dataclass(frozen=True)
class Toxic:
    """max_rows: bound of the labelled sample; rounds, depth, rate, bins, leaf: of the trees; least_docs: toxic rows that a lexicon entry needs; least_weight: its log odds; near: words to a second-person word; remembered: words whose weights a worker keeps; row_chars: of a sampled text, so that the sample is bounded in characters too."""

    max_rows: int = 6_000
    rounds: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 48
    leaf: float = 4.0
    least_docs: int = 3
    least_weight: float = 1.2
    near: int = 6
    remembered: int = 1 << 16
    row_chars: int = 1 << 16


class Lexicon:
    def __init__(self, texts: list[str], labels: np.ndarray, p: Toxic):
        toxic, other = Counter(), Counter()
        keys = lambda text: (w for word in set(WORDS.findall(text.lower())) for w in (word, *((word[:n],) for n in STEMS if len(word) >= n)))
        for text in itertools.compress(texts, labels):
            toxic.update(set(keys(text)))
        toxic = Counter({w: t for w, t in toxic.items() if t >= p.least_docs})
        for text in itertools.compress(texts, 1 - labels):  # only what may enter the lexicon is counted
            other.update({w for w in keys(text) if w in toxic})
        n, m = float(labels.sum()), float(len(labels) - labels.sum())
        self.weights: dict = {}
        for w, t in toxic.items():
            weight = math.log((t + 0.5) / (n + 1)) - math.log((other[w] + 0.5) / (m + 1))
            expected = other[w] * n / max(m, 1.0)
            if weight >= p.least_weight and t - expected >= 3.5 * math.sqrt(expected + 1):
                self.weights[w] = weight
        self.known: dict[str, tuple[float, float]] = {}
        self.p = p

    def of(self, word: str) -> tuple[float, float]:
        """Weights of a word and of its heaviest stem, 0 where it has none."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.p.remembered:
                self.known.clear()
            stem = max((self.weights.get((word[:n],), 0.0) for n in STEMS if len(word) >= n), default=0.0)
            found = (self.weights.get(word, 0.0), stem)
            found = self.known[word] = found if found != NOTHING else NOTHING
        return found

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words = WORDS.findall(low)
        n = max(1, len(words))
        known, of = self.known, self.of
        codes = [known.get(w) or of(w) for w in words]
        hits = [(k, c) for k, c in enumerate(codes) if c is not NOTHING]
        word_hits = [k for k, c in hits if c[0]]
        stem_hits = [k for k, c in hits if c[1]]
        total = sum(max(c) for _, c in hits)
        tops = sorted({words[k]: max(c) for k, c in hits}.values(), reverse=True)[:5]
        you = np.array([k for k, w in enumerate(words) if w in YOU]) if not YOU.isdisjoint(words) else np.empty(0, dtype=int)
        close = 0
        if len(you) and hits:
            at = np.array([k for k, _ in hits])
            right = np.searchsorted(you, at)
            gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - at), np.abs(you[np.maximum(right - 1, 0)] - at))
            close = int((gap <= self.p.near).sum())
        a = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        count = np.bincount(a, minlength=256)
        size = max(1, len(a))
        letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
        marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
        masked = OBFUSCATED.findall(low) if count[[33, 36, 42, 43, 64, 124, *range(46, 47), *range(48, 58)]].any() else []
        bare = sum(1 for w in masked if max(of(w.translate(LOOK_ALIKE))) > 0)
        same = int(((a[2:] == a[1:-1]) & (a[1:-1] == a[:-2]) & (a[2:] > 64)).sum()) if len(a) > 2 else 0
        return [
            math.log1p(len(words)), len(word_hits) / n, math.log1p(len(word_hits)), math.log1p(len({words[k] for k in word_hits})),
            len(stem_hits) / n, math.log1p(len(stem_hits)), math.log1p(len({words[k] for k in stem_hits})), total / n, math.log1p(total), sum(tops),
            close / n, len(you) / n, count[65:91].sum() / letters, marks / size, count[33] / size, len(masked) / n, bare / n, same / size,
        ]


class Trees:
    """Gradient-boosted trees of a fixed depth on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, p: Toxic):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, p.bins + 1)[1:-1], method="higher")) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = math.log(share / (1 - share))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = np.full(len(y), self.base)
        width = p.bins + 1
        for _ in range(p.rounds):
            prob = 1 / (1 + np.exp(-f))
            grad, hess = y - prob, prob * (1 - prob)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**p.depth - 1, dtype=np.int64), np.full(2**p.depth - 1, np.inf)
            for level in range(p.depth):
                first, nodes = 2**level - 1, 2**level
                best = np.full(nodes, 1e-9)
                split = np.zeros((nodes, 2), dtype=np.int64) - 1
                for j in range(x.shape[1]):
                    key = (node - first) * width + binned[:, j]
                    g = np.bincount(key, grad, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    h = np.bincount(key, hess, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < p.leaf / 4) | (ht - hl < p.leaf / 4)] = 0
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(nodes), k] > best
                    best[better] = gain[np.arange(nodes), k][better]
                    split[better] = np.stack([np.full(nodes, j), k], axis=1)[better]
                go = np.zeros(len(y), dtype=bool)
                for i in range(nodes):
                    j, k = split[i]
                    if j >= 0 and k < len(cuts[j]):
                        feature[first + i], cut[first + i] = j, cuts[j][k]
                        mine = node == first + i
                        go[mine] = binned[mine, j] > k
                node = 2 * node + 1 + go
            leaf = node - (2**p.depth - 1)
            value = p.rate * np.bincount(leaf, grad, 2**p.depth) / (np.bincount(leaf, hess, 2**p.depth) + 1)
            f = f + value[leaf]
            self.trees.append((feature, cut, value))
        self.depth = p.depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, probabilities) that never fall, to be interpolated between."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, t in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t1, n1, m1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t1, blocks[-1][1] + n1, blocks[-1][2] + m1]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], (b[:, 0] + 0.25) / (b[:, 1] + 0.5)


class Model:
    """texts and labels of the sample; half: a bit for each row that splits it in two."""

    def __init__(self, texts: list[str], labels: np.ndarray, half: np.ndarray, p: Toxic):
        self.share = float(labels.mean()) if len(labels) else 0.0
        self.trees = None
        if self.share in (0.0, 1.0) or len(labels) < 8:
            return
        x = np.zeros((len(texts), len(NAMES)))
        for side in (0, 1):
            other = np.flatnonzero(half != side)
            lexicon = Lexicon([texts[k] for k in other], labels[other], p)
            for k in np.flatnonzero(half == side):
                x[k] = lexicon.features(texts[k])
        third = np.arange(len(texts)) % 3
        left = np.zeros(len(texts))
        for k in range(3):
            left[third == k] = Trees(x[third != k], labels[third != k], p).margin(x[third == k])
        self.knots = isotonic(left, labels)
        self.trees = Trees(x, labels, p)
        self.lexicon = Lexicon(texts, labels, p)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([self.lexicon.features(t) for t in texts]).reshape(len(texts), len(NAMES))
        return np.interp(self.trees.margin(x), *self.knots).clip(0.0, 1.0)


def fitted(docs: DataFrame, labels: DataFrame, p: Toxic = Toxic()) -> Model:
    """A model from at most max_rows labelled rows outside the test fold."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", F.xxhash64("doc_id", F.lit(7)).alias("h"))
    rows = rows.groupBy("doc_id", "toxic", "h").agg(F.substring(F.min("text"), 1, p.row_chars).alias("text"))
    sample = sorted(rows.collect(), key=lambda r: (r["h"], r["doc_id"], r["text"]))
    return Model([r["text"] for r in sample], np.array([float(r["toxic"] > 0) for r in sample]), np.array([r["h"] & 1 for r in sample]), p)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxicity) of every row."""
    shared = share(docs.sparkSession, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(shared.value.scores(texts))], names=["doc_id", "toxicity"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(score), "doc_id long, toxicity double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs' rows, all columns, without those that score threshold or more."""
    shared = share(docs.sparkSession, model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_slices(batch.column("text")):
                yield batch.slice(a, len(texts)).filter(pa.array(shared.value.scores(texts) < threshold))

    return filtered(docs, keep)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
