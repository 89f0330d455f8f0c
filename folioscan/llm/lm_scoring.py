"""LM scoring: masked pseudo-likelihood by a bidirectional window network, trained in numpy.

Every token of a document is predicted from the `window` tokens on both of its sides, itself masked; a
document's score is the sum of the log probabilities of all its tokens given their neighbours.

Tokens are words (lower-cased A-Z). Every word of the corpus has a probability of its own, from an exact distributed
count: the network predicts the most frequent words and, by hash, `buckets` groups of all others, and a word of a group adds
log(count of the word / count of its group), which does not depend on the neighbours. That is the model's bound: only
ids - buckets words are told apart by context. The counts of up to `usual` words are sent to the tasks; the tokens of
all rarer words meet their counts in a join. The network adds the neighbours' embeddings,
each weighted by its place, passes them through tanh and predicts in two steps, a class of 64
ids and the id within the class, so that a token costs 128 outputs instead of 4,096. Its output
biases start at the corpus frequencies, so an untrained network is the unigram model.

Training is data-parallel: in each round every task starts from the broadcast weights, learns from every document of its
share (every `stride`-th position of a text, another residue each round; as many rounds as `stride`, so that each token is a
target once) by Adagrad in small batches, and sends its weights
times its share of all tokens, as integers in slices, so that sums do not depend on the order of tasks and fit 64 bits at every size. Tasks that add the slices hold one sum
each; the driver gets one set of weights (about 1 MB, set by parameters). Tokens counted, tokens learned from and
what is sent grow with the corpus. Which rows share a task follows from the files and their split sizes: the same files read with the same
settings give the same scores, others give slightly different weights, for each task's Adagrad starts anew in each round.

Defined cases: null, empty or blank text has 0 tokens and score 0 (mean null). Neighbours beyond the text are a padding token. Ties in the
count go to the smaller hash. A word never counted is taken as half an occurrence. Repeated rows are scored alike; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_bytes, materialise, scratch, share, shuffle_partitions, table, text_slices, tidy, word_hashes

FIXED_POINT = float(1 << 40)  # of a weight times its task's share of all tokens, so that sums stay small at every size
SLICE = 1 << 12
COUNT_POINT = float(1 << 30)
LEVELS = 8  # levels of word counts in an octave


@dataclass(frozen=True)
class Network:
    """ids: vocabulary with buckets (a multiple of the class size); width of the embeddings; window: neighbours on each side; stride: one of so many positions of a text is learned from in a round, all of them in so many rounds; rate, batch: of Adagrad; usual: at most so many words' counts are sent to the tasks."""

    ids: int = 4096
    buckets: int = 512
    class_size: int = 64
    width: int = 24
    window: int = 2
    rounds: int = 2
    stride: int = 2
    rate: float = 0.08
    batch: int = 8192
    usual: int = 1 << 18

    @property
    def classes(self) -> int:
        return self.ids // self.class_size

    @property
    def kind(self) -> type:
        """Of ids that are sorted: 16 bits are sorted by radix."""
        return np.int16 if self.ids < 1 << 15 else np.int32

    def shapes(self) -> list[tuple[int, ...]]:
        return [(self.ids + 1, self.width), (2 * self.window, self.width), (self.width,), (self.classes, self.width), (self.classes,), (self.classes, self.class_size, self.width), (self.classes, self.class_size)]


class Vocabulary:
    """Word hashes to ids: frequent words first, then buckets by hash. usual: sorted hashes and counts of the words whose level is `least` or more; path: the table of all counts."""

    BITS = 20

    def __init__(self, hashes: np.ndarray, net: Network, buckets: np.ndarray, usual: tuple[np.ndarray, np.ndarray], least: int, path: str):
        self.order = np.argsort(hashes)
        self.sorted, self.net = hashes[self.order], net
        # The id by the leading bits of a hash: -1 no word has them, -2 several have.
        place, times = np.unique(hashes >> np.uint64(64 - self.BITS), return_counts=True)
        self.direct = np.full(1 << self.BITS, -1, dtype=np.int16 if len(hashes) < 1 << 15 else np.int32)
        self.direct[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = np.arange(len(hashes))
        self.direct[place[times > 1].astype(np.int64)] = -2
        self.hashes, self.buckets, self.usual, self.least, self.path = hashes, buckets, usual, least, path

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        net = self.net
        out = ((hashes >> np.uint64(20)) % np.uint64(net.buckets)).astype(np.int32)
        out += net.ids - net.buckets
        at = self.direct.take((hashes >> np.uint64(64 - self.BITS)).astype(np.int64))
        some = np.flatnonzero(at >= 0)
        known = some[self.hashes[at[some]] == hashes[some]]
        out[known] = at[known]
        if len(some := np.flatnonzero(at == -2)):
            near = np.minimum(np.searchsorted(self.sorted, hashes[some]), len(self.sorted) - 1)
            known = self.sorted[near] == hashes[some]
            out[some[known]] = self.order[near[known]]
        return out

    def within(self, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log(count of the word / count of its bucket) of each token, 0 for frequent words; whether the word's count is still to be multiplied)."""
        net, out, rare = self.net, np.zeros(len(ids)), np.zeros(len(ids), dtype=bool)
        inside = np.flatnonzero(ids >= net.ids - net.buckets)
        if len(inside):
            h = hashes[inside]
            out[inside] = -np.log(np.maximum(self.buckets[ids[inside] - (net.ids - net.buckets)], 0.5))
            known = np.zeros(len(h), dtype=bool)
            words, counts = self.usual
            if len(words):
                at = np.searchsorted(words, h)
                at[at == len(words)] = 0
                known = words[at] == h
                out[inside[known]] += np.log(counts[at[known]])
            rare[inside[~known]] = True
        return out, rare

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, padding around each; positions of tokens; the text each belongs to)."""
        return self.encode_words([word_hashes(lower_bytes(t)) for t in texts])

    def encode_words(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        net, parts, lengths = self.net, [], []
        pad = np.full(net.window, net.ids, dtype=np.int32)
        for h in texts:
            w = self.ids(h)
            parts += [pad, w]
            lengths.append(len(w))
        x = np.concatenate([*parts, pad])
        lengths = np.array(lengths, dtype=np.int64)
        starts = np.cumsum(lengths + net.window) - lengths
        owner = np.repeat(np.arange(len(texts)), lengths)
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return x, np.repeat(starts, lengths) + inside, owner


class Weights:
    def __init__(self, net: Network, counts: np.ndarray):
        rng = np.random.default_rng(1)
        self.net = net
        self.rooms: dict[str, np.ndarray] = {}
        self.parts = [np.zeros(s, dtype=np.float32) for s in net.shapes()]
        self.parts[0][:] = rng.normal(0, 0.1, self.parts[0].shape)
        self.parts[1][:] = 1.0
        share = (counts + 0.5).reshape(net.classes, net.class_size)
        self.parts[4][:] = np.log(share.sum(axis=1) / share.sum())
        self.parts[6][:] = np.log(share / share.sum(axis=1, keepdims=True))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parts:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def _room(self, name: str, rows: int, width: int) -> np.ndarray:
        """Memory for one of the large intermediate arrays, kept from batch to batch."""
        have = self.rooms.get(name)
        if have is None or len(have) < rows or have.shape[1] != width:
            have = self.rooms[name] = np.empty((rows, width), dtype=np.float32)
        return have[:rows]

    def _hidden(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(neighbours of each position, their embeddings, the hidden layer)."""
        net = self.net
        offsets = np.array([*range(-net.window, 0), *range(1, net.window + 1)])
        around = x[at[:, None] + offsets]
        near = self._room("near", around.size, net.width)
        near = self.parts[0].take(around.ravel(), axis=0, out=near, mode="clip").reshape(len(at), len(offsets), net.width)
        return around, near, np.tanh(np.einsum("npd,pd->nd", near, self.parts[1]) + self.parts[2])

    @staticmethod
    def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(e to the outputs, in place, which count up to 60 either way; their sums)."""
        np.clip(z, -60.0, 60.0, out=z)
        np.exp(z, out=z)
        return z, z @ np.ones(z.shape[1], dtype=z.dtype)

    @staticmethod
    def _runs(c: np.ndarray) -> list[tuple[int, int, int]]:
        """(class, first, end) of each run of a sorted array."""
        edge = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True])
        return list(zip(c[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True))

    def _outputs(self, h: np.ndarray, c: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Outputs for all classes and for the ids of each row's class; rows in order of their classes."""
        _, _, _, uc, bc, uw, bw = self.parts
        z = bw.take(c, axis=0, out=self._room("ids", len(c), self.net.class_size), mode="clip")
        for j, a, b in runs:
            z[a:b] += h[a:b] @ uw[j].T
        y = np.matmul(h, uc.T, out=self._room("classes", len(c), self.net.classes))
        y += bc
        return y, z

    def log_probabilities(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log p of the token at each position given its neighbours."""
        net, out = self.net, np.empty(len(at))
        for k in range(0, len(at), 1 << 13):
            some = at[k : k + (1 << 13)]
            by_class = np.argsort(x[some].astype(net.kind), kind="stable")
            some = some[by_class]
            c, w = np.divmod(x[some], net.class_size)
            rows = np.arange(len(some))
            _, _, h = self._hidden(x, some)
            logp = np.zeros(len(some))
            for z, mine in zip(self._outputs(h, c, self._runs(c)), (c, w), strict=True):
                e, total = self._exp(z)
                logp += np.log(e[rows, mine].astype(np.float64) / total)
            out[k + by_class] = logp
        return out

    def learn(self, x: np.ndarray, at: np.ndarray, state: list[np.ndarray]) -> None:
        """One Adagrad step on the tokens at some positions; state: the sums of squares, one array a part."""
        net, (emb, place, _, uc, _, uw, _) = self.net, self.parts
        at = at[np.argsort(x[at].astype(net.kind), kind="stable")]
        c, w = np.divmod(x[at], net.class_size)
        around, near, h = self._hidden(x, at)
        n, rows, runs = np.float32(len(at)), np.arange(len(at)), self._runs(c)
        slopes = []
        for z, mine in zip(self._outputs(h, c, runs), (c, w), strict=True):
            d, total = self._exp(z)
            d /= -total[:, None]
            d[rows, mine] += 1
            slopes.append(d)
        d, within = slopes
        grads = [None, *(np.zeros_like(p) for p in self.parts[1:])]
        grads[3], grads[4] = d.T @ h, d.sum(axis=0)
        back = d @ uc
        for k, a, b in runs:
            grads[5][k] = within[a:b].T @ h[a:b]
            grads[6][k] = within[a:b].sum(axis=0)
            back[a:b] += within[a:b] @ uw[k]
        back *= 1 - h * h
        grads[1], grads[2] = np.einsum("npd,nd->pd", near, back), back.sum(axis=0)
        flat = around.ravel()
        order = np.argsort(flat.astype(net.kind), kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        some = flat[first]  # other rows have no gradient, so nothing of theirs changes
        each = back.take(order // len(place), axis=0, out=self._room("each", len(flat), net.width), mode="clip")
        each *= place.take(order % len(place), axis=0, out=self._room("places", len(flat), net.width), mode="clip")
        g = np.add.reduceat(each, first, axis=0) / n
        state[0][some] += g * g
        emb[some] += net.rate * g / (np.sqrt(state[0][some]) + 1e-4)
        for p, g, s in zip(self.parts[1:], grads[1:], state[1:], strict=True):
            g /= n
            s += g * g
            p += net.rate * g / (np.sqrt(s) + 1e-4)


def residues(x: np.ndarray, at: np.ndarray, owner: np.ndarray, stride: int) -> np.ndarray:
    """The round in which each position is a target: by its place in the text, from a start that the text alone sets."""
    start = np.bincount(owner, x[at]).astype(np.int64)[owner]
    return (np.arange(len(at)) - np.searchsorted(owner, owner) + start) % stride


def _level() -> Column:
    return F.floor(F.log2("n") * LEVELS)


def _counts(docs: DataFrame, net: Network) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of all documents and the count of each id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, back = np.unique(h, return_inverse=True)
            return u, np.bincount(back, n).astype(np.int64)

        held, rows = [], 0
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                u, n = np.unique(np.concatenate([word_hashes(lower_bytes(t)) for t in texts]), return_counts=True)
                held.append((u, n))
                rows += len(u)
            if rows > 2_000_000:
                u, n = out(held)
                yield pa.RecordBatch.from_pydict({"word": pa.array(u.view(np.int64)), "n": pa.array(n)})
                held, rows = [], 0
        if held:
            u, n = out(held)
            yield pa.RecordBatch.from_pydict({"word": pa.array(u.view(np.int64)), "n": pa.array(n)})

    path = scratch(docs.sparkSession, "words")
    docs.select("text").mapInArrow(tidy(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).write.option("compression", "zstd").parquet(path)
    every = docs.sparkSession.read.schema("word long, n long").parquet(path)
    top = every.orderBy(F.desc("n"), "word").limit(net.ids - net.buckets).collect()
    counts = np.zeros(net.ids)
    bucket = F.pmod(F.shiftrightunsigned("word", 20), F.lit(net.buckets)).cast("int").alias("bucket")
    for row in every.groupBy(bucket).agg(F.sum("n").alias("n")).collect():
        counts[net.ids - net.buckets + row["bucket"]] = row["n"]
    for r in top:  # known words are not in the buckets
        counts[net.ids - net.buckets + ((r["word"] & (1 << 64) - 1) >> 20) % net.buckets] -= r["n"]
    counts[: len(top)] = [r["n"] for r in top]
    least, words = 64 * LEVELS, 0  # levels of counts, so that their number is bounded at every size
    for row in sorted(every.groupBy(_level().alias("level")).count().collect(), key=lambda r: -r["level"]):
        words += row["count"]
        if words > net.usual:
            break
        least = row["level"]
    usual = every.where(_level() >= least).toArrow()
    h, n = (usual.column(k).to_numpy() for k in ("word", "n"))
    order = np.argsort(h.view(np.uint64))
    hashes = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    return Vocabulary(hashes, net, counts[net.ids - net.buckets :].copy(), (h.view(np.uint64)[order], n[order]), least, path), counts


def trained(docs: DataFrame, net: Network = Network()) -> tuple[Vocabulary, Weights]:
    spark = docs.sparkSession
    vocabulary, counts = _counts(docs, net)
    weights, tokens = Weights(net, counts), max(1.0, float(counts.sum()))
    shared_words = share(spark, vocabulary)
    for turn in range(net.rounds):
        shared = share(spark, weights.flat())

        def learn(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            own = Weights(net, np.ones(net.ids))
            own.set(shared.value)
            state = [np.full(p.shape, 1e-6, dtype=np.float32) for p in own.parts]
            seen = 0
            for batch in batches:
                for _, texts in text_slices(batch.column(0)):
                    x, at, owner = shared_words.value.encode(texts)
                    at = at[residues(x, at, owner, net.stride) == turn % net.stride]
                    at = at[np.random.default_rng(len(at)).permutation(len(at))]
                    for k in range(0, len(at), net.batch):
                        own.learn(x, at[k : k + net.batch], state)
                    seen += len(at)
            if seen:
                flat = np.rint(own.flat().astype(np.float64) * (seen / tokens) * FIXED_POINT).astype(np.int64)
                cut = range(0, len(flat), SLICE)
                yield pa.RecordBatch.from_pydict({"slice": pa.array(range(len(cut)), pa.int32()), "n": pa.array([seen] * len(cut), pa.int64()), "sums": pa.array([flat[k : k + SLICE].tobytes() for k in cut], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for k, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    part = np.frombuffer(blob, dtype=np.int64)
                    have = sums.get(k)
                    sums[k] = [n, part] if have is None else [have[0] + n, have[1] + part]
            if sums:
                yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "n": pa.array([n for n, _ in sums.values()], pa.int64()), "sums": pa.array([p.tobytes() for _, p in sums.values()], pa.binary())})

        kind = "slice int, n long, sums binary"
        # two levels of adding, so that no task meets the slices of all others at once
        part = docs.select("text").mapInArrow(tidy(learn), kind).withColumn("salt", F.pmod(F.xxhash64("n", "sums"), F.lit(16)))
        once = part.repartition(shuffle_partitions(spark), "slice", "salt").drop("salt").mapInArrow(add, kind)
        rows = sorted(once.repartition(min(16, shuffle_partitions(spark)), "slice").mapInArrow(add, kind).collect(), key=lambda r: r["slice"])
        if not rows:
            break
        weights.set(np.concatenate([np.frombuffer(r["sums"], dtype=np.int64) / (r["n"] / tokens * FIXED_POINT) for r in rows]))
        shared.unpersist()
    return vocabulary, weights


def scored(docs: DataFrame, model: tuple[Vocabulary, Weights]) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of every row."""
    spark = docs.sparkSession
    shared = share(spark, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        for batch in batches:
            for a, texts in text_slices(batch.column(2)):
                b = a + len(texts)
                words = [word_hashes(lower_bytes(t)) for t in texts]
                x, at, owner = vocabulary.encode_words(words)
                words = np.concatenate(words)
                within, rare = vocabulary.within(words, x[at])
                n = np.bincount(owner, minlength=b - a)
                total = np.bincount(owner, weights.log_probabilities(x, at) + within, b - a)
                ends = np.r_[0, np.cumsum(np.bincount(owner[rare], minlength=b - a))].astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(ends), pa.array(words[rare].view(np.int64)))
                yield pa.RecordBatch.from_pydict({"row": batch.column(0).slice(a, b - a), "doc_id": batch.column(1).slice(a, b - a), "n_tokens": pa.array(n, pa.int64()), "part": pa.array(total, pa.float64()), "rest": rest})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(rows.mapInArrow(tidy(score), "row long, doc_id long, n_tokens long, part double, rest array<long>"), "scores")
    # integers, so that sums do not depend on the order of rows
    log = lambda n: F.rint(F.log(n) * COUNT_POINT).cast("long")
    words = spark.read.schema("word long, n long").parquet(model[0].path).where(_level() < model[0].least).select("word", log(F.col("n")).alias("log"))
    rest = rows.select("row", F.explode("rest").alias("word")).join(words, "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.coalesce("log", log(F.lit(0.5)))).alias("log"))
    out = rows.drop("rest").join(rest, "row", "left").withColumn("log_prob", F.col("part") + F.coalesce("log", F.lit(0)) / F.lit(COUNT_POINT))
    return out.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs))
