"""Each operator against a plain version or a round trip, and on awkward, empty and clashing tables."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import ann, chat, decontam, language_id, lm_scoring, mixing, ngram_join, sharding, token_files, toxicity
from folioscan.llm.common import connected_components, mix64, shingle_hashes, unmix64, word_hashes

from .helpers import awkward, clashing, nothing, sentence


def rows(df):
    return [tuple(r) for r in df.collect()]


# Shared helpers


def test_hashes():
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x123456789ABCDEF)
    assert (unmix64(mix64(x)) == x).all()
    words = word_hashes(b"a bb\tccc  a\n")
    assert len(words) == 4 and words[0] == words[3] and len(set(words.tolist())) == 3
    long = ("word " * 400_000).encode()
    assert len(word_hashes(long)) == 400_000 and len(set(word_hashes(long).tolist())) == 1
    assert len(shingle_hashes(words, 5)) == 1 and len(shingle_hashes(words[:0], 5)) == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, 90), (90, 95), (7, 7)]
    found = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert {found[k] for k in range(1, 31)} == {1} and {found[k] for k in (90, 95, 100)} == {90}


# 1


def test_lm_scores_sum_to_one_and_training_helps(spark):
    docs = spark.createDataFrame([(k, " ".join(f"{w} {w}x {w}y" for w in sentence(k % 3, 60).split())) for k in range(60)], "doc_id long, text string")
    net = lm_scoring.Network(ids=128, buckets=64, class_size=16, width=8, rounds=1, stride=1)
    before = lm_scoring.trained(docs, lm_scoring.Network(ids=128, buckets=64, class_size=16, width=8, rounds=0))
    after = lm_scoring.trained(docs, net)
    total = lambda m: lm_scoring.scored(docs, m).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
    (a, n), (b, _) = total(before), total(after)
    assert n == 60 * 180 and b > a
    vocabulary, weights = after
    x, at, _ = vocabulary.encode(["alpha0 beta1 gamma2"])
    p = 0.0
    for token in range(net.ids):
        x[at[1]] = token
        p += math.exp(weights.log_probabilities(x, at[1:2])[0])
    assert abs(p - 1) < 1e-4


def test_lm_learns_from_every_position(spark):
    docs = spark.createDataFrame([(k, f"a{k % 5} b{k % 3} c d {'pq'[k % 2]} {'uv'[k % 2]} e f") for k in range(800)], "doc_id long, text string").coalesce(1)
    kind = {"ids": 128, "buckets": 64, "class_size": 16, "width": 8, "batch": 64}
    means = []
    for net in (lm_scoring.Network(**kind, rounds=0), lm_scoring.Network(**kind)):
        vocabulary, weights = lm_scoring.trained(docs, net)
        x, at, _ = vocabulary.encode(["a1 b1 c d p u e f", "a2 b2 c d q v e f"])
        means.append(weights.log_probabilities(x, at).reshape(2, 8).mean(axis=0))
    assert (means[1] > means[0] + 0.2).all()


@pytest.mark.parametrize("usual", [1 << 18, 40, 0])
def test_lm_tells_words_of_a_bucket_apart(spark, usual):
    docs = spark.createDataFrame([(k, f"{sentence(k, 30)} often{k % 4} once{k}") for k in range(200)], "doc_id long, text string")
    net = lm_scoring.Network(ids=64, buckets=16, class_size=16, width=4, rounds=0, usual=usual)
    vocabulary, weights = lm_scoring.trained(docs, net)
    counts = collections.Counter(w for _, t in docs.collect() for w in t.split())
    of = lambda w: int(vocabulary.ids(word_hashes(w.encode()))[0]) - 48
    totals = collections.Counter()
    for w, n in counts.items():
        totals[of(w)] += n
    asked = spark.createDataFrame([(k, w) for k, w in enumerate([*counts, "never"])], "doc_id long, text string")
    found = {r["doc_id"]: r["log_prob"] for r in lm_scoring.scored(asked, (vocabulary, weights)).collect()}
    for k, w in enumerate([*counts, "never"]):
        x, at, _ = vocabulary.encode([w])
        assert abs(found[k] - weights.log_probabilities(x, at)[0] - (math.log((counts[w] or 0.5) / totals[of(w)]) if of(w) >= 0 else 0)) < 1e-6
    # over all words counted, the probabilities sum to one
    assert abs(sum(math.exp(found[k]) for k in range(len(counts))) - 1) < 1e-2


def test_lm_equals_plain_sums(spark):
    """Each document's score, token by token in plain loops."""
    docs = spark.createDataFrame([(k, f"{sentence(k, 25)} rare{k}") for k in range(40)] + [(90, "lone"), (91, "")], "doc_id long, text string")
    net = lm_scoring.Network(ids=64, buckets=16, class_size=8, width=4, rounds=1, stride=1, batch=64)
    vocabulary, weights = lm_scoring.trained(docs, net)
    counts = collections.Counter(w for _, t in docs.collect() for w in t.split())
    of = lambda w: int(vocabulary.ids(word_hashes(w.encode()))[0])
    totals = collections.Counter()
    for w, n in counts.items():
        totals[of(w)] += n
    emb, place, bias, uc, bc, uw, bw = (p.astype(float) for p in weights.parts)
    softmax = lambda z: [math.exp(v) / sum(math.exp(u) for u in z) for v in z]
    wanted = {}
    for d, t in docs.collect():
        words, total = t.split(), 0.0
        ids = [net.ids] * 2 + [of(w) for w in words] + [net.ids] * 2
        for k, w in enumerate(words, 2):
            h = [math.tanh(bias[j] + sum(emb[ids[k + o]][j] * place[p][j] for p, o in enumerate((-2, -1, 1, 2)))) for j in range(net.width)]
            c, i = divmod(ids[k], net.class_size)
            total += math.log(softmax([bc[y] + sum(a * b for a, b in zip(h, uc[y], strict=True)) for y in range(net.classes)])[c])
            total += math.log(softmax([bw[c][y] + sum(a * b for a, b in zip(h, uw[c][y], strict=True)) for y in range(net.class_size)])[i])
            total += math.log(counts[w] / totals[ids[k]]) if ids[k] >= net.ids - net.buckets else 0.0
        wanted[d] = total
    found = {r["doc_id"]: r["log_prob"] for r in lm_scoring.scored(docs, (vocabulary, weights)).collect()}
    assert found.keys() == wanted.keys() and all(abs(found[d] - wanted[d]) < 1e-3 for d in wanted)


def test_lm_awkward(spark):
    docs = awkward(spark)
    net = lm_scoring.Network(ids=128, buckets=64, class_size=16, width=4, rounds=1)
    out = lm_scoring.scored(clashing(docs), lm_scoring.trained(docs, net)).collect()
    assert len(out) == docs.count() and all(r["log_prob"] == 0 and r["mean_log_prob"] is None for r in out if r["n_tokens"] == 0)
    empty = nothing(spark)
    assert rows(lm_scoring.scored(empty, lm_scoring.trained(empty, net))) == []


# 2


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = awkward(spark)
    folder = f"file://{tmp_path}/t"
    manifest = token_files.write_files(clashing(docs), folder)
    found = sorted(rows(token_files.read_files(manifest, folder)), key=lambda r: r[1])
    tokenizer = Tokenizer.from_file(token_files.Tokens().path())
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in found) == sorted((i is not None, i or 0, len(ids(t)) // 4, zlib.crc32(ids(t))) for i, t in rows(docs.select("doc_id", "text")))
    assert [r[0] for r in found if r[0]] == sorted(r[0] for r in found if r[0])
    assert [r[1] for r in found] == [0, *itertools.accumulate(r[2] for r in found)][:-1]
    file = next(r["file"] for r in manifest.collect() if r["docs"] > 1)
    entries, _, _ = token_files.read_table(token_files.file_system(f"{folder}/{file}")[0].open_input_file(str(tmp_path / "t" / file)))
    one = int(entries["doc_id"][-1])
    assert {d for d, _, _ in token_files.read_documents(f"{folder}/{file}", {one})} == {one}
    path = tmp_path / "t" / file
    data = bytearray(path.read_bytes())
    data[int(entries["size"][0]) // 2] ^= 255
    path.write_bytes(bytes(data))
    with pytest.raises(Exception):  # noqa: B017 - zstandard's error or the checksum's
        list(token_files.read_documents(f"{folder}/{file}"))
    assert rows(token_files.tokenised(nothing(spark))) == []


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    rnd, encoder = random.Random(5), token_files.Encoder(token_files.Tokens(words=50))
    tokenizer = Tokenizer.from_file(token_files.Tokens().path())
    letters = [chr(c) for c in range(1, 256)] + list("abc 'stremvd12") * 20 + ["İ", "Σ", "漢", "<|endoftext|>", "ﬁ"]
    for k in range(500):
        text = "".join(rnd.choice(letters[:-5] if k % 3 else letters) for _ in range(rnd.randint(0, 60)))
        assert encoder.encode([text])[0] == np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()


# 3


def test_language_models(spark):
    kinds = {"xx": "abc", "yy": "def", "zz": "abd"}
    rnd = random.Random(3)
    made = [(k, " ".join("".join(rnd.choice(kinds[lang]) for _ in range(5)) for _ in range(30)), lang) for k in range(150) for lang in [sorted(kinds)[k % 3]]]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    models = language_id.fitted(docs)
    out = {r["doc_id"]: r for r in language_id.identified(docs, models).collect()}
    assert sum(out[i]["nearest"] == lang for i, _, lang in made) >= 148
    assert models.predict(["QQQQ WWWW RRRR TTTT " * 10])[0][0] == "und"
    # probabilities of all symbols after a context sum to one
    x, _, _ = models._symbols(["abcab"])
    symbols = [*np.unique(models.symbol[models.symbol != language_id.UNKNOWN]), language_id.UNKNOWN]
    total = np.zeros(len(models.names))
    for s in symbols:
        x[-1], logp = s, np.zeros(len(models.names))
        for k in range(models.p.order, 0, -1):
            key = models._keys(x, k)[-1:]
            at = models.grams[k - 1].find(key)[0]
            if at >= 0:
                logp += models.grams[k - 1].values[at]
                break
            if k == 1:
                logp += models.floor
            elif (at := models.contexts[k - 1].find(key >> np.uint64(language_id.BITS))[0]) >= 0:
                logp += models.contexts[k - 1].values[at]
        total += np.exp(logp)
    assert np.allclose(total, 1, atol=1e-4)


def test_language_sample_counts_an_id_once(spark):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5]
    hashes = dict(rows(spark.createDataFrame([(k,) for k in ids], "doc_id long").select("doc_id", F.xxhash64("doc_id"))))
    low, *rest, high = sorted(ids, key=hashes.get)
    made = [(low, "aab", "xx")] * 300 + [(k, "aba bbab", "xx") for k in rest[:50]] + [(high, "dede edd", "yy")] * 3000
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    models = language_id.fitted(docs, language_id.Languages(max_rows=60))
    assert models.names == ["xx", "yy"]
    assert models.entropies(["aba bbab"])[0][0, 0] < 0.5  # learnt from more than the repeated id


@pytest.mark.parametrize("letters", [200, 5000])
def test_languages_of_other_scripts(letters):
    rnd = random.Random(6)
    halves = {"aa": range(0x4E00, 0x4E00 + letters // 2), "bb": range(0x4E00 + letters // 2, 0x4E00 + letters)}
    text = lambda lang: " ".join("".join(chr(rnd.choice(halves[lang])) for _ in range(5)) for _ in range(20))
    models = language_id.Models([(lang, text(lang)) for lang in halves for _ in range(200)], language_id.Languages())
    assert all(models.predict([text(lang)])[0][1] == lang for lang in halves for _ in range(20))
    seen = [chr(c) for half in halves.values() for c in half if models.symbol[c] != language_id.UNKNOWN]
    assert len(seen) > 0.9 * letters and len({tuple(models._symbols([c])[0]) for c in seen}) == len(seen)


def test_language_awkward(spark):
    docs = awkward(spark)
    out = rows(language_id.identified(clashing(docs), language_id.fitted(docs)))
    assert len(out) == docs.count()
    assert all(r[1] == "und" and r[3] == 0 for r in out if r[0] in (3, 4, 5))
    empty = nothing(spark)
    assert rows(language_id.identified(empty, language_id.fitted(empty))) == []
    assert language_id.fitted(empty).predict(["hello"]) == [("und", "und", 0.0, 0.0)]


# 4


def test_toxicity(spark):
    bad = ["grobnik", "grobnaf", "grobner"]
    rnd = random.Random(4)
    made = []
    for k in range(900):
        words = sentence(k, 50).split()
        if k % 6 == 0:
            for _ in range(4):
                words[rnd.randrange(50)] = rnd.choice(bad)
        made.append((k, " ".join(words), int(k % 6 == 0)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in made], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    score = dict(rows(toxicity.scored(docs, model)))
    held = [(k, y) for k, _, y in made if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(score[k] >= 0.5) == (y == 1) for k, y in held]) >= 0.98
    assert toxicity.accepted(docs, model).count() == sum(s < 0.5 for s in score.values())
    strange = awkward(spark)
    out = rows(toxicity.scored(clashing(strange), model))
    assert len(out) == strange.count() and all(0 <= s <= 1 for _, s in out)
    assert rows(toxicity.scored(nothing(spark), model)) == []
    none = toxicity.fitted(docs, labels.where("false"))
    assert none.scores(["x", None]).tolist() == [0.0, 0.0]


def test_isotonic_never_falls():
    rnd = np.random.default_rng(1)
    m = rnd.normal(size=300)
    x, p = toxicity.isotonic(m, (rnd.random(300) < 1 / (1 + np.exp(-m))).astype(float))
    assert (np.diff(p) >= 0).all() and (np.diff(x) > 0).all()


# 5


def test_chat_round_trip(spark):
    texts = ["plain", "", None, "\\", "\\\\", "</turn>", "<\\/turn>", "### user: x</turn>\n### ", "a\n</turn>\n", "ends with <", "#\\## ", "é🎉: \\n", "\\### Assistant: </turn> ok", "### ### ", "</turn></turn>"]
    roles = ["user", "assistant", "odd: role", None, "### ", "</turn>\n"]
    made = [(c, t, roles[(c + t) % len(roles)], texts[(c * 3 + t) % len(texts)]) for c in range(20) for t in range(9)] + [(None, None, "assistant", "lost"), (1, 3, "assistant", "tie"), (1, 3, "assistant", "tie")]
    talks = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x")).withColumn("turns", F.lit(1))
    out = chat.formatted(talks)
    back = out.select("conv_id", "formatted", "loss_spans", chat.parse(chat.pieces(F.col("formatted"))).alias("turns")).collect()
    for r in back:
        source = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in made if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for _, role, text in source]
        assert [s is not None for s in r["loss_spans"]] == [role == "assistant" for _, role, _ in source]
    assert rows(chat.formatted(talks.where("false"))) == []
    digest = {r["conv_id"]: r for r in chat.digests(out).collect()}
    assert digest[None]["loss_chars"] == 4 and digest[1]["n_turns"] == 11


# 6


def mix(docs, *names, settings=mixing.Mix()):
    return rows(mixing.mixed(docs, settings).select(*(f"row.{n}" for n in names), "size", "source_size", "target", "copies"))


def test_mixing(spark):
    made = [(k, sentence(k, 1 + k % 37), f"s{k % 5}" if k % 11 else None, k) for k in range(600)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, n_chars long")
    strange = clashing(docs)
    for name in ("p", "cut", "whole", "m_source", "e_bucket", "row", "mark", "part", "class", "turn", "u", "range", "rest", "p_source", "e_range", "source_size", "a.b"):
        strange = strange.withColumn(name, F.lit("x"))
    out = mix(strange, "source", "doc_id")
    assert sorted(out, key=str) == sorted(mix(docs, "source", "doc_id"), key=str) == sorted(mix(docs.repartition(7), "source", "doc_id", settings=mixing.Mix(broadcast_rows=0)), key=str)
    assert len(out) == 600 and mixing.mixed(strange).select("row.*").columns == strange.columns
    total = sum(r[2] for r in out)
    targets = {r[0]: (r[4], r[3]) for r in out}
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in targets.values())
    for source, (target, _) in targets.items():
        assert abs(sum(r[2] * r[5] for r in out if r[0] == source) - target) <= 37 / 2
    assert max(r[5] for r in out) <= 2
    # longer documents are likelier to be taken, and no order of documents alone decides
    of = lambda low, high: np.mean([r[5] for r in out if r[0] == "s1" and low <= r[2] < high])
    assert of(16, 40) > of(1, 8)


def test_mixing_of_unequal_probabilities(spark):
    """The plain version: expected copies by bisection, the Pareto order by sorting."""
    made = [(k, " ".join(["w"] * (1 + k * k % 90)), "ab"[k % 2]) for k in range(500)]
    settings = mixing.Mix(weights=(3, 1), total=0.7, ranges=16)
    out = {r[0]: r for r in mix(spark.createDataFrame(made, "doc_id long, text string, source string"), "doc_id", settings=settings)}
    size = {k: 1 + k * k % 90 for k, _, _ in made}
    weight = {k: round(16 * 2 ** ((n.bit_length() - 1) / 2)) for k, n in size.items()}
    orders = 0
    for source in (0, 1):
        mine = [k for k in size if k % 2 == source]
        target, low, high = out[mine[0]][3], 0.0, 10.0
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(2, c * weight[k]) * size[k] for k in mine) < target else (low, c)
        copies = {k: min(2.0, low * weight[k]) for k in mine}
        assert len({round(e, 9) for e in copies.values()}) > 3
        md5 = lambda t: __import__("hashlib").md5(t.encode()).hexdigest()
        u = {k: (int(md5(f"{md5(f'{k}|0|{made[k][2]}|{md5(made[k][1])}')}|1")[:12], 16) + 0.5) / 2**48 for k in mine}
        rank = {k: (u[k] / (1 - u[k])) / (p / (1 - p)) for k in mine if 0 < (p := copies[k] - int(copies[k])) < 1}
        room, upto = target - sum(int(copies[k]) * size[k] for k in mine), 0
        for k in sorted(rank, key=rank.get):
            taken = upto + size[k] / 2 <= room
            assert out[k][4] == int(copies[k]) + taken
            upto += size[k]
        orders += sorted(rank, key=rank.get) != sorted(rank, key=u.get)
    assert orders == 2


def test_mixing_of_a_repeated_row(spark):
    made = [(7, "one two three four", "a")] * 3000 + [(7, sentence(1, 5), "a")] * 50 + [(k, sentence(k, 3), "b") for k in range(500)] + [(None, "x y", None)] * 40
    for docs in (spark.createDataFrame(made, "doc_id long, text string, source string").repartition(5), spark.createDataFrame(made[::-1], "doc_id long, text string, source string").coalesce(1)):
        out = mix(docs, "source", "doc_id")
        for source in ("a", "b"):
            taken, target = sum(r[2] * r[5] for r in out if r[0] == source), next(r[4] for r in out if r[0] == source)
            assert abs(taken - target) < 0.01 * target
        assert len(out) == len(made)


def test_mixing_awkward(spark):
    out = mix(awkward(spark), "doc_id")
    assert len(out) == 13 and all(r[4] == 0 for r in out if r[1] == 0)
    assert rows(mixing.mixed(nothing(spark))) == []


# 7


@pytest.mark.parametrize("settings", [{}, {"query_bytes": 200, "block_rows": 32, "tile_rows": 3}])
def test_nearest(spark, settings):
    rnd = np.random.default_rng(7)
    made = [(k, [float(np.float32(v)) for v in rnd.normal(size=8)]) for k in range(300)]
    made += [(k, made[k % 3][1]) for k in range(300, 340)] + [(50, made[50][1]), (50, made[9][1]), (7, made[50][1]), (7, made[0][1])]
    made += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (404, []), (None, made[0][1]), (405, [1.0, 2.0])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(3).withColumn("block", F.lit(1)).withColumn("score", F.lit(2)).withColumn("row", F.lit("x"))
    out = rows(ann.nearest(df, F.col("id") % 50 == 0, ann.Nearest(5, **settings)))
    kept = [(k, np.array(v)) for k, v in made if k is not None and k < 340]
    wanted = []
    for at, (q, x) in enumerate(kept):
        if q % 50 == 0:
            scores = sorted((-float(ann.cosine(x[None], y[None])[0]), k) for other, (k, y) in enumerate(kept) if other != at)
            wanted += [(q, r + 1, k, -s) for r, (s, k) in enumerate(scores[:5])]
    assert sorted(out) == sorted(wanted) and any(q == 50 and k == 50 for q, _, k, _ in out)
    assert rows(ann.nearest(df.where("false"), F.col("id") % 50 == 0)) == []


def test_nearest_of_a_repeated_id(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [r[2] for r in sorted(rows(ann.nearest(df, F.col("id") % 50 == 0)))] == [1, 2, 1]


# 8


def test_decontamination(spark):
    lemma = decontam.Lemma()
    items = [sentence(k, 25) for k in range(20)]
    index, rnd = decontam.Index(list(enumerate(items)), lemma), random.Random(8)
    for _ in range(150):
        k = rnd.randrange(20)
        t = list(items[k])
        edits = rnd.randint(0, lemma.budget(len(t)))
        for _ in range(edits):
            at = rnd.randrange(len(t))
            if rnd.random() < 0.5:
                t[at] = "q"
            else:
                t.insert(at, "q")
        hits = index.hits(sentence(rnd.randrange(1000, 2000)) + " " + "".join(t) + " " + sentence(rnd.randrange(1000, 2000)))
        assert k in hits and hits[k][0] <= edits
    assert index.hits(sentence(5000, 3000)) == {} and index.hits(None) == {}
    half = items[3][: len(items[3]) // 2]
    assert index.hits(half) == {}


@pytest.mark.parametrize("words", [20, 25, 45])
def test_decontamination_finds_parts(words):
    items = [sentence(k, words) for k in range(20)]
    index = decontam.Index(list(enumerate(items)), decontam.Lemma())
    for k, t in enumerate(items):
        for part in (t[: len(t) * 9 // 10], t[len(t) // 10 :]):
            assert set(index.hits(f"{sentence(3000 + k)} {part} {sentence(4000 + k)}")) == {k}
        assert index.hits("x " + t)[k] == (0, 2, 2 + len(t))  # the whole, not a part of it


def least_edits(item, text):
    """Edits of the best place of item in text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(before + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.mark.parametrize("scan_chars", [1 << 19, 300])
def test_decontamination_equals_full_edit_distance(scan_chars):
    rnd, lemma = random.Random(12), decontam.Lemma(scan_chars=scan_chars, most_chars=80)
    items = [sentence(k, 7 + k % 3)[: 40 + 3 * k] for k in range(12)]  # too short for parts
    index = decontam.Index(list(enumerate(items)), lemma)
    near = 0
    for k in range(60):
        t = list(items[k % 12])
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randrange(len(t))
            t[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "zz"])
        text = decontam.normalise(f"{sentence(100 + k, rnd.randint(0, 120))} {''.join(t)} {sentence(300 + k, rnd.randint(0, 30))}")
        wanted = {i: e for i, item in enumerate(items) if (e := least_edits(decontam.normalise(item), text)) <= lemma.budget(len(decontam.normalise(item)))}
        assert {i: at[0] for i, at in index.hits(text).items()} == wanted
        near += len(wanted)
    assert 10 < near < 60


def test_decontamination_tables(spark):
    bench = spark.createDataFrame([(1, sentence(900, 30)), (2, None), (3, ""), (None, sentence(901, 30)), (5, "one two")], "item_id long, text string")
    docs = clashing(awkward(spark).union(spark.createDataFrame([(50, "x " + sentence(900, 30).upper() + " y", "en", "a", 1)], awkward(spark).schema)))
    hits = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert hits == {(50, 1), (7, 5), (8, 5)}
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    blocks = decontam.leaks(docs, bench, decontam.Lemma(block_chars=100)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == hits
    assert rows(decontam.leaks(nothing(spark), bench)) == [] and rows(decontam.leaks(docs, bench.where("false"))) == []


def test_qgram_hashes():
    a = decontam.code_points("abcdefghijklmabcdefghijklm")
    for q in (1, 2, 3, 5, 12):
        h = decontam.qgrams(a, q)
        strings = ["abcdefghijklmabcdefghijklm"[k : k + q] for k in range(len(h))]
        assert len(h) == 26 - q + 1 and len(set(h.tolist())) == len(set(strings))
        assert all((h[i] == h[j]) == (strings[i] == strings[j]) for i in range(len(h)) for j in range(len(h)))


# 9


def plain_components(texts):
    sets, parent = {}, {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), root(d)) for d in sets)


@pytest.mark.parametrize("settings", [{}, {"hot_rows": 4, "partners": 3, "cell": 5}, {"orders": 1}])
def test_join_finds_every_link(spark, settings):
    rnd = random.Random(9)
    texts, passage = [], sentence(77, 60)
    for g in range(30):
        base = sentence(g, 60 + g).split()
        for _ in range(rnd.randint(1, 8)):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                t[rnd.randrange(len(t))] = f"edit{rnd.randrange(99)}"
            texts.append(" ".join(t))
    texts += [passage + " " + sentence(500 + k, k % 30) for k in range(60)]
    texts += [" ".join(f"own{k}x{j}" for j in range(2 + k % 25)) + " " + sentence(78, 70) for k in range(60)]  # about the threshold
    texts += ["a b", "A b", "", None, "a b c d e", "lone"]
    rnd.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50 if settings else batch)
        found = sorted(rows(ngram_join.components(clashing(docs), ngram_join.Join(**settings))))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert found == plain_components(list(enumerate(texts)))


def test_join_awkward(spark):
    out = rows(ngram_join.components(awkward(spark)))
    assert len(out) == 13
    at = {r[0]: r for r in out if r[0] is not None}
    assert at[2][2] == 1 and at[8][2] == 7 and at[3][1] == 0 and at[4][2] == 4 and at[10][2] == 10
    assert sorted(r[1] for r in out if r[0] is None) == [0, at[10][1]] and all(r[2] is None for r in out if r[0] is None)
    assert rows(ngram_join.components(nothing(spark))) == []


# 10


def test_sharding(spark):
    shards = sharding.Shards(5, 101)
    owner = sharding.lookup_table(shards)
    counts = np.bincount(owner)
    assert len(owner) == 101 and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(sharding.Shards(4, 101))
    assert np.mean([a != b for a, b in zip(owner, fewer, strict=True) if a < 4]) < 0.35
    with pytest.raises(ValueError):
        sharding.Shards(5, 100)
    docs = awkward(spark)
    out = sharding.place(clashing(docs), "doc_id", shards, "text").select("doc_id", "slot", "shard").collect()
    assert len(out) == docs.count() and all(owner[r["slot"]] == r["shard"] for r in out)
    assert rows(sharding.place(nothing(spark), "doc_id", shards, "text")) == []
