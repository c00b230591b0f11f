"""Language-model scoring with a log-bilinear model over learned word classes.

Classes: the end of a text (0), the most frequent words one by one, and groups of all other words. Groups are learned
from the whole fit corpus: every unit, which is a frequent word or the bucket of all rarer words with the same last
three bytes, counts the most frequent words that stand near it, and a mixture of multinomials sorts the units by
these counts. The model predicts the next class from the two before it: their vectors, each through its position's
matrix, are added and multiplied with every class's output vector. It is trained in numpy by noise-contrastive
estimation on the class trigrams of *all* fit texts, of which there are at most classes^3 kinds whatever the corpus;
the number of draws from them is fixed. A word's probability is its class's times its smoothed share of that class,
from the exact counts of the whole fit corpus, so probabilities sum to one.

Passes: (1) word counts; (2) units' neighbours; (3) class trigrams; (4) scoring, where batched matrix products
normalise every context once for a worker and tokens look their log-probability up. All passes work on the words of
whole Arrow batches at once (see ``_words``); words go by their 64-bit hashes. The ``top`` most frequent words (a fixed
bound) are broadcast with their counts; the rest of a text's words meet their counts in a shuffle join. No word
outside ``top`` is frequent, so that join has no hot key from the corpus.

Defined results: null and empty texts are one end token; rows without a doc_id are scored like others; repeated rows
are scored once each; with no fit text at all, counts are zero and classes equally likely.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, small_batches, stored
from ._words import Words, hashes, words_of


@dataclass(frozen=True)
class Params:
    singles: int = 63
    groups: int = 64
    dims: int = 16
    top: int = 1 << 17
    units: int = 1 << 13
    buckets: int = 4093
    near: int = 3
    rounds: int = 25
    steps: int = 2000
    batch: int = 1024
    noise: int = 32
    rate: float = 0.25
    seed: int = 23

    @property
    def classes(self) -> int:
        return 1 + self.singles + self.groups


def bucket_of(w: Words, buckets: int) -> np.ndarray:
    """The bucket of each word by its last three bytes, A-Z as a-z."""
    code, size = np.zeros(len(w.starts), np.int64), w.ends - w.starts
    for k in (3, 2, 1):
        byte = w.data[np.maximum(w.ends - k, 0)].astype(np.int64) if len(w.ends) else code
        byte += 32 * ((byte >= 65) & (byte <= 90))
        code = np.where(size >= k, code * 256 + byte, code)
    return code % buckets


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word, bucket, n = (np.concatenate(x) for x in zip(*parts))
    word, first, inverse = np.unique(word, return_index=True, return_inverse=True)
    return word, bucket[first], np.bincount(inverse, n, len(word)).astype(np.int64)


def word_counts(docs: DataFrame, p: Params, flush: int = 1 << 20) -> DataFrame:
    """(word, bucket, n): hashes, buckets and counts of all words; each task adds up before it sends."""
    small_batches(docs.sparkSession)

    def run(batches):
        parts, held = [], 0
        for b in batches:
            w = words_of(b.column(0))
            if len(w.starts):
                parts.append(_summed([(hashes(w), bucket_of(w, p.buckets), np.ones(len(w.starts)))]))
                held += len(parts[-1][0])
            if held > flush:
                parts = [_summed(parts)]
                held = len(parts[0][0])
                if held > flush // 2:
                    yield out(parts[0])
                    parts, held = [], 0
        if parts:
            yield out(_summed(parts))

    def out(x):
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])], ["word", "bucket", "n"])

    rows = docs.select(docs["text"]).mapInArrow(lean(run), "word long, bucket long, n long")
    return rows.groupBy("word").agg(F.max("bucket").alias("bucket"), F.sum("n").alias("n"))


def frequent(counts: DataFrame, top: int) -> np.ndarray:
    """(word, bucket, n) columns of at most ``top`` words, those above a count that a histogram of at most 512 steps gives; the most frequent first."""
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    held, least = 0, None
    for s, k in sizes:
        if held + k > top:
            break
        held, least = held + k, s
    if least is None:
        return np.zeros((3, 0), np.int64)
    got = counts.filter(step >= least).select("word", "bucket", "n").toArrow()
    every = np.stack([got.column(k).to_numpy() for k in range(3)])
    return every[:, np.lexsort((every[0], -every[2]))]


@dataclass
class Stats:
    """What scoring needs besides the trained vectors."""

    params: Params
    known: np.ndarray  # word, bucket, n of the frequent words
    bucket_size: np.ndarray
    bucket_kinds: np.ndarray
    texts: int
    class_of: np.ndarray | None = None  # of each unit
    _table: tuple | None = None

    @property
    def tokens(self) -> int:
        return int(self.bucket_size.sum()) + self.texts

    @property
    def distinct(self) -> int:
        return int(self.bucket_kinds.sum()) + (self.texts > 0)

    def places(self, words: np.ndarray) -> np.ndarray:
        """The place of each hash among the known words, or -1."""
        if self._table is None:
            order = np.argsort(self.known[0].view(np.uint64))
            self._table = self.known[0].view(np.uint64)[order], order
        keys, order = self._table
        if not len(keys):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        return np.where(keys[at] == words, order[at], -1)

    def units(self, places: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Frequent words are units of their own, after them come the buckets."""
        most = min(self.params.units, self.known.shape[1])
        return np.where((places >= 0) & (places < most), places, most + buckets)

    @property
    def n_units(self) -> int:
        return min(self.params.units, self.known.shape[1]) + self.params.buckets

    def class_sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and kinds of words of each class."""
        p, most = self.params, self.n_units - self.params.buckets
        size, kinds = np.zeros(p.classes), np.zeros(p.classes)
        own, bucket, n = self.class_of[:most], self.known[1, :most], self.known[2, :most]
        of_bucket = self.class_of[most:]
        for out, each, every in ((size, n, self.bucket_size), (kinds, np.ones(most), self.bucket_kinds)):
            np.add.at(out, of_bucket, every)
            np.add.at(out, of_bucket[bucket], -each)
            np.add.at(out, own, each)
        return size, kinds

    def read(self, column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """Words of a batch, their hashes, places and units."""
        w = words_of(column)
        own = hashes(w)
        places = self.places(own)
        return w, own, places, self.units(places, bucket_of(w, self.params.buckets))


def statistics(counts: DataFrame, n_texts: int, p: Params) -> Stats:
    size, kinds = np.zeros(p.buckets), np.zeros(p.buckets)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        size[r["bucket"]], kinds[r["bucket"]] = r["n"], r["k"]
    return Stats(p, frequent(counts, p.top), size, kinds, n_texts)


def _dense(docs: DataFrame, s: Stats, length: int, count) -> np.ndarray:
    """Sums over all of ``docs`` of ``count(stats, column)``, codes below ``length`` of which each counts one."""
    shared = docs.sparkSession.sparkContext.broadcast(s)
    small_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(length, np.int64)
        for b in batches:
            kinds, n = np.unique(count(shared.value, b.column(0)), return_counts=True)
            total[kinds] += n
        kinds = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(total[kinds])], ["code", "n"])

    out = np.zeros(length)
    got = docs.select(docs["text"]).mapInArrow(lean(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out


def near_codes(s: Stats, column: pa.Array) -> np.ndarray:
    """unit * singles + single for each frequent word that stands up to ``near`` words from a word."""
    p = s.params
    w, _, places, units = s.read(column)
    text, out = np.repeat(np.arange(len(column)), np.diff(w.edges)), [np.zeros(0, np.int64)]
    for d in range(1, p.near + 1):
        same = text[d:] == text[:-d]
        for a, b in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            hit = same & (places[b] >= 0) & (places[b] < p.singles)
            out.append(units[a][hit] * p.singles + places[b][hit])
    return np.concatenate(out)


def grouped(counts: np.ndarray, s: Stats) -> np.ndarray:
    """The class of each unit: a mixture of multinomials over the near frequent words, by hard expectation-maximisation."""
    p = s.params
    own = min(p.singles, s.n_units - p.buckets)
    rest = counts[own:]
    rng = np.random.default_rng(p.seed)
    weight = rest.sum(axis=1)
    common = (rest.sum(axis=0) + 1.0) / (rest.sum() + counts.shape[1])
    # seeds: units that are frequent and unlike those taken before
    chosen, far = [int(weight.argmax())], np.full(len(rest), np.inf)
    share = np.sqrt((rest + 5 * common) / (weight[:, None] + 5))
    while len(chosen) < p.groups:
        far = np.minimum(far, ((share - share[chosen[-1]]) ** 2).sum(axis=1))
        odds = far * np.sqrt(weight + 1e-9)
        chosen.append(int(rng.choice(len(rest), p=odds / odds.sum())) if odds.sum() > 0 else 0)
    log_share = np.log(share[chosen] ** 2)
    log_prior = np.zeros(p.groups)
    for _ in range(p.rounds):
        at = (rest @ log_share.T + log_prior).argmax(axis=1)
        sums = np.zeros((p.groups, counts.shape[1]))
        np.add.at(sums, at, rest)
        log_share = np.log((sums + 5 * common) / (sums.sum(axis=1, keepdims=True) + 5))
        log_prior = np.log((np.bincount(at, weight, p.groups) + 1) / (weight.sum() + p.groups))
    return np.concatenate([1 + np.arange(own), 1 + p.singles + at])


def _in_line(w: Words, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts, each after two ends and with its own end; the places of the words and ends that are predicted."""
    sizes = np.diff(w.edges)
    at = np.arange(len(cls)) + 3 * np.repeat(np.arange(len(sizes)), sizes) + 2
    line = np.zeros(len(cls) + 3 * len(sizes), np.int64)
    line[at] = cls
    target = np.ones(len(line), bool)
    starts = w.edges[:-1] + 3 * np.arange(len(sizes))
    target[starts] = target[starts + 1] = False
    return line, np.flatnonzero(target)


def trigram_codes(s: Stats, column: pa.Array) -> np.ndarray:
    m = s.params.classes
    w, _, _, units = s.read(column)
    line, at = _in_line(w, s.class_of[units])
    return (line[at - 2] * m + line[at - 1]) * m + line[at]


def with_classes(docs: DataFrame, s: Stats) -> Stats:
    s.class_of = grouped(_dense(docs, s, s.n_units * s.params.singles, near_codes).reshape(s.n_units, -1), s)
    return s


def trigrams(docs: DataFrame, s: Stats) -> np.ndarray:
    """Counts of class trigrams over all of ``docs``, as (classes, classes, classes)."""
    m = s.params.classes
    return _dense(docs, s, m**3, trigram_codes).reshape(m, m, m)


@dataclass
class Model:
    """Context vectors already through their matrices, output vectors and biases."""

    first: np.ndarray
    second: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def table(self) -> np.ndarray:
        """Normalised log10-probabilities of all classes after every context: (classes^2, classes)."""
        m = len(self.bias)
        context = (self.first[:, None, :] + self.second[None, :, :]).reshape(m * m, -1)
        logits = context @ self.out.T + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return (logits / np.log(10)).astype(np.float32)


def train(counts: np.ndarray, p: Params) -> Model:
    """Noise-contrastive estimation; noise is the smoothed frequency of classes, shared by a batch."""
    m, d = p.classes, p.dims
    rng = np.random.default_rng(p.seed)
    noise = (counts.sum(axis=(0, 1)) + 1.0) / (counts.sum() + m)
    log_noise = np.log(noise)
    vec, out = rng.normal(0, 0.3, (m, d)), rng.normal(0, 0.1, (m, d))
    turn = [np.eye(d) * 0.6 + rng.normal(0, 0.02, (d, d)), np.eye(d) * 0.9 + rng.normal(0, 0.02, (d, d))]
    bias = log_noise.copy()
    sq = [np.full_like(x, 0.1) for x in (vec, out, turn[0], turn[1], bias)]
    flat = counts.ravel()
    kinds = np.flatnonzero(flat)
    if len(kinds):
        cum = np.cumsum(flat[kinds])
        for t in range(p.steps):
            code = kinds[np.searchsorted(cum, rng.random(p.batch) * cum[-1], side="right").clip(0, len(kinds) - 1)]
            a, b, w = code // (m * m), code // m % m, code % m
            q = vec[a] @ turn[0] + vec[b] @ turn[1]
            z = rng.choice(m, size=p.noise, p=noise)
            odds = np.log(p.noise)
            up = 1 / (1 + np.exp(np.clip((q * out[w]).sum(axis=1) + bias[w] - log_noise[w] - odds, -30, 30)))
            down = -1 / (1 + np.exp(-np.clip(q @ out[z].T + bias[z] - log_noise[z] - odds, -30, 30)))
            g_q = up[:, None] * out[w] + down @ out[z]
            def spread(index, values):  # adds up rows by class; a product is faster than unbuffered additions
                hot = np.zeros((m, len(index)))
                hot[index, np.arange(len(index))] = 1
                return hot @ values

            g_out = spread(w, up[:, None] * q) + spread(z, down.T @ q)
            g_bias = np.bincount(w, up, m) + np.bincount(z, down.sum(axis=0), m)
            g_vec = spread(a, g_q @ turn[0].T) + spread(b, g_q @ turn[1].T)
            grads = [g_vec, g_out, vec[a].T @ g_q, vec[b].T @ g_q, g_bias]
            rate = p.rate * (1 - t / p.steps * 0.9)
            for x, g, s in zip((vec, out, turn[0], turn[1], bias), grads, sq):
                g = g / p.batch
                s += g * g
                x += rate * g / np.sqrt(s)
    return Model(vec @ turn[0], vec @ turn[1], out, bias)


class Scorer:
    """Sums for the texts of a batch; words outside the frequent ones count as unknown and are listed as rare."""

    def __init__(self, s: Stats, model: Model):
        self.s, self.table, m = s, model.table(), s.params.classes
        size, kinds = s.class_sizes()
        self.alone = np.arange(m) <= s.params.singles
        self.share = np.where(self.alone, 0.0, np.log10(size + 0.1 * (kinds + 1)))
        # the frequent words' counts, and last that of an unknown one
        self.seen = np.log10(np.append(s.known[2], 0) + 0.1)
        self.per_token = np.log10(s.tokens + 0.1 * (s.distinct + 1))

    def __call__(self, column: pa.Array) -> dict[str, pa.Array]:
        s, m = self.s, self.s.params.classes
        w, own, places, units = s.read(column)
        sizes, cls = np.diff(w.edges), s.class_of[units]
        text = np.repeat(np.arange(len(sizes)), sizes)
        line, at = _in_line(w, cls)
        every = self.table[line[at - 2] * m + line[at - 1], line[at]].astype(np.float64)
        logc = self.seen[places]
        of_text = lambda x, t=text: np.bincount(t, x, len(sizes))
        score = of_text(every, np.repeat(np.arange(len(sizes)), sizes + 1)) + of_text(np.where(self.alone[cls], 0.0, logc - self.share[cls]))
        base = of_text(logc) + np.log10(s.texts + 0.1) - (sizes + 1) * self.per_token
        known = of_text(places >= 0).astype(np.int64) + (s.texts > 0)
        rare = np.flatnonzero(places < 0)
        rare = rare[np.lexsort((own[rare], text[rare]))]
        first = np.ones(len(rare), bool)
        first[1:] = (own[rare][1:] != own[rare][:-1]) | (text[rare][1:] != text[rare][:-1])
        heads = np.flatnonzero(first)
        times = np.diff(np.append(heads, len(rare)))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text[rare[heads]], minlength=len(sizes)))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(own[rare[heads]].view(np.int64)), pa.array(times)], ["w", "n"])
        return {"n_tokens": pa.array(sizes + 1), "n_known": pa.array(known), "base": pa.array(base), "score": pa.array(score), "rare": pa.ListArray.from_arrays(pa.array(offsets), pairs)}


def _partials(docs: DataFrame, s: Stats, model: Model) -> DataFrame:
    """Every row's sums, with words outside the frequent ones taken as unknown and listed in ``rare``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((s, model))

    def run(batches):
        scorer = Scorer(*shared.value)
        for b in batches:
            got = scorer(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *got.values()], ["row", "doc_id", *got])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return rows.mapInArrow(lean(run), "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<w:bigint,n:bigint>>")


def score(docs: DataFrame, fit_rows, p: Params = Params()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    fit = docs.filter(fit_rows).select("text")
    counts = stored(word_counts(fit, p), "counts")
    s = with_classes(fit, statistics(counts, fit.count(), p))
    model = train(trigrams(fit, s), p)
    part = stored(_partials(docs, s, model), "partials")
    rare = part.select("row", F.explode("rare").alias("x")).select("row", F.col("x.w").alias("word"), F.col("x.n").alias("times"))
    gain = F.col("times") * (F.log10(F.col("n") + 0.1) + 1)
    found = rare.join(counts.select("word", "n"), "word").groupBy("row").agg(F.sum("times").alias("found"), F.sum(gain).alias("gain"))
    out = part.drop("rare").join(found, "row", "left")
    more = F.coalesce("gain", F.lit(0.0))
    known = F.col("n_known") + F.coalesce("found", F.lit(0))
    return out.select("doc_id", "n_tokens", known.cast("long").alias("n_known"), F.lit(s.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
