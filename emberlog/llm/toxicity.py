"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is the sum of two hashed embeddings (the word, and its first five bytes, so that unseen
endings of a known stem still carry signal). Filters of widths 1, 2 and 3 slide over the whole text,
the maximum of each is pooled, and a logistic layer scores the pooled values. Training is plain numpy
(Adagrad) on a bounded sample of labelled rows; the rest of the fit set calibrates one threshold per
guessed language. The language is guessed from the text's own function words, never from a column.

Scoring streams whole texts through ``mapInArrow``: no shuffle. A long text goes through in slices, each led
in by the last words of the one before; maxima over slices are maxima over the text. So memory is bounded by
one Arrow batch, one slice and a bounded cache of word rows, however long a text is.

Defined results: a row without a doc_id is scored, and never learned from; null and empty texts score like a text of padding alone; a label that is null is not
used; a document with several labels counts as toxic if any says so; with no usable label of either
kind the model is constant (score 0.0 and prediction 0).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, small_batches, sparing, tidy, word_slices

#: Frequent function words by language, for the guess that picks a threshold.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as on by this are from at be".split(),
    "de": "der die das und den von zu ist mit nicht des dem ein eine auf für sich als auch".split(),
    "fr": "le la les et des un une du que qui est dans pour par sur pas au avec ce".split(),
    "es": "el los las y que del se por con una para su al lo como más pero sus no".split(),
}
LANGS = [*FUNCTION_WORDS]


@dataclass(frozen=True)
class Params:
    """``per_class`` bounds the labelled rows of each class that are fitted, ``words`` their words in all."""

    per_class: tuple[int, int] = (5000, 2500)  # not toxic, toxic
    words: int = 1 << 23
    buckets: int = 1 << 15
    dims: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 8
    batch: int = 64
    rate: float = 0.08
    seed: int = 11
    cached_words: int = 60_000
    slice_bytes: int = 1 << 17


@dataclass
class Model:
    params: Params
    taps: np.ndarray  # (2 * buckets, sum(widths) * filters): each bucket's share in every filter tap
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray  # logit that separates the classes, for each of LANGS and, last, any other
    constant: bool = False


class WordRows(dict):
    """word -> row number, from 1; hash buckets and language code of each row. Row 0 is padding."""

    CODE = {w.encode(): i for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws}

    def __init__(self, p: Params):
        self.p, self.whole, self.stem, self.code = p, [0], [0], [len(LANGS)]

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self.whole)
        bare = w.strip(b".,;:!?\"'()#*$%&|<>") or w
        self.whole.append(zlib.crc32(bare) % self.p.buckets)
        self.stem.append(self.p.buckets + zlib.crc32(b"^" + bare[:5]) % self.p.buckets)
        self.code.append(self.CODE.get(bare, len(LANGS)))
        return n

    def rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


class Taps:
    """Tap values and language code of the words met so far, at most about ``cached_words`` of them."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index, self.n = WordRows(self.model.params), 1
        self.values, self.codes = np.zeros((1024, self.model.taps.shape[1]), np.float32), np.full(1024, len(LANGS), np.int8)

    def catch_up(self) -> None:
        n = len(self.index.whole)
        if n > len(self.values):
            self.values = np.concatenate([self.values, np.zeros((max(n, 2 * self.n) - len(self.values), self.values.shape[1]), np.float32)])
            self.codes = np.concatenate([self.codes, np.zeros(len(self.values) - len(self.codes), np.int8)])
        new, own = slice(self.n, n), self.model.taps
        self.values[new] = own[self.index.whole[new]] + own[self.index.stem[new]]
        self.codes[new] = self.index.code[new]
        self.n = n


def _layout(docs: list[np.ndarray], pad: int, before: int, leads: list[np.ndarray] | None = None):
    """All documents in a row, each after ``before`` rows of lead (padding, if none is given); where each one's own rows begin and end."""
    starts, parts, at = [], [], 0
    gap = np.full(before, pad, dtype=np.int64)
    for k, d in enumerate(docs):
        parts += [gap if leads is None else leads[k], d]
        starts.append(at + before)
        at += before + len(d)
    parts.append(np.array([pad], dtype=np.int64))
    starts = np.array(starts, dtype=np.int64)
    return np.concatenate(parts), starts, starts + np.array([len(d) for d in docs], dtype=np.int64)


def _tops(taps: np.ndarray, starts, ends, p: Params) -> np.ndarray:
    """Max over each document of every filter, -inf without a word; ``taps`` holds one row of tap values for each position."""
    f, at, out = p.filters, 0, []
    cut = np.stack([starts, ends], axis=1).ravel()
    for w in p.widths:
        conv = taps[:, at + (w - 1) * f : at + w * f].copy()
        for j in range(w - 1):  # tap j looks w - 1 - j positions back
            back = w - 1 - j
            conv[back:] += taps[:-back, at + j * f : at + (j + 1) * f]
        top = np.maximum.reduceat(conv, cut, axis=0)[::2]
        top[starts == ends] = -np.inf
        out.append(top)
        at += w * f
    return np.concatenate(out, axis=1)


def _activated(tops: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.maximum(np.where(np.isneginf(tops), 0, tops) + bias, 0)


def _hits(codes: np.ndarray, starts, ends) -> np.ndarray:
    """Function words of each language in each document."""
    cut, hits = np.stack([starts, ends], axis=1).ravel(), []
    for k in range(len(LANGS)):
        n = np.add.reduceat((codes == k).astype(np.int64), cut)[::2]
        n[starts == ends] = 0
        hits.append(n)
    return np.stack(hits, axis=1)


def _guess(hits: np.ndarray) -> np.ndarray:
    """The language with most function words of each document, or len(LANGS)."""
    return np.where(hits.max(axis=1) > 0, hits.argmax(axis=1), len(LANGS))


def features(texts: list, index: WordRows) -> list[tuple[np.ndarray, int]]:
    """(2, n) hash buckets of each text's words and stems, and the language its function words point to."""
    at = [np.concatenate([np.zeros(0, np.int64), *map(index.rows, word_slices(t))]) for t in texts]
    whole, stem, codes = np.array(index.whole, np.int32), np.array(index.stem, np.int32), np.array(index.code)
    hits = np.array([np.bincount(codes[x], minlength=len(LANGS) + 1)[: len(LANGS)] for x in at])
    return [(np.stack([whole[x], stem[x]]), int(k)) for x, k in zip(at, _guess(hits) if len(at) else ())]


def sample(docs: DataFrame, labels: DataFrame, p: Params, fit_rows=None) -> list[tuple[np.ndarray, int, int]]:
    """(features, language, label) of at most ``per_class`` labelled texts of each class, those with the smallest hash of doc_id.

    Executors turn the texts into hash buckets; the driver gets eight bytes for each of their words.
    """
    lab = labels.select("doc_id", "toxic").dropna()
    if fit_rows is not None:
        lab = lab.filter(fit_rows)
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key, ids = F.xxhash64("doc_id", F.lit(p.seed)), {}
    for y, n in enumerate(p.per_class):
        part = lab.filter((F.col("toxic") > 0) if y else (F.col("toxic") <= 0))
        ids |= {r[0]: y for r in part.orderBy(key, "doc_id").limit(n).select("doc_id").collect()}
    if not ids:
        return []
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = features(b.column(1).to_pylist(), WordRows(p))
            cols = [b.column(0), pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([k for _, k in got], pa.int32()), b.column(2)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "f", "lang", "key"])

    rows = docs.filter(docs["doc_id"].isin([*ids])).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("t"), F.xxhash64(docs["doc_id"], F.lit(p.seed)).alias("key"))
    got, last, held = {}, [], 0
    for r in rows.mapInArrow(lean(run), "doc_id long, f binary, lang int, key long").toLocalIterator():
        d, x = r["doc_id"], (bytes(r["f"]), r["lang"])
        if d not in ids:  # it was among the last by hash, and too much
            continue
        if d in got:
            held -= len(got[d][0])
            x = max(x, got[d])  # of rows that share a doc_id, the same one each time
        else:
            heappush(last, (-r["key"], -d))
        got[d] = x
        held += len(x[0])
        while held > 8 * p.words:  # whole rows go, the last by hash first, whatever the order of arrival
            _, d = heappop(last)
            held -= len(got.pop(-d)[0])
            del ids[-d]
    rng = np.random.default_rng(p.seed)
    order = rng.permutation(len(got))
    every = sorted(got.items())
    return [(np.frombuffer(f, np.int32).reshape(2, -1), lang, ids[d]) for d, (f, lang) in (every[k] for k in order)]


def fit(rows: list[tuple[np.ndarray, int, int]], p: Params = Params()) -> Model:
    """Train on three quarters of ``rows``, calibrate thresholds on the rest."""
    docs = [x for x, _, _ in rows]
    y = np.array([v for _, _, v in rows], dtype=np.float64)
    taps_n = sum(p.widths) * p.filters
    if not len(y) or y.min() == y.max():
        return Model(p, np.zeros((2 * p.buckets, taps_n), np.float32), np.zeros(len(p.widths) * p.filters), np.zeros(len(p.widths) * p.filters), -9.0, np.zeros(len(LANGS) + 1), True)
    pad = 2 * p.buckets  # the row of the padding stays zero
    rng = np.random.default_rng(p.seed)
    train = rng.permutation(len(docs))[: max(2, len(docs) * 3 // 4)]

    # Start: the first dimension of a bucket is the log-ratio of its document frequencies in both classes.
    emb = rng.normal(0, 0.05, (2 * p.buckets + 1, p.dims))
    emb[pad] = 0
    df = np.ones((2, 2 * p.buckets)) * 0.5
    for i in train:
        df[int(y[i]), np.unique(docs[i])] += 1
    n0, n1 = (y[train] == 0).sum(), (y[train] == 1).sum()
    emb[:pad, 0] = np.clip(np.log(df[1] / (n1 + 1)) - np.log(df[0] / (n0 + 1)), -3, 3)
    kernel = {w: rng.normal(0, 0.1, (w, p.dims, p.filters)) for w in p.widths}
    for w in p.widths:
        kernel[w][:, 0, :] += 0.6 / w
    size = len(p.widths) * p.filters
    bias, out, out_bias = np.full(size, -0.5), np.full(size, 1.0 / size), -1.0
    sq = {"emb": np.full_like(emb, 0.1), "bias": np.full_like(bias, 0.1), "out": np.full_like(out, 0.1), "b": 0.1} | {w: np.full_like(kernel[w], 0.1) for w in p.widths}
    weight = np.where(y == 1, 0.5 * len(train) / n1, 0.5 * len(train) / n0)

    def table() -> np.ndarray:
        return np.concatenate([emb[:pad] @ kernel[w][j] for w in p.widths for j in range(w)], axis=1).astype(np.float32)

    def step(name, value, grad):
        sq[name] += grad * grad
        value -= p.rate * grad / np.sqrt(sq[name])

    before = max(p.widths) - 1
    for _ in range(p.epochs):
        order = rng.permutation(train)
        for at in range(0, len(order), p.batch):
            own = order[at : at + p.batch]
            flat, starts, ends = _layout([docs[i][0] for i in own], pad, before)
            stems, _, _ = _layout([docs[i][1] for i in own], pad, before)
            vec = emb[flat] + emb[stems]
            pooled, arg, col = np.zeros((len(own), size)), np.zeros((len(own), size), dtype=np.int64), 0
            for w in p.widths:
                conv = vec @ kernel[w][w - 1]
                for j in range(w - 1):
                    conv[w - 1 - j :] += (vec @ kernel[w][j])[: -(w - 1 - j)]
                for k, (s, e) in enumerate(zip(starts, ends)):
                    if e > s:
                        m = conv[s:e].argmax(axis=0)
                        arg[k, col : col + p.filters] = s + m
                        pooled[k, col : col + p.filters] = conv[s + m, np.arange(p.filters)]
                    else:
                        arg[k, col : col + p.filters] = -1
                col += p.filters
            act = np.maximum(pooled + bias, 0)
            prob = 1 / (1 + np.exp(-(act @ out + out_bias)))
            err = (prob - y[own]) * weight[own] / len(own)
            back = (err[:, None] * out) * (act > 0) * (arg >= 0)
            g_emb = np.zeros_like(vec)
            g_kernel, col = {}, 0
            for w in p.widths:
                g_kernel[w] = np.zeros_like(kernel[w])
                for f in range(p.filters):
                    pos, g = arg[:, col + f], back[:, col + f]
                    live = np.flatnonzero(g)
                    for j in range(w):
                        at_j = pos[live] - (w - 1 - j)
                        g_kernel[w][j, :, f] = g[live] @ vec[at_j]
                        np.add.at(g_emb, at_j, g[live, None] * kernel[w][j, :, f])
                col += p.filters
            step("out", out, err @ act)
            g = err.sum()
            sq["b"] += g * g
            out_bias -= p.rate * g / np.sqrt(sq["b"])
            step("bias", bias, back.sum(axis=0))
            for w in p.widths:
                step(w, kernel[w], g_kernel[w])
            hit = np.flatnonzero(g_emb.any(axis=1) & (flat != pad))
            for rows_of in (flat, stems):
                at_rows, inv = np.unique(rows_of[hit], return_inverse=True)
                g_rows = np.zeros((len(at_rows), p.dims))
                np.add.at(g_rows, inv, g_emb[hit])
                sq["emb"][at_rows] += g_rows * g_rows
                emb[at_rows] -= p.rate * g_rows / np.sqrt(sq["emb"][at_rows])
    model = Model(p, table(), bias, out, out_bias, np.zeros(len(LANGS) + 1))
    held = np.setdiff1d(np.arange(len(docs)), train)
    cal = held if len(held) and 0 < y[held].sum() < len(held) else np.arange(len(docs))
    langs = np.array([rows[i][1] for i in cal])
    logits = np.concatenate([_logits(model, [docs[i] for i in cal[at : at + 64]]) for at in range(0, len(cal), 64)])
    everywhere = _threshold(logits, y[cal])
    for k in range(len(LANGS) + 1):
        own = langs == k
        enough = min((y[cal][own] == 1).sum(), (y[cal][own] == 0).sum()) >= 10
        model.thresholds[k] = _threshold(logits[own], y[cal][own]) if enough else everywhere
    return model


def _threshold(logit: np.ndarray, y: np.ndarray) -> float:
    """Between two neighbouring logits, where F0.5, which minds clean documents more, is highest; amid the best stretch."""
    order = np.argsort(logit)
    x, t = logit[order], y[order]
    above = np.cumsum(t[::-1])[::-1]  # toxic at or above each cut
    f1 = 1.25 * above / (np.arange(len(t), 0, -1) + 0.25 * t.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    below = x[best[0] - 1] if best[0] else x[0] - 2
    return float((below + x[best[-1]]) / 2)


def _logits(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    p, pad = m.params, 2 * m.params.buckets
    flat, starts, ends = _layout([x[0] for x in docs], pad, max(p.widths) - 1)
    stems, _, _ = _layout([x[1] for x in docs], pad, max(p.widths) - 1)
    real = (flat < pad)[:, None]
    taps = np.where(real, m.taps[np.minimum(flat, pad - 1)] + m.taps[np.minimum(stems, pad - 1)], 0)
    return _activated(_tops(taps, starts, ends, p), m.bias) @ m.out + m.out_bias


def score_texts(model: Model, batches: Iterator[list]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Scores and guessed languages of lists of texts (str, bytes or None)."""
    p, cache = model.params, Taps(model)
    before = max(p.widths) - 1
    for texts in batches:
        if model.constant:
            yield np.zeros(len(texts)), np.full(len(texts), len(LANGS))
            continue
        tops, hits = np.full((len(texts), len(model.bias)), -np.inf), np.zeros((len(texts), len(LANGS)), np.int64)
        todo: list[tuple[int, np.ndarray, np.ndarray]] = []  # text, lead and words of the slices at hand
        held = 0

        def flush():
            cache.catch_up()
            flat, starts, ends = _layout([x for _, _, x in todo], 0, before, [x for _, x, _ in todo])
            at = np.array([k for k, _, _ in todo])
            np.maximum.at(tops, at, _tops(cache.values[flat], starts, ends, p))
            np.add.at(hits, at, _hits(cache.codes[flat], starts, ends))
            todo.clear()

        for k, t in enumerate(texts):
            lead: list[bytes] = []
            for words in word_slices(t, p.slice_bytes):
                ahead = np.zeros(before, np.int64)
                ahead[before - len(lead) :] = cache.index.rows(lead)
                todo.append((k, ahead, cache.index.rows(words)))
                lead = [*lead, *words][-before:] if before else []
                held += len(words)
                if held > 32_768:  # a few slices at a time keep the tap matrix small
                    flush()
                    held = 0
                    if len(cache.index.whole) > p.cached_words:
                        cache.forget()
        if todo:
            flush()
        lang = _guess(hits)
        logit = _activated(tops, model.bias) @ model.out + model.out_bias
        yield 1 / (1 + np.exp(-np.clip(logit - model.thresholds[lang], -50, 50))), lang


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score, guessed): every row of ``docs`` as one struct, with its score and guessed language."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    at = docs.columns.index("text")

    def run(batches):
        kept = []

        def texts():
            for b in batches:
                kept.append(b.column(0))
                yield b.column(0).field(at).cast(pa.binary()).to_pylist()

        for s, lang in score_texts(shared.value, texts()):
            names = pa.array([[*LANGS, "other"][k] for k in lang], pa.string())
            yield pa.RecordBatch.from_arrays([kept.pop(), pa.array(s, pa.float64()), names], ["row", "score", "guessed"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, score double, guessed string"
    return rows.mapInArrow(lean(run), schema)


def trained(docs: DataFrame, labels: DataFrame, p: Params = Params(), fit_rows=None) -> Model:
    """A model fitted on the driver, which keeps nothing of the sample and the steps."""
    sparing()
    try:
        return fit(sample(docs, labels, p, fit_rows), p)
    finally:
        tidy()
