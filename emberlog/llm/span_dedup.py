"""Substring dedup over sliding sentence spans.

A sentence ends after a word with . ! or ? and white space behind it, or at a newline; a sentence of ``gap`` words
or more is cut further by winnowing, after the word of least hash of every ``gap`` in a row. Cuts follow the
content: a passage pasted into other text is cut alike wherever it stands, but for less than ``gap`` words at
either edge, and no two cuts are more than ``gap`` words apart. A run starts at each cut and takes at least ``run``
sentences and ``min_words`` words; others are counted back from each sentence's end, so that a passage is
covered to its last sentence. With 8 and 24 words any 50 words that two texts share hold a whole run. Every run is
hashed. The hashes are joined over the whole corpus; the first document with a run (least doc_id) keeps it,
and its first place there; sentences that any other occurrence covers are removed from their text, the rest of
which stays as it is.

Python works on all texts of an Arrow batch at once (see ``_words``): cuts, runs and their hashes are numpy
operations on the batch's words. Counting is a partial aggregate, and the join's hot keys (a passage in a third of
all documents) are joined by broadcast. Texts are cut a second time for the removal, rather than written with
their cuts.

Defined results: null text stays null; a text without a word has no sentences; rows that share a doc_id count as
one document; a row without a doc_id takes no part in the join and only loses what it says twice itself; a text
with fewer sentences, or words, than a run loses nothing but nothing of it is found elsewhere either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, small_batches, stored
from ._words import Sequence, Words, hashes, words_of

#: Words that are winnowed at once.
SLICE = 1 << 16


def _least(h: np.ndarray, sentence: np.ndarray, gap: int) -> np.ndarray:
    """Whether a word has the least hash, as the last one that has, of any ``gap`` words in a row of its sentence."""
    n = len(h)
    reach = np.ones(n, np.int8)
    left, right = np.ones(n, bool), np.ones(n, bool)
    for d in range(1, min(gap, n)):
        same, up = sentence[d:] == sentence[:-d], h[:-d] >= h[d:]
        left[:d], right[n - d :] = False, False
        left[d:] &= same & up
        right[:-d] &= same & ~up
        reach += left
        reach += right
    return reach >= gap


@dataclass
class Cuts:
    """The sentences and runs of some texts; sentences are numbered through all of them."""

    words: Words
    edges: np.ndarray  # first sentence of each text, and the number of all
    bounds: np.ndarray  # first word of each sentence, counted through all texts, and the number of all
    start: np.ndarray  # first sentence of each run
    end: np.ndarray  # sentence past its last
    text: np.ndarray  # its text
    hashes: np.ndarray
    again: np.ndarray  # whether the same run came before in the text

    def ends(self, k: int) -> np.ndarray:
        """Byte offsets of the ends of the sentences of text ``k``, which together make up the whole text."""
        inner = self.bounds[self.edges[k] + 1 : self.edges[k + 1]]
        return np.append(self.words.starts[inner], self.words.texts[k + 1]) - self.words.texts[k]


def _stops(w: Words) -> np.ndarray:
    """Whether a sentence ends with a word: by its last byte, or by a newline before the next."""
    n = len(w.starts)
    stop = np.isin(w.data[w.ends - 1], np.frombuffer(b".!?", np.uint8)) & (w.ends < np.append(w.starts[1:], len(w.data) + 1))
    stop[w.edges[1:][w.edges[1:] > w.edges[:-1]] - 1] = True  # the last of a text
    lines = np.searchsorted(w.ends, np.flatnonzero(w.data == 10), "right") - 1
    stop[lines[lines >= 0]] = True
    return stop if n else np.zeros(0, bool)


def cuts(column: pa.Array, run: int = 3, min_words: int = 24, gap: int = 8) -> Cuts:
    w = words_of(column)
    own, stop = hashes(w), _stops(w)
    n, found = len(own), [np.zeros(1, np.int64)]
    for a in range(0, n, SLICE):
        b, lo = min(a + SLICE, n), max(0, a - gap)
        part = slice(lo, min(b + gap, n))
        cut = _least(own[part], np.cumsum(stop[part]) - stop[part], gap)[a - lo : b - lo] | stop[a:b]
        found.append(np.flatnonzero(cut) + a + 1)
    bounds = np.concatenate(found)
    edges = np.searchsorted(bounds, w.edges)
    first, last = edges[:-1], edges[1:]
    own_text = np.repeat(np.arange(len(column)), last - first)
    # a run takes at least ``run`` sentences, and further ones until it has min_words words
    start = np.arange(len(bounds) - 1)
    end = np.maximum(start + run, np.searchsorted(bounds, bounds[:-1] + min_words))
    fits = end <= last[own_text]
    start, end = start[fits], end[fits]
    # and back from the ends of sentences
    stops = np.flatnonzero(stop[bounds[1:] - 1]) + 1
    back = np.minimum(stops - run, np.searchsorted(bounds, bounds[stops] - min_words, "right") - 1)
    fits = back >= first[own_text[stops - 1]]
    code = np.unique(np.concatenate([start, back[fits]]) * (len(bounds) + 1) + np.concatenate([end, stops[fits]]))
    start, end = code // (len(bounds) + 1), code % (len(bounds) + 1)
    hashed = Sequence(own).hashes(bounds[start], bounds[end])
    text = own_text[start]
    order = np.lexsort((hashed, text))
    again = np.zeros(len(hashed), bool)
    again[order[1:]] = (hashed[order][1:] == hashed[order][:-1]) & (text[order][1:] == text[order][:-1])
    return Cuts(w, edges, bounds, start, end, text, hashed.view(np.int64), again)


def removed(c: Cuts, elsewhere: list) -> np.ndarray:
    """For each sentence, whether a repeated run that is not the first covers it; ``elsewhere``: hashes for each text, or None."""
    hit = c.again.copy()
    where = np.searchsorted(c.text, np.arange(len(elsewhere) + 1))
    for k, hashes in enumerate(elsewhere):
        if hashes is not None and len(hashes):
            hit[where[k] : where[k + 1]] |= np.isin(c.hashes[where[k] : where[k + 1]], hashes)
    depth = np.bincount(c.start[hit], minlength=len(c.bounds)) - np.bincount(c.end[hit], minlength=len(c.bounds))
    return np.cumsum(depth)[:-1] > 0


def repeated(docs: DataFrame, run: int = 3, min_words: int = 24, hot: int = 4096) -> DataFrame:
    """(doc_id, runs): hashes of the runs that an earlier document has, for documents with any.

    Whether a run goes depends on the doc_id alone, so rows that share one need not be told apart. Runs of over
    ``hot`` documents, at most one for each ``hot`` runs of the input, are broadcast, so that no task gathers one.
    """
    small_batches(docs.sparkSession)

    def cut(batches):
        for b in batches:
            c = cuts(b.column(1), run, min_words)
            n = np.bincount(c.text[~c.again], minlength=b.num_rows)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(c.hashes[~c.again]))
            yield pa.RecordBatch.from_arrays([b.column(0), runs], ["doc_id", "runs"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).filter("doc_id IS NOT NULL")
    held = stored(rows.mapInArrow(lean(cut), "doc_id long, runs array<bigint>"), "runs")
    every = held.select("doc_id", F.explode("runs").alias("run"))
    least = every.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    shared = stored(least.filter("first < last").select("run", "first", "n"), "shared-runs")
    often = F.broadcast(shared.filter(F.col("n") > hot).select("run", "first"))
    rare = shared.filter(F.col("n") <= hot).select("run", "first")
    later = every.join(often, "run").unionByName(every.join(often.select("run"), "run", "left_anti").join(rare, "run")).filter("doc_id > first")
    return later.groupBy("doc_id").agg(F.collect_list("run").alias("runs"))


def dedup(docs: DataFrame, run: int = 3, min_words: int = 24) -> DataFrame:
    """(row, text, n_sentences, n_removed) for every row of ``docs``: the row as it was, its text as it is now."""
    small_batches(docs.sparkSession)
    found = repeated(docs, run, min_words).select(F.col("doc_id").alias("__d"), F.col("runs").alias("__r"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("__doc"))
    rows = rows.join(found, F.col("__doc") == F.col("__d"), "left").select("row", F.col("__r").alias("runs"))
    at = docs.columns.index("text")

    def cut(batches):
        for b in batches:
            column = b.column(0).field(at)
            c = cuts(column, run, min_words)
            offsets, hashes = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            gone = removed(c, [hashes[x:y] for x, y in zip(offsets[:-1], offsets[1:])])
            counts = np.diff(c.edges)
            upto = np.concatenate([[0], np.cumsum(gone)])[c.edges]
            lost = np.diff(upto)
            if lost.any():
                texts = column.cast(pa.binary()).to_pylist()
                for k in np.flatnonzero(lost):
                    t, ends = texts[k], c.ends(k).tolist()
                    own = gone[c.edges[k] : c.edges[k + 1]]
                    texts[k] = b"".join(t[x:y] for x, y, g in zip([0, *ends], ends, own) if not g)
                column = pa.array(texts, pa.binary())
            cols = [b.column(0), column.cast(pa.string()), pa.array(counts, pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "text", "n_sentences", "n_removed"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_sentences long, n_removed long"
    return rows.mapInArrow(lean(cut), schema)


def cleaned(docs: DataFrame, run: int = 3, min_words: int = 24) -> DataFrame:
    """``docs`` with the texts that remain (and n_chars to match, where there is such a column)."""
    out = dedup(docs, run, min_words)
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
