"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Fingerprints are computed once for each text. Equal fingerprints collapse to one vertex before any pair
is looked at, so groups of copies cost nothing. The 64 bits are cut into ``most + extra`` blocks; two
fingerprints that differ in at most ``most`` bits agree on at least ``extra`` whole blocks, so each is filed
under every choice of ``extra`` blocks, which keeps unrelated neighbours rare: 15 keys of about 21 bits for 4 bits
of distance and up to 20 million fingerprints, 35 of 27 bits up to a billion, 70 of 32 bits above.
Within a key the distances are verified. Small buckets compare all pairs; in larger ones centres link
their whole ball first, then only members of different clusters are compared, one link for each pair of
clusters: linear for a group of near copies, and never a pair list. Links feed connected components, whose vertices
go by their least doc_id, so that a component's root is its name and no component is gathered for it.

A bucket's distinct fingerprints stream through one task at 8 bytes each. The length of the keys follows the number of
fingerprints, so that a bucket holds few that are unrelated; one in which many share a key without being close
would take time by the square of their number.

Defined results: a text of fewer than ``width`` words is one shingle; without a word the fingerprint is
zero and links like any other; a null doc_id never is a component's name unless nothing else is there;
repeated rows give repeated rows.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_words, lean, small_batches, stored
from ._graph import components


def fingerprint(text, width: int = 4) -> int:
    """Unsigned 64-bit fingerprint; a bit is set if over half of the shingle hashes have it."""
    words = byte_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], dtype=np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a bounded bit matrix for very long texts
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * set_bits > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], ["doc_id", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("t"))
    return rows.mapInArrow(lean(run), "doc_id long, fp long")


def extra_blocks(n: int, most: int = 4) -> int:
    """How many blocks a key should take, that ``n`` fingerprints put about eight unrelated ones under a key at most."""
    return next(k for k in range(2, 64) if 64 * k / (most + k) + 3 >= log2(max(n, 1)) or most + k == 64)


def block_keys(fp, most: int = 4, extra: int = 2):
    """One key for each choice of ``extra`` of the ``most + extra`` blocks."""
    n = most + extra
    edges = [64 * k // n for k in range(n + 1)]
    keys = []
    for which, chosen in enumerate(combinations(range(n), extra)):
        key = F.lit(which).cast("long")
        for k in chosen:
            wide = edges[k + 1] - edges[k]
            key = F.shiftleft(key, wide) + F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << wide) - 1))
        keys.append(key)
    return F.array(*keys)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def bucket_links(fps: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join exactly what the links of all pairs would join, for the distinct fingerprints of one bucket."""
    n, label, links, count = len(fps), np.full(len(fps), -1, np.int64), [], 0
    while (free := np.flatnonzero(label < 0)).size:
        c = free[0]
        near = np.flatnonzero(_popcount(fps ^ fps[c]) <= most)
        old = np.unique(label[near])
        old = old[old >= 0]
        label[near] = count
        label[np.isin(label, old)] = count
        others = near[near != c]
        links.append((np.full(len(others), fps[c]), fps[others]))
        count += 1
    # members of different clusters may still be close: compare every cluster but the largest with the rest
    names, sizes = np.unique(label, return_counts=True)
    for name in names[np.argsort(sizes)][:-1]:
        own = np.flatnonzero(label == name)
        rest = np.flatnonzero(label != name)
        for x in own:
            near = rest[_popcount(fps[rest] ^ fps[x]) <= most]
            _, first = np.unique(label[near], return_index=True)
            near = near[first]
            links.append((np.full(len(near), fps[x]), fps[near]))
    return links


def links(fps: DataFrame, most: int = 4, small: int = 32, extra: int | None = None) -> DataFrame:
    """(a, b): verified links between distinct fingerprints ``fp``; enough to join all that are close."""
    small_batches(fps.sparkSession)
    extra = extra or extra_blocks(fps.count(), most)
    filed = fps.select("fp", F.explode(block_keys(F.col("fp"), most, extra)).alias("key"))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = filed.repartition(parts, "key").sortWithinPartitions("key", "fp").select("key", "fp")

    def emit(key: np.ndarray, fp: np.ndarray):
        edge = np.flatnonzero(np.diff(key)) + 1
        starts, sizes = np.concatenate([[0], edge]), np.diff(np.concatenate([[0], edge, [len(key)]]))
        found = []
        many = np.repeat(sizes, sizes) > small
        k, f = key[~many], fp[~many]
        for step in range(1, int(sizes[sizes <= small].max(initial=1))):
            hit = np.flatnonzero((k[step:] == k[:-step]) & (_popcount(f[step:] ^ f[:-step]) <= most))
            if hit.size:
                found.append((f[hit], f[hit + step]))
        for s, size in zip(starts, sizes):
            if size > small:
                found += bucket_links(fp[s : s + size], most)
        a = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.uint64)
        b = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if last or (held and held[-1][0][-1] != key[0]):
                held.append((key[:last], fp[:last]))
                yield emit(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                held = []
            held.append((key[last:], fp[last:]))
        if held:
            yield emit(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))

    return filed.mapInArrow(lean(run), "a long, b long").distinct()


def classes(docs: DataFrame, width: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the least doc_id of its component."""
    own = stored(fingerprints(docs, width), "fingerprints")
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # vertices go by their least doc_id; those of rows without one get names past all doc_ids
    last = own.agg(F.max("doc_id")).first()[0] or 0
    vertices = stored(least.select("fp", F.coalesce("least", F.monotonically_increasing_id() + F.lit(last + 1)).alias("name")), "vertices")
    pairs = links(vertices.select("fp"), most)
    for side in ("a", "b"):
        pairs = pairs.join(vertices.select(F.col("fp").alias(side), F.col("name").alias(f"{side}_name")), side)
    roots = components(pairs.select(F.col("a_name").alias("a"), F.col("b_name").alias("b")))
    named = vertices.join(roots, vertices["name"] == roots["node"], "left").select("fp", F.coalesce("root", "name").alias("root"))
    return own.join(named, "fp").select("doc_id", "fp", F.when(F.col("root") <= last, F.col("root")).alias("component_id"))


def kept(docs: DataFrame, width: int = 4, most: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its component; every column stays.

    Rows without a doc_id cannot be named and stay.
    """
    gone = classes(docs, width, most).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
