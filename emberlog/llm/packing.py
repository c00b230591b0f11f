"""Packing along a space-filling curve.

1. One pass tokenises every text and sums a fixed pseudorandom projection of its hashed ids; the ids and
   the few projected values are written to the shared folder (the only pass over the texts).
2. Means and deviations of the projections over all documents scale them to a grid; the Hilbert index of
   the grid cell is the sort key, and a hash of the row breaks ties, so that copies, which all fall on
   one cell, can still be dealt to many tasks.
3. The rows are range-partitioned by that key, and each task lays its documents end to end in
   sequences of ``size`` ids. The rest of a task is cut into sequences whose lengths are powers of two,
   which need no padding: a task of r left-over ids adds one sequence for each 1 bit of r, and nothing
   is padded at all.

Memory: a task holds one Arrow batch. Recovery: ids come from the written table, and keys, order and cuts
depend on the rows alone.

Defined results: null and empty texts are one end id; repeated rows are packed once each; a document
longer than a sequence runs on into the next.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, small_batches, stored
from .tokens import encoder, id_type

END = 1
DIMS, BITS = 4, 12


def directions(vocab: int, seed: int = 17) -> np.ndarray:
    """One pseudorandom row of DIMS signs for each id."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), size=(vocab, DIMS))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer grid points, one row each.

    Works down the bits: each level's orthant number is taken in Gray-code order inside the frame left by
    the levels above. A frame is an entry corner ``e`` and a direction ``d`` (Hamilton's formulation).
    """
    n = cells.shape[1]
    mask = (1 << n) - 1
    rows = len(cells)
    e, d, h = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)

    def turned(x, by):  # right rotation of n-bit words
        by = by % n
        return ((x >> by) | (x << (n - by))) & mask

    for level in range(bits - 1, -1, -1):
        corner = np.zeros(rows, np.int64)
        for j in range(n):
            corner |= ((cells[:, j] >> level) & 1) << j
        code = turned(corner ^ e, d + 1)
        rank = code.copy()
        for s in range(1, n):
            rank ^= code >> s
        h = (h << n) | rank
        # entry corner and direction of the child cell
        low = np.where(rank == 0, 0, 2 * ((rank - 1) // 2))
        entry = low ^ (low >> 1)
        e = e ^ turned(entry, -(d + 1))
        odd = np.where(rank % 2 == 0, rank - 1, rank)
        ones = np.zeros(rows, np.int64)  # trailing ones of odd
        run = odd.copy()
        for _ in range(n):
            bit = run & 1
            ones += bit
            run = np.where(bit == 1, run >> 1, 0)
        d = (d + np.where(rank == 0, 0, ones % n) + 1) % n
    return h


def projections(every: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """The summed ``signs`` of each array of ids over the root of its length; none gives zeros.

    A sum of signs follows from the number of positive ones, and those of all columns are counted at once, 16 bits each.
    """
    size = np.array([len(x) for x in every], np.int64)
    out = np.zeros((len(every), DIMS), np.float32)
    lanes = ((signs > 0).astype(np.uint64) << (16 * np.arange(DIMS, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    some = np.flatnonzero((size > 0) & (size < 1 << 16))
    if len(some):
        flat = np.concatenate([every[k] for k in some])
        sums = np.add.reduceat(lanes[flat], np.cumsum(size[some]) - size[some])
        count = (sums[:, None] >> (16 * np.arange(DIMS, dtype=np.uint64))) & np.uint64(0xFFFF)
        out[some] = (2 * count.astype(np.int64) - size[some, None]) / np.sqrt(size[some, None])
    for k in np.flatnonzero(size >= 1 << 16):
        out[k] = signs[every[k]].sum(axis=0, dtype=np.int64) / np.sqrt(size[k])
    return out


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids binary, n, p0..p3): ids with the end id, and the summed projection over sqrt(n)."""
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(tokenizer)
        signs, end = directions(enc.library.get_vocab_size()), np.array([END], enc.dtype).tobytes()
        for b in batches:
            every = enc.encode_all(b.column(1).to_pylist())
            raw, n = [ids.tobytes() + end for ids in every], [len(ids) + 1 for ids in every]
            proj = projections(every, signs)
            cols = [b.column(0), pa.array(raw, pa.binary()), pa.array(n, pa.int64()), *(pa.array(proj[:, j].astype(np.float64)) for j in range(DIMS))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n", *(f"p{j}" for j in range(DIMS))])
        enc.forget()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return rows.mapInArrow(lean(run), "doc_id long, ids binary, n long, " + ", ".join(f"p{j} double" for j in range(DIMS)))


def placed(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``key``, the place on the curve, and ``tie``, a hash that orders equal places."""
    stats = tokens.agg(*(f(f"p{j}").alias(f"{n}{j}") for j in range(DIMS) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([stats[f"m{j}"] or 0.0 for j in range(DIMS)])
    dev = np.array([stats[f"s{j}"] or 1.0 for j in range(DIMS)])
    half = 1 << (BITS - 1)

    @F.pandas_udf("long")
    def place(*cols):
        import pandas as pd

        z = (np.stack([c.to_numpy() for c in cols], axis=1) - mean) / dev
        grid = np.clip(half + z / 4 * half, 0, 2 * half - 1).astype(np.int64)  # four deviations each way
        return pd.Series(hilbert(grid))

    return tokens.withColumn("key", place(*(f"p{j}" for j in range(DIMS)))).withColumn("tie", F.xxhash64("doc_id", "ids"))


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, per_task: int = 32 << 20) -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset): one row for each piece, its ids as bytes.

    ``per_task`` is the bytes of ids that one task should get; the number of tasks follows the corpus.
    """
    spark = docs.sparkSession
    wide = id_type(tokenizer).itemsize
    rows = placed(stored(tokenised(docs, tokenizer), "tokens")).select("key", "tie", "doc_id", "ids", "n")
    total = rows.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")) if total else 1, -(-total * wide // per_task))
    rows = rows.repartitionByRange(tasks, "key", "tie", "doc_id").sortWithinPartitions("key", "tie", "doc_id")

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        seq, fill = 0, 0
        held: list[tuple] = []  # pieces of the open sequence

        def closed(pieces, seq_id):
            cols = list(zip(*[(d, s, i, n, base + seq_id, o) for d, s, i, n, o in pieces]))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        full: list[tuple] = []
        for b in batches:
            for doc, ids, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "n"))):
                at = 0
                while at < n:
                    take = min(size - fill, n - at)
                    held.append((doc, at, ids[at * wide : (at + take) * wide], n, fill))
                    at, fill = at + take, fill + take
                    if fill == size:
                        full += [(*x, seq) for x in held]
                        held, seq, fill = [], seq + 1, 0
            if full:
                cols = list(zip(*full))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(cols[:4], kinds)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(base + np.array(cols[5], np.int64)), pa.array(cols[4], pa.int64())], ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])
                full = []
        # the rest: one sequence for each power of two in its length, the largest first
        while held:
            room = 1 << (sum(len(x[2]) for x in held) // wide).bit_length() - 1
            own, used = [], 0
            while used < room:
                doc, at, ids, n, _ = held.pop(0)
                take = min(room - used, len(ids) // wide)
                own.append((doc, at, ids[: take * wide], n, used))
                if take * wide < len(ids):
                    held.insert(0, (doc, at + take, ids[take * wide :], n, 0))
                used += take
            yield closed(own, seq)
            seq += 1

    return rows.select("doc_id", "ids", "n").mapInArrow(lean(run), "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(pieces: DataFrame, wide: int) -> DataFrame:
    """The pieces' columns with lengths and checksums of their ids as little-endian 32-bit words."""
    small_batches(pieces.sparkSession)

    def run(batches):
        kind = np.dtype("<u2" if wide == 2 else "<u4")
        for b in batches:
            raw = b.column(2).to_pylist()
            sums = [zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in raw]
            cols = [b.column(0), b.column(1), pa.array([len(x) // wide for x in raw], pa.int64()), pa.array(sums, pa.int64()), b.column(3), b.column(4), b.column(5)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
