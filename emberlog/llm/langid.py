"""Language identification by compression.

Each learned language gets a raw-content zstandard dictionary of its own text. A text is reduced to its
lower-cased letter runs and compressed whole with every dictionary; the smallest output names the
language. The margin to the runner-up gives the score, and a narrow margin marks the row as rejected.

Learning takes whole texts of a bounded sample of rows: the row with the smallest hash in each of ``slots`` hash
slots of a language (a partial aggregate of fixed-width values), among rows of up to ``most`` bytes; of these, in
order of their hashes, those that together have up to ``most`` bytes. Scoring streams whole texts; no shuffle.

Defined results: rows without a doc_id are judged like others, and never learned from; null texts and texts without a letter give ``und`` and score 0; ties go to the language
that sorts first; with nothing learned every row is ``und``.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, small_batches

OTHER = regex.compile(r"[^\p{L}]+")


def normal(text: str) -> bytes:
    """Lower-cased runs of letters, one space around each."""
    return (" " + OTHER.sub(" ", text.lower()).strip() + " ").encode()


def learn(docs: DataFrame, fit_rows, slots: int = 64, most: int = 96_000, seed: int = 5) -> dict[str, bytes]:
    """One dictionary for each non-null lang among ``fit_rows``, of up to ``slots`` whole texts and ``most`` bytes."""
    own = docs.filter(fit_rows & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.xxhash64("doc_id", F.lit(seed))
    # rows with a letter only; the check is a plain Java pattern, so the scan stays in the JVM
    own = own.filter((F.octet_length("text") <= most) & F.col("text").rlike(r"\p{L}{3}")).select("doc_id", "lang", key.alias("key"))
    least = own.groupBy("lang", F.pmod("key", F.lit(slots)).alias("slot")).agg(F.min("key").alias("key"))
    keys = {r["key"] for r in least.select("key").collect()}
    if not keys:
        return {}
    got = docs.filter(fit_rows & key.isin([*keys]) & (F.octet_length("text") <= most)).select("lang", "text", key.alias("key")).dropna().distinct()
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in got.toLocalIterator():
        parts.setdefault(r["lang"], []).append((r["key"], normal(r["text"])))
    out = {}
    for lang, texts in sorted(parts.items()):
        out[lang] = b""
        for _, t in sorted(texts):
            out[lang] += t if len(out[lang]) + len(t) <= most else b""
    return {lang: raw for lang, raw in out.items() if raw}


class Judge:
    """Compressors, made once in a worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 5, narrow: float = 0.01):
        self.langs, self.narrow, self.by = [*dictionaries], narrow, []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        data = normal(text) if text else b"  "
        if len(data) <= 2 or not self.by:
            return "und", 0.0, True
        sizes = [f(data) for f in self.by]
        sizes = [len(x) for x in sizes]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((x for k, x in enumerate(sizes) if k != best), default=len(data) + 1)
        margin = rest - sizes[best]
        return self.langs[best], 1 / (1 + math.exp(-min(margin, 400) / 4)), margin < self.narrow * rest


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(row, lang_pred, score, rejected) for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(dictionaries)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("t"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"

    def run(batches):
        judge = Judge(shared.value)
        for b in batches:
            got = [judge(t) for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(lean(run), schema)
