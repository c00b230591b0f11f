"""Quality rules with cross-document line frequency, native DataFrame expressions only.

One scan computes each row's base figures with higher-order functions and the hashes and sizes of its normalised
lines, and writes them to the shared folder; everything else reads that small table. Then distinct documents are
counted for each (host, line), lines above ``max_docs`` are removed, and documents that lose too much are rejected.

The count is a two-level aggregate: the first level is keyed by (line, document), so a line that sits
in a third of all documents is spread over all tasks and reaches the second level as one partial count
for each task. Marking the frequent lines is an equi-join whose hot rows are salted by document; both its sides are
exchanged for it, so that adaptive execution splits what a salt doesn't.

Defined results: null text counts as no words and fails the base rule; repeated rows of one doc_id count
as one document of its host, and rows without a doc_id as none, but they lose their lines like others; a null host
is a host of its own; a document without a countable line loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CHARS, SPACES, let, stored, words

#: The symbols that the base rule counts.
SYMBOLS = "#*$%&|<>"


def repeated_window_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the same text.

    The hashed windows are sorted with their positions, so equal ones are neighbours: n log n, no pairs.
    """
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def positions(s):
        same = lambda k, j: F.get(s, j)["h"].eqNullSafe(F.get(s, k)["h"])
        hit = F.filter(s, lambda x, k: same(k, k + 1) | ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def covered(p):
        steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(n < 4, F.lit(0)).otherwise(let(let(F.sort_array(windows), positions), covered)).cast("long")


def base_figures(docs: DataFrame, text: str = "text") -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every row."""
    t = F.coalesce(docs[text], F.lit(""))
    solid = F.length(F.translate(t, SPACE_CHARS, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    return [
        let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words"))).alias("__w"),
        solid.cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    ]


def normal_lines(text: Column) -> Column:
    """Distinct (hash, words) of the normalised lines that hold a word: lower case, digits as 0, one space."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\p{Nd}+", "0"), SPACES, " ")))
    return F.filter(lines, lambda x: x != "")


def lines_of(docs: DataFrame, host: str) -> Column:
    """(line, n) for each line, in order, repeats included: a 64-bit key of (host, line), and its words."""
    own, null = F.coalesce(docs[host], F.lit("")), docs[host].isNull()
    return F.transform(normal_lines(docs["text"]), lambda x: F.struct(F.xxhash64(own, null, x).alias("line"), F.size(F.split(x, " ")).alias("n")))


def frequent_lines(rows: DataFrame, max_docs: int) -> DataFrame:
    """(line) keys that more than ``max_docs`` distinct documents hold, of rows (doc_id, lines)."""
    held = rows.filter("doc_id IS NOT NULL").select("doc_id", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    return held.groupBy("line", "doc_id").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs).select("line")


def _salted(common: DataFrame, salts: int) -> DataFrame:
    """The merge join is asked for at every size: the frequent lines have no bound that would allow a broadcast."""
    return common.select("line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).hint("merge")


def line_loss(rows: DataFrame, max_docs: int = 20, salts: int = 32) -> DataFrame:
    """(id, lost): words of a row's lines that the frequency limit removes, for rows (id, doc_id, lines) that lose any."""
    every = rows.select("id", F.explode("lines").alias("x")).select("id", "x.line", "x.n", F.pmod("id", F.lit(salts)).cast("int").alias("salt"))
    lost = every.join(_salted(frequent_lines(rows, max_docs), salts), ["line", "salt"], "left_semi")
    return lost.groupBy("id").agg(F.sum("n").alias("lost"))


def judge(docs: DataFrame, host: str = "source", max_docs: int = 20, most_lost: float = 0.5, salts: int = 32) -> DataFrame:
    """Figures and verdict of every row of ``docs``.

    ``base_failed``: under 50 words, or over half of them in repeated windows. ``kept``: not base_failed
    and no more than ``most_lost`` of the words removed by the line limit.
    """
    own = docs.select(docs["doc_id"], docs["text"], docs[host].alias("source"))
    rows = own.select(F.monotonically_increasing_id().alias("id"), "doc_id", lines_of(own, "source").alias("lines"), *base_figures(own))
    rows = stored(rows, "lines")  # ids stay as written
    out = rows.drop("lines").join(line_loss(rows, max_docs, salts), "id", "left")
    n, rep = F.col("__w.n_words"), F.col("__w.n_repeat_words")
    failed = (n < 50) | (100 * rep > 50 * n)
    lost_n = F.coalesce(F.col("lost"), F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", rep.alias("n_repeat_words"), failed.alias("base_failed"), (~failed & (lost_n <= most_lost * n)).alias("kept"), lost_n.alias("n_lost_words"))


def cleaned(docs: DataFrame, host: str = "source", max_docs: int = 20, salts: int = 32) -> DataFrame:
    """``docs`` without the lines above the limit; blank lines stay, and a text that loses nothing stays as it is."""
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["doc_id"], lines_of(docs, host).alias("lines"), F.monotonically_increasing_id().alias("id"))
    own = stored(own, "lines")
    every = own.select("id", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"), F.pmod("id", F.lit(salts)).cast("int").alias("salt"))
    lost = every.join(_salted(frequent_lines(own, max_docs), salts), ["line", "salt"], "left_semi").groupBy("id").agg(F.collect_set("line").alias("__lost"))
    both = own.select("id", "__row").join(lost, "id", "left")
    name = F.coalesce(F.col("__row")[host], F.lit(""))
    normal = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\p{Nd}+", "0"), SPACES, " "))
    stays = lambda x: (normal(x) == "") | ~F.array_contains("__lost", F.xxhash64(name, F.col("__row")[host].isNull(), normal(x)))
    text = F.col("__row")["text"]
    text = F.when(F.col("__lost").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))
    both = both.withColumn("__text", text)
    new = {"text": F.col("__text")} | ({"n_chars": F.length("__text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return both.select(*[new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])
