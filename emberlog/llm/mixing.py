"""Mixing sources to target weights, native DataFrame expressions only.

Each source's words are laid end to end in a pseudorandom order of its documents and cut into blocks of
``block`` words. Output shards of ``shard`` slots each draw a multinomial count for every source by its
share of the target. Drawn counts are numbered on from shard to shard within a source; a draw beyond the
source's quota of blocks goes to the sources that fall short, so every source ends at its quota exactly.
Slot k of a source is block perm_e(k mod B) for e = k div B, with one keyed permutation of the source's B
blocks for each pass, and blocks meet their documents in an equi-join on (source, index).

A quota never passes 2 B, so no block, and no document, is taken more than twice. Positions come from a
two-level running sum (over at most ``chunks`` totals for a source, then inside a chunk), so that a source
with a third of all rows is spread over many tasks; the join's keys are single blocks.

Defined results: null text has size 0 and is taken 0 times; rows without a doc_id take part like others; a null source is a source of its own, last in
order; sources without a word have target 0; equal rows are interchangeable; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACES, let, stored, words

#: Weights of the sources in order, repeating, and the share of all words that is mixed.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash): the words of every row."""
    t = F.coalesce(docs["text"], F.lit(""))
    n = F.size(F.split(t, SPACES)) - F.when(t.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) - F.when(t.rlike(r"[\x20\x09-\x0D]\z") | (t == ""), 1).otherwise(0)
    return docs.select(docs["doc_id"], docs["source"].cast("string").alias("source"), F.greatest(n, F.lit(0)).cast("long").alias("size"), F.xxhash64(docs["text"]).alias("text_hash"))


def targets(sized: DataFrame, block: int) -> DataFrame:
    """One row for each source: key, size, target, blocks, quota.

    The target is min(2 size, level * weight) at the level where targets add up to the share: what
    resharing the excess again and again ends in. Sources in order of 2 size / weight reach their bound
    one after another, so the level follows from running sums.
    """
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (place + 1).cast("int"))
    own = own.withColumn("weight", weight).withColumn("bound", (MOST * F.col("source_size")).cast("double"))
    own = own.withColumn("ratio", F.col("bound") / F.col("weight"))
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, every = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    goal = SHARE * F.sum("source_size").over(every)
    rest = goal - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    light = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    own = own.withColumn("level", rest / light)
    # while sources reach their bound the level of the others rises; from the first that doesn't it would fall
    level = F.max("level").over(every)
    own = own.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("bound", F.coalesce(level * F.col("weight"), F.col("bound")))))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    quota = F.least(F.round(F.col("target") * blocks / F.greatest("source_size", F.lit(1))).cast("long"), MOST * blocks)
    key = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
    return own.select("source", key.alias("key"), "source_size", "target", blocks.alias("blocks"), quota.alias("quota"))


def _unit(*what: Column) -> Column:
    """A pseudorandom number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*what), 11) / F.lit(float(1 << 53))


def draws(goals: DataFrame, shard: int, cells: int = 4096, seed: int = 31) -> DataFrame:
    """(key, shard, n): multinomial counts for each output shard, corrected to the quotas.

    A slot's uniform number finds its source in the cumulative shares through the cell it lies in: an
    equi-join on at most cells + sources rows.
    """
    spark = goals.sparkSession
    every = Window.partitionBy(F.lit(0))
    run = Window.orderBy("key")
    share = goals.filter("quota > 0").withColumn("total", F.sum("quota").over(every))
    share = share.withColumn("hi", F.sum("quota").over(run.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total"))
    share = share.withColumn("lo", F.coalesce(F.lag("hi").over(run), F.lit(0.0)))
    cdf = share.select("key", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    total = goals.agg(F.sum("quota")).first()[0] or 0
    slots = spark.range(total).select("id", F.floor(F.col("id") / shard).alias("shard"), _unit(F.col("id"), F.lit(seed)).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * cells))
    drawn = slots.join(cdf, "cell").filter("u >= lo AND u < hi").groupBy("key", "shard").agg(F.count("*").alias("n"))
    # number the draws of a source over its shards, inside a chunk of shards after the sums of the chunks before;
    # those past the quota are free, those missing are gaps
    drawn = drawn.withColumn("chunk", F.floor(F.col("shard") / cells))
    ahead, inside = (Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, -1) for by, on in ((["key"], "chunk"), (["key", "chunk"], "shard")))
    chunks = drawn.groupBy("key", "chunk").agg(F.sum("n").alias("own")).select("key", "chunk", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("base"))
    drawn = drawn.withColumn("in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(chunks, ["key", "chunk"])
    drawn = drawn.join(goals.select("key", "quota"), "key").withColumn("at", F.col("base") + F.col("in"))
    fit = F.greatest(F.least(F.col("n"), F.col("quota") - F.col("at")), F.lit(0))
    drawn = drawn.withColumn("fit", fit)
    missing = goals.select("key", "quota").join(drawn.groupBy("key").agg(F.sum("fit").alias("fit")), "key", "left")
    missing = missing.select("key", (F.col("quota") - F.coalesce("fit", F.lit(0))).alias("gap"), F.coalesce("fit", F.lit(0)).alias("at")).filter("gap > 0")
    return drawn.filter("fit > 0").select("key", "at", F.col("fit").alias("n")).union(missing.select("key", "at", F.col("gap").alias("n")))


def permuted(df: DataFrame, index: str, size: str, keys: list[str], rounds: int = 4, walk: int = 64) -> DataFrame:
    """``df`` with column ``index`` replaced by its image under a keyed permutation of 0 .. size - 1.

    A mixed-radix Feistel network permutes a grid of a x b cells with a = ceil(sqrt(size)), b =
    ceil(size / a); fewer than a cells lie past the size, and a value there is sent through again until it
    lies inside. A walk meets each cell past the size at most once; past 64 steps it could only go on where
    there are more than 64 such cells, with odds below 2^-384.
    """
    a = F.ceil(F.sqrt(F.col(size).cast("double"))).cast("long")
    df = df.withColumn("__a", a).withColumn("__b", F.ceil(F.col(size) / F.col("__a")).cast("long"))

    def turned(j: int):
        def left(s):
            return F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], F.lit(j), *(F.col(k) for k in keys)), F.col("__a")), F.col("__a")).alias("l"), s["r"].alias("r"))

        def right(s):
            return F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], F.lit(j), *(F.col(k) for k in keys)), F.col("__b")), F.col("__b")).alias("r"))

        return right if j % 2 else left

    def once(x: Column) -> Column:
        pair = F.struct(F.floor(x / F.col("__b")).cast("long").alias("l"), F.pmod(x, F.col("__b")).alias("r"))
        for j in range(rounds):
            pair = F.transform(F.array(pair), turned(j))[0]
        return F.transform(F.array(pair), lambda s: s["l"] * F.col("__b") + s["r"])[0]

    df = df.withColumn("__x", once(F.col(index)))
    again = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), F.col("__x"), lambda x, _: F.when(x < F.col(size), x).otherwise(once(x)))
    return df.withColumn(index, F.when(F.col("__x") < F.col(size), F.col("__x")).otherwise(again)).drop("__a", "__b", "__x")


def block_times(goals: DataFrame, shard: int) -> DataFrame:
    """(key, block_no, times): how often each drawn block is taken."""
    parts = int(goals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a few small rows of draws become all slots: deal them out first, or they'd all be walked in one task
    drawn = draws(goals, shard).repartition(parts, "key", "at")
    slots = drawn.select("key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("k"))
    slots = slots.join(goals.select("key", "blocks"), "key")
    slots = slots.select("key", "blocks", F.floor(F.col("k") / F.col("blocks")).alias("pass_no"), F.pmod("k", F.col("blocks")).alias("block_no"))
    return permuted(slots, "block_no", "blocks", ["key", "pass_no"]).groupBy("key", "block_no").agg(F.count("*").alias("times"))


def positions(sized: DataFrame, goals: DataFrame, chunks: int) -> DataFrame:
    """``sized`` with ``key`` and ``at``, the words of the source before the document."""
    order = F.xxhash64("doc_id", F.lit(3))
    rows = sized.join(goals.select(F.col("source").alias("__s"), "key"), sized["source"].eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("order", order).withColumn("chunk", F.pmod("order", F.lit(chunks)).cast("int"))
    totals = rows.groupBy("key", "chunk").agg(F.sum("size").alias("own"))
    ahead = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("key", "chunk", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "chunk").orderBy("order", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(totals, ["key", "chunk"]).withColumn("at", F.col("base") + F.col("in"))


def taken_blocks(docs: DataFrame, block: int = 32, shard: int = 4096, chunks: int = 1024):
    """(goals, rows, pieces): rows with a row number; pieces (row, skip, n, times), the stretches of each row in drawn blocks."""
    sized = stored(sizes(docs), "sizes")
    goals = stored(targets(sized, block), "goals")
    rows = positions(sized, goals, chunks)
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    pieces = rows.filter("size > 0").select("key", "doc_id", "text_hash", "size", "at", F.explode(F.sequence(first, last)).alias("block_no"))
    pieces = pieces.join(block_times(goals, shard), ["key", "block_no"])
    lo, hi = F.greatest(F.col("block_no") * block, F.col("at")), F.least((F.col("block_no") + 1) * block, F.col("at") + F.col("size"))
    pieces = pieces.select("key", "doc_id", "text_hash", "size", "at", (lo - F.col("at")).alias("skip"), (hi - lo).alias("n"), "times")
    return goals, rows, pieces


def report(docs: DataFrame, block: int = 32, shard: int = 4096, chunks: int = 1024) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``."""
    goals, rows, pieces = taken_blocks(docs, block, shard, chunks)
    got = pieces.groupBy("key", "at", "size").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    out = rows.join(got, ["key", "at", "size"], "left").join(goals.select("key", "source_size", "target"), "key")
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, block: int = 32, shard: int = 4096, chunks: int = 1024) -> DataFrame:
    """The mix as rows of ``docs``: one row for each pass that takes something of a document, with the words it takes.

    A document taken whole keeps its text as it is; else the words of its drawn blocks follow each other
    with one space between. Documents without a drawn block are not in the mix; those without words stay as they are.
    """
    _, rows, pieces = taken_blocks(docs, block, shard, chunks)
    parts = pieces.select("doc_id", "text_hash", "key", "at", "size", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("pass_no"), F.struct("skip", "n").alias("piece"))
    parts = parts.groupBy("doc_id", "text_hash", "key", "at", "size", "pass_no").agg(F.array_sort(F.collect_list("piece")).alias("parts"), F.sum("piece.n").alias("taken"))
    # rows that are equal in doc_id and text stand at places of their own; number both sides alike
    copy = Window.partitionBy("doc_id", "text_hash", "__key").orderBy("__at")
    placed = rows.filter("size > 0").select("doc_id", "text_hash", F.col("key").alias("__key"), F.col("at").alias("__at")).withColumn("copy", F.row_number().over(copy))
    parts = parts.join(placed.withColumnsRenamed({"doc_id": "__id", "text_hash": "__th"}), F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__th") == F.col("text_hash")) & (F.col("__key") == F.col("key")) & (F.col("__at") == F.col("at")))
    parts = parts.select(F.col("__id").alias("__d"), F.col("__th").alias("__h"), F.col("__key").alias("__k"), F.col("copy").alias("__c"), "size", "taken", "parts")
    own_key = F.xxhash64(F.coalesce(docs["source"].cast("string"), F.lit("")), docs["source"].isNull())
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["doc_id"].alias("__id"), F.xxhash64(docs["text"]).alias("__th"), own_key.alias("__sk"))
    plain = [F.col("__row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    own = own.withColumn("__copy", F.row_number().over(Window.partitionBy("__id", "__th", "__sk").orderBy(F.xxhash64(*plain))))
    both = own.join(parts, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__h")) & (F.col("__sk") == F.col("__k")) & (F.col("__copy") == F.col("__c")), "left")
    text = F.col("__row.text")
    cut = let(words(text), lambda w: F.concat_ws(" ", F.transform("parts", lambda p: F.concat_ws(" ", F.slice(w, (p["skip"] + 1).cast("int"), p["n"].cast("int"))))))
    new_text = F.when(F.col("parts").isNull() | (F.col("taken") == F.col("size")), text).otherwise(cut)
    empty = F.length(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")) == 0
    both = both.filter(F.col("parts").isNotNull() | empty).withColumn("__text", new_text)
    new = {"text": F.col("__text")} | ({"n_chars": F.length("__text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return both.select(*[new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])
