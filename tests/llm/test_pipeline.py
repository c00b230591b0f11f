"""The corpus pipeline end to end on the smallest tables, and the SQL of the training-data queries."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberlog.llm import _common, _words, ann, near_dup, packing, registry, sql, tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "mixing", "packing"]
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.select("doc_id").collect()} and len(out) > 50


def odd_tables(spark, folder, rows):
    """documents with odd rows and columns whose names stages use inside, and labels."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.lit(7).alias(c) for c in ("row", "score", "key", "runs", "name", "size", "n", "t", "copy")))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, None), (None, 1), (99, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_take_odd_rows(spark, tmp_path):
    rng = random.Random(22)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    same, passage = text(60), text(70)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "x"), (4, same), (5, same), (5, same), (6, text(30) + " " + passage), (7, passage + " " + text(30)), (8, text(20_000)), (None, same), (None, None)]
    rows = [(d, t, (None, "en")[k % 2], (None, "a", "b")[k % 3], None if t is None else len(t)) for k, (d, t) in enumerate(rows)]
    docs = odd_tables(spark, str(tmp_path), rows)
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        at = at.cache()
        kept[name] = at.collect()
    assert len(kept["toxicity"]) == len(rows)
    stay = sorted((r["doc_id"] for r in kept["simhash near-dedup"]), key=str)
    assert stay == sorted([0, 3, 4, 6, 7, 8, None, None], key=str)  # texts without a word are equal, so the first stays; rows without an id stay
    text_of = {r["doc_id"]: r["text"] for r in kept["substring dedup"]}
    assert text_of[6] == rows[7][1] and len(text_of[7].split()) < 60 and text_of[8] == rows[9][1] and text_of[4] == same
    assert {r["row"] for r in kept["mixing"]} == {7}
    packed = corpus_pipeline.STAGES[4][1](spark, at, str(tmp_path)).collect()
    whole = lambda d: sum(r["length"] for r in packed if r["doc_id"] == d)
    assert whole(8) > 20_000 and {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept["mixing"]}


def test_empty_tables(spark, tmp_path):
    odd_tables(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [*registry.ORACLES])
def test_sql(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = c.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, got.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())


@pytest.mark.parametrize("name", [*sql.PARTS])
def test_sql_of_some_columns(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = c.execute(sql.PARTS[name])
    names = [d[0] for d in got.description]
    df = registry.QUERIES[name](spark, DATA)
    df = df.withColumn("target", F.round("target", 3)) if "target" in names else df
    assert sorted(map(str, got.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())


def test_ann_recall_at_every_twentieth(spark):
    """Queries are all ids divisible by 20, the truth is exact, and leaves are small enough that there are many."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    every = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in rows.collect() if r["embedding"] is not None}
    every = {k: v for k, v in every.items() if np.isfinite(v).all() and v.any()}
    ids = np.array(sorted(every))
    v = np.stack([every[k] for k in ids])
    got = {}
    for r in ann.search(rows, F.col("vec_id") % 20 == 0, leaf=64).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    queries = [k for k in ids if k % 20 == 0]
    hits = 0
    for q in queries:
        d = np.sqrt(((v - every[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert set(got) == {*queries} and hits >= 0.9 * 10 * len(queries)


def test_driver_holds_no_tables_and_starts_no_processes(spark):
    """Planning the packing needs no encoder on the driver, and a written table no marker whose mode a process sets."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    tokens.encoder.cache_clear()
    assert packing.pack(docs, registry.TOKENIZER).select("doc_id").distinct().count() == 2 and tokens.encoder.cache_info().currsize == 0
    (file,) = {f.rpartition("/")[0].removeprefix("file://") for f in _common.stored(docs, "marker").inputFiles()}
    assert not [f for f in os.listdir(file) if "SUCCESS" in f]


def _shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def _alike(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b)


def test_near_dedup_is_by_simhash():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    marks = [near_dup.fingerprint(base), near_dup.fingerprint(np.concatenate([base[100:], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])), near_dup.fingerprint(rng.integers(0, 1 << 63, 900, dtype=np.uint64))]
    bits = [[bool(_words.mixed(np.array([h]) ^ near_dup._WORDS)[k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in (0, 70, 511)] for h in base]
    votes = np.array(bits).sum(axis=0)
    assert [bool(marks[0][k // 8] >> (k % 8) & 1) for k in (0, 70, 511)] == [bool(2 * v > len(base)) for v in votes]
    apart = lambda a, b: int(np.bitwise_count(marks[a] ^ marks[b]).sum())
    assert apart(0, 1) <= near_dup.most_bits(0.8, 512, 6) < apart(0, 2)  # 800 of 1,000 shingles shared
    for n in (1_000, 1_000_000):
        keys = near_dup.keys_of(np.stack(marks), range(192), near_dup.key_bits(n))
        assert (keys[:, 0] == keys[:, 1]).any()


@pytest.mark.parametrize("small", [32, 1])
def test_near_duplicates_reach_similarity(spark, small):
    rng = random.Random(21)
    some = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(40):
        base = rng.choices(some, k=rng.randint(100, 400))
        texts.append(base)
        for _ in range(3):
            near = list(base)
            for k in rng.sample(range(len(near)), rng.randint(1, len(near) // 25)):
                near[k] = rng.choice(some)
            texts.append(near)
    rows = [(k, " ".join(t), "en", "a", 0) for k, t in enumerate(texts)] + [(None, " ".join(texts[0]), "en", "a", 0), (900, "", "en", "a", 0), (901, None, "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, df, DATA) if small == 32 else near_dup.kept(df, small=small)
    stay = {r["doc_id"] for r in out.collect()}
    assert None in stay and 900 in stay and 901 not in stay
    text = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 900}
    if small == 1:  # the pass through one task links what no join has
        named = near_dup.sketches(df.filter("doc_id < 900")).select("doc_id", "name")
        led = near_dup._led(named.withColumn("key", F.lit(1)), near_dup.sets_of(df, named), 0.8).collect()
        ids = {r["name"]: r["doc_id"] for r in named.collect()}
        assert led and all(ids[r["a"]] < ids[r["b"]] and _alike(text[ids[r["a"]]], text[ids[r["b"]]]) >= 0.8 for r in led)
        lone = sorted(set(text) - {ids[r["b"]] for r in led})
        assert all(_alike(text[a], text[b]) < 0.8 for a in lone for b in lone if a < b and b - a < 4)
    far = [(a, b) for g in range(40) for a in range(4 * g, 4 * g + 4) for b in range(a + 1, 4 * g + 4) if _alike(text[a], text[b]) < 0.8]
    assert 20 < len(far) < 220
    for g in range(40):  # no two that stay are alike, and what went is alike to something
        own = range(4 * g, 4 * g + 4)
        kept = [d for d in own if d in stay]
        assert own[0] in kept
        assert all(_alike(text[a], text[b]) < 0.8 for a in kept for b in kept if a < b)
        assert all(any(_alike(text[d], text[o]) >= 0.8 for o in own if o != d) for d in own if d not in stay)


def test_group_of_near_copies_lists_few_pairs_and_loses_no_link(spark, monkeypatch):
    """Copies of one text, most of them just under 0.8 alike: pairs that are looked at follow the rows, components are those of all pairs."""
    rng = random.Random(22)
    base, texts = [f"w{k}" for k in range(200)], []
    for k in range(180):
        near = list(base)
        for at in rng.sample(range(len(near)), 1 if k % 9 == 4 else rng.randint(3, 6)):
            near[at] = f"x{rng.randint(0, 10**9)}"
        texts.append(" ".join(near))
    seen = []
    for name in ("_within", "_close"):
        own = getattr(near_dup, name)
        monkeypatch.setattr(near_dup, name, lambda pairs, *more, own=own: seen.append(pairs.count()) or own(pairs, *more))
    monkeypatch.setattr(near_dup, "_ITEMS", 4000, raising=False)  # a family of several blocks
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    stay = {r["doc_id"] for r in near_dup.kept(df).collect()}
    assert sum(seen) <= 20 * len(texts)  # all pairs are 16,110
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if root[a] != root[b] and _alike(texts[a], texts[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert stay == set(root) and 20 < len(stay) < 170


def test_forest_joins_what_all_close_pairs_join():
    rng = np.random.default_rng(5)
    flips = rng.random((60, 512)) < rng.choice([0.02, 0.1, 0.3], (60, 1))
    bits = rng.integers(0, 2, (3, 512))[rng.integers(0, 3, 60)] ^ flips
    marks = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    close = np.bitwise_count(marks[:, None] ^ marks[None]).sum(axis=2, dtype=np.int64) <= 100
    family = np.where(np.arange(60) % 7 == 0, -1, np.arange(60))

    def joined(pairs):
        root = family.copy()
        for a, b in pairs:
            root[root == root[b]] = root[a]
        return [[*(root == r)] for r in root]

    found = near_dup._forest(marks, family, 100)
    assert all(close[a, b] for a, b in found) and len(found) < 60
    assert joined(found) == joined(np.argwhere(close))
