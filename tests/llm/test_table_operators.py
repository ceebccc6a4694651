"""Operators that relate rows to each other, against brute force on small tables and odd cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygrid.llm import compaction, components, embedding_join, minhash_dedup, mixing
from waygrid.llm.queries import QUERIES

WORDS = re.compile("[^\x20\x09-\x0d]+").findall


def union_find(n, links):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def shingles(text):
    w = WORDS("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_duplicates(rows):
    rows = sorted(rows)
    sets, held, links = [shingles(t) for _, t in rows], defaultdict(list), []
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in held[x]:
                common[j] += 1
            held[x].append(i)
        links += [(i, j) for j, n in common.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
    roots = union_find(len(rows), links)
    return {rows[i][0]: (len(sets[i]), rows[roots[i]][0]) for i in range(len(rows))}


def test_near_duplicates(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_duplicates(rows)
    for r in QUERIES["op8_minhash"](spark, sf_dir).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_in_a_hot_group(spark, monkeypatch):
    """Hundreds of texts whose pairs lie on both sides of the threshold, in blocks of few classes."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 40)
    rng = np.random.default_rng(2)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(300):
        words = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            words[k] = f"x{rng.integers(0, 50)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"q{i}w{k}" for k in range(20))) for i in range(30)] + [(2000, "few words"), (2001, "Few  WORDS"), (2002, None), (2003, " "), (2004, "")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_duplicates([(i, t) for i, t in rows])


def test_keep_one_with_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, "other words of a row without id " * 3), (5, "unlike " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = minhash_dedup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 1, 3, 4, 5]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_loses_no_unlike_text(spark):
    """One id with two texts, null ids and clashing column names: rows are told apart, not ids."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, one), (7, one), (7, two), (None, one), (None, three), (None, three + " z"), (8, three), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("gone", "in_row", "row_key", "set_id", "turn"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = minhash_dedup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, one), (7, two), (8, three), (9, ""), (9, None)], key=str)


def test_near_duplicates_recall(spark, sf_dir):
    """Every document of sf0.01 against brute force: links found, out of all there are."""
    folder = sf_dir.replace("0.001", "0.01")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute_duplicates(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op8_minhash"](spark, folder).collect()}
    linked = [i for i, (_, c) in want.items() if c != i]
    print("recall", sum(got[i] == want[i] for i in linked) / len(linked), "of", len(linked))
    assert got == want


def shuffled_bytes(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("sent", [True, False])
def test_near_duplicates_shuffle_little(spark, sf_dir, monkeypatch, sent):
    """What is shuffled, over the bytes of the texts, with small tables sent along and without that hint."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").cache()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    if not sent:
        monkeypatch.setattr(minhash_dedup, "small", lambda df: df)
    before = shuffled_bytes(spark)
    minhash_dedup.near_duplicates(docs).write.format("noop").mode("overwrite").save()
    moved = (shuffled_bytes(spark) - before) / size
    print("shuffled, over the texts:", moved)
    assert moved < 1.3


@pytest.mark.parametrize("sent", [True, False])
def test_near_duplicates_of_repeated_rows(spark, monkeypatch, sent):
    """Rows that agree in id and text lie in several tasks, and their set is one of each pair that is compared."""
    if not sent:
        monkeypatch.setattr(minhash_dedup, "small", lambda df: df)
    texts = [" ".join(f"t{t}w{k}" for k in range(60)) for t in range(6)]
    rows = [(t, texts[t]) for t in range(6)] * 9 + [(10 + t, texts[t] + " end") for t in range(6)] * 5 + [(20, texts[0][:200])] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = brute_duplicates(list({i: t for i, t in rows}.items()))
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    classes = docs.dropDuplicates().select(minhash_dedup.row_key("doc_id", "text").alias("any_row"), F.col("doc_id").alias("node"))
    sets = minhash_dedup._full_sets(classes.select("node"), classes, docs, text="text", doc_id="doc_id")
    assert sorted(r["of"] for r in sets.collect()) == sorted(want)


def test_components_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(500, 500 + i) for i in range(1, 60)]
    df = spark.createDataFrame(links, "u long, v long")
    sent = {r["node"]: r["root"] for r in components.components(df).collect()}
    monkeypatch.setattr(components, "SENT_ROWS", 0)
    assert sent == {r["node"]: r["root"] for r in components.components(df).collect()}


def test_components(spark):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 360)] + [(400, 400 + i) for i in range(1, 50)]
    roots = union_find(500, links)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: roots[i] for a, b in links if a != b for i in (a, b)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_vectors(rows, cosine=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    links = [(a, b) for a in ok for b in ok if a > b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    roots = union_find(len(rows), links)
    return {rows[i][0]: (n[i], rows[roots[i]][0]) for i in range(len(rows))}


def test_near_vectors(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 32)
    monkeypatch.setattr(embedding_join, "STRIP", 10)
    monkeypatch.setattr(embedding_join, "CELLS_ROOT", 2)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = [(i, (centre[i % 6] + rng.normal(size=16) * (0.02 if i % 2 else 0.35)).tolist()) for i in range(240)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [1.0, None]), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (407, [2 * x for x in rows[0][1]])]
    got = embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cid", F.lit("clash"))).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_near_vectors_of_extreme_size(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [1.0, 0.2]), (3, [1e200, 1e200]), (4, [2e200, 2e200]), (5, [1.0, 1.0]), (6, [5e-324, 5e-324]), (7, [1.7e308, -1.7e308])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (4, 1), 2: (0, 2), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (4, 1), 7: (0, 7)}


def test_near_vectors_query(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op3_embedding_join"](spark, sf_dir).collect()} == brute_vectors(rows)


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("block", [1, 32])
def test_mixing(spark, sf_dir, block):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix_documents(docs, mixing.Mix(block=block), keep=["doc_id", "source"]).select("doc.*", "size", "source_size", "target", "taken", "quota").collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + r["target"])
    assert all(abs(taken[s] - want[s]) <= 3 * block + 1 for s in sizes)
    again = mixing.mix_documents(docs.repartition(7), mixing.Mix(block=block), keep=["doc_id"]).select("doc.doc_id", "taken").collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted(map(tuple, again))


def test_sainte_lague(spark):
    """Seats of each shard against one block at a time by the highest quotient."""
    sizes = spark.createDataFrame([("a", 530), ("b", 240), ("c", 130), ("d", 99), (None, 1), ("z", 0)], "source string, source_size long")
    m = mixing.Mix(block=10, shards=7)
    targets = mixing.source_targets(sizes, m)
    rows = mixing.apportion(targets, m).collect()
    total, want = 100, {r["source"]: [] for r in rows}
    seats = dict.fromkeys(want, 0)
    for h in range(m.shards):
        while sum(seats.values()) < (total * (h + 1)) // m.shards:
            best = max((r for r in rows), key=lambda r: (r["target"] / (2 * seats[r["source"]] + 1), -r["pos"]))
            seats[best["source"]] += 1
        for s in want:
            want[s].append(seats[s])
    assert {r["source"]: r["seats"] for r in rows} == want


def test_mixing_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (3, "", "t"), (None, "x " * 500, None), (5, "y " * 5000, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    per = mixing.mix_documents(docs).agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == per
    assert mixing.mix_documents(docs.limit(0)).count() == 0 and mixing.mixed_texts(docs.limit(0)).count() == 0


def test_compaction(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store", compaction.Tiers(target_bytes=400_000, fanout=4))
    assert store.manifest().count() == 0
    for k in range(6):
        store.append(docs.filter(F.col("doc_id") % 6 == k).coalesce(1))
    before = store.version()
    assert before == 6 and store.manifest().count() == 6
    newest = store.compact()
    assert newest > before and store.manifest().count() < 6
    for v in (before, newest):
        assert store.read(v).exceptAll(docs).count() == 0 and store.read(v).count() == docs.count()
    assert store.manifest().agg(F.sum("rows")).first()[0] == docs.count()
    with pytest.raises(Exception):
        store._commit(store.manifest(), before)  # a version is taken once
    assert store.vacuum() == 0 and store.read(before).count() == docs.count()  # all files are young
    kept = compaction.ShardStore(spark, store.root, compaction.Tiers(grace_s=0))
    assert kept.vacuum() > 0 and store.read().count() == docs.count()


def test_compaction_merges_tiers(spark, tmp_path):
    """Which shards merge: four or more of a tier, the smallest tier first, never those above half the target."""
    rng = random.Random(3)
    sizes = [200, 200, 200, 3000, 3000, 90_000]
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store", compaction.Tiers(target_bytes=100_000, fanout=4))
    letters = "".join(chr(c) for c in range(33, 120))
    for i, n in enumerate(sizes):
        store.append(spark.createDataFrame([(i, "".join(rng.choices(letters, k=n)))], "doc_id long, text string").coalesce(1))
    assert store.compact() == 6  # three, two and one shard in a tier: nothing to merge
    store.append(spark.createDataFrame([(6, "".join(rng.choices(letters, k=200)))], "doc_id long, text string").coalesce(1))
    assert store.compact() == 8
    rows = {(r["rows"], r["level"]) for r in store.manifest().collect()}
    assert rows == {(4, 1), (1, 0)} and store.manifest().count() == 4
    assert store.read().count() == 7


def test_compaction_keeps_columns(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store", compaction.Tiers(fanout=2, grace_s=0))
    store.append(spark.createDataFrame([(1, "x")], "a long, b string"))
    store.append(spark.createDataFrame([(2, "y", 7)], "a long, b string, c int"))
    store.append(spark.createDataFrame([(3, 8)], "a long, c int"))
    want = [(1, "x", None), (2, "y", 7), (3, None, 8)]
    assert sorted(map(tuple, store.read().collect())) == want
    store.compact()
    store.vacuum()
    assert sorted(map(tuple, store.read().collect())) == want
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("z",)], "a string"))


def test_vacuum_leaves_an_append_in_flight(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(rows)
    written = store._write(rows, 0, 2)  # another writer, before its commit
    store.vacuum()
    store._commit(store.manifest(1).unionByName(written), 1)
    assert store.read().count() == 2


def test_compaction_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 100000)], "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = compaction.compacted(rows, f"file://{tmp_path}/a")
    assert got.select("doc.*").exceptAll(rows).count() == 0 and got.count() == 4
    assert compaction.compacted(rows.limit(0), f"file://{tmp_path}/b").count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = spark.createDataFrame(stage(spark, held, sf_dir).collect(), docs.schema)
        assert held.columns == columns and held.count() > 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, held, sf_dir)
    assert last.count() == held.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == last.count()
