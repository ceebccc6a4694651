"""What an audit of the operators found, each with a test of its own."""

import time
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waygrid.llm import compaction, license_scan, mixing, quality_classifier


def test_what_the_mix_takes_stands_in_the_text(spark):
    """Line breaks and blanks stay: each row of the mix is made of stretches of its document's text, in order."""
    rng = np.random.default_rng(5)
    gaps = [" ", "\n", "\n\n", "  ", "\t", " \n * "]
    texts = {i: "".join(f"d{i}w{k}" + str(rng.choice(gaps)) for k in range(int(rng.integers(20, 400)))) for i in range(60)}
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in texts.items()], "doc_id long, text string, source string")
    rows, block = mixing.mixed_texts(docs).collect(), 32
    broken = 0
    for r in rows:
        rest, at, stretches = r["text"], 0, 0
        while rest:  # the longest stretch of the text that the rest starts with
            n = next(n for n in range(len(rest), 0, -1) if texts[r["doc_id"]].find(rest[:n], at) >= 0)
            at = texts[r["doc_id"]].find(rest[:n], at) + n
            rest, stretches = rest[n:], stretches + 1
        assert stretches <= len(texts[r["doc_id"]].split()) / block + 2
        broken += r["text"] != texts[r["doc_id"]] and "\n" in r["text"]
    assert broken > 10
    taken = mixing.mix_documents(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(r["text"].split()) for r in rows) == taken


def test_small_sources_come_near_their_targets(spark):
    """Sources of 33, 40 and 5 words beside a large one."""
    sizes = {"a": 33, "b": 40, "c": 5, "d": 4000}
    rows = [(f"{s}{k}", " ".join(f"{s}{k}x{i}" for i in range(min(50, n - k))), s) for s, n in sizes.items() for k in range(0, n, 50)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["doc"]["source"]] += r["taken"]
        target[r["doc"]["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 2 for s in sizes), (dict(taken), target)


def test_rows_of_one_id_and_size_are_spread(spark):
    docs = spark.range(4000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("one two "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    places = [r["place"] for r in mixing.mix_documents(docs, keep=["doc_id"]).collect()]
    assert sorted(places) == list(range(0, 12000, 3))


def test_vacuum_keeps_versions_that_can_be_read(spark, tmp_path):
    """A reader that opened the newest version before a compaction goes on reading; manifests go with their versions."""
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store", compaction.Tiers(fanout=2, grace_s=4))
    for k in range(4):
        store.append(spark.createDataFrame([(k, "x" * 50)], "doc_id long, text string").coalesce(1))
    time.sleep(5)
    reader = store.read(store.version())
    opened = store.version()
    store.compact()
    store.vacuum()
    assert sorted(r["doc_id"] for r in reader.collect()) == [0, 1, 2, 3]
    assert store.read(opened).count() == 4
    manifests = lambda: len([f for f in (tmp_path / "store/manifests").iterdir() if f.is_dir()])
    readable = manifests()
    time.sleep(5)
    assert store.vacuum() > 0 and store.read().count() == 4
    assert manifests() == 1 < readable and [v for v, _, _ in store._versions()] == [store.version()]
    with pytest.raises(Exception):
        store.read(opened).count()


def test_the_fit_reads_one_row_of_an_id(spark):
    """Thousands of rows of one labelled id are one row for the fit, whatever their order."""
    docs = spark.createDataFrame([(i, f"text number {i} " * 5) for i in range(12)] + [(3, f"another {k} text") for k in range(2000)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 0), (5, None)], "doc_id long, quality int")
    machine = quality_classifier.Machine(sample=10, epochs=2)
    models = [quality_classifier.train(d, labels, machine) for d in (docs, docs.repartition(5))]
    assert all(np.array_equal(models[0][k], models[1][k]) for k in ("w", "v")) and models[0]["w0"] == models[1]["w0"]
    ids = labels.select("doc_id").distinct()
    one = docs.join(ids, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "x.text")
    assert np.array_equal(quality_classifier.train(one, labels, machine)["w"], models[0]["w"])


SIDE_BY_SIDE = [("licence licence", "license license"), ("Copyright-holder, copyright holder!", "copyright owner copyright owner"), ("whilst  whilst wilful WILFUL", "while while willful willful"), ("sub license sub-licence", "sublicense sublicense"), ("relicence", "relicence")]


def test_spellings_side_by_side(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SIDE_BY_SIDE)], "doc_id long, text string")
    got = rows.orderBy("doc_id").select(license_scan.canonical(F.col("text")).alias("c")).collect()
    assert [r["c"] for r in got] == [c for _, c in SIDE_BY_SIDE]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, (t, _) in enumerate(SIDE_BY_SIDE)) + ") AS t(doc_id, text)")
    twin = {i: d for i, d, *_ in con.sql(license_scan.oracle_sql()).fetchall()}
    assert twin == {r["doc_id"]: r["d"] for r in rows.select("doc_id", license_scan.digest(F.col("text")).alias("d")).collect()}


def test_license_scan_keeps_odd_column_names(spark):
    docs = spark.createDataFrame([(1, "x", "MIT License and more")], "doc_id long, `a.b` string, text string")
    out = license_scan.scan_licenses(docs, license_scan.known_digests(spark), keep=["doc_id", "a.b"])
    assert out.select("doc.`a.b`").first()[0] == "x"
