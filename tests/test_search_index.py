"""Place search against all pairs of queries and names."""

import random

from pyspark.sql import functions as F

from waygrid.functions.strings import edit_distance
from waygrid.operators import search


def made_up(rng, n):
    syllables = ["ra", "mar", "vi", "ha", "na", "gar", "pur", "ta", "lo", "shi", "e", "kon", "road", "st"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    return sorted({" ".join([word() for _ in range(rng.randint(1, 4))] + ([str(rng.randint(1, 30))] if rng.random() < 0.3 else [])) for _ in range(n)})


def spoilt(rng, name):
    s = list(name)
    for _ in range(rng.randint(0, 2)):
        i = rng.randrange(len(s))
        kind = rng.randrange(4)
        if kind == 0:
            del s[i]
        elif kind == 1:
            s.insert(i, rng.choice("abcr"))
        elif kind == 2 and i:
            s[i - 1], s[i] = s[i], s[i - 1]
        else:
            s[i] = rng.choice("axr")
        if not s:
            break
    return "".join(s)


def digits(s):
    import re

    return ",".join(re.findall("[0-9]+", s))


def test_fuzzy_hits_are_those_of_all_pairs(spark):
    rng = random.Random(11)
    names = made_up(rng, 1200)
    queries = [(i, spoilt(rng, rng.choice([n, rng.choice(n.split())]))) for i, n in enumerate(rng.choices(names, k=60))] + [(900, ""), (901, "a"), (902, "x" * 30)]
    want = {}
    for i, q in queries:
        most = 1 if len(q) <= 4 else 2
        for n in names if q else ():
            if digits(q) != digits(n):
                continue
            best = min((d for part in {n, *n.split()} if abs(len(part) - len(q)) <= most for d in [edit_distance(q, part, 2)] if d <= min(most, max(1, int(max(len(q), len(part)) * 0.25)), 2)), default=None)
            if best is not None:
                want[i, n] = best
    index = search.build_index(spark.createDataFrame([(k, n) for k, n in enumerate(names)], "place_id long, name string"), F.col("name"))
    asked = spark.createDataFrame(queries, "query_id long, q string")
    got = {(r["query_id"], r["norm"]): r["edits"] for r in search.fuzzy_matches(index, asked).collect()}
    assert got == want and len(want) > 200 and max(len(n) for _, n in want) > 25
    posted = search._posted(index.select(F.explode("toks").alias("part")).distinct().withColumn("name_digits", F.lit("")))
    most = posted.groupBy("key").count().agg(F.max("count")).first()[0]
    print("largest list of", posted.select("part").distinct().count(), "parts:", most)


def test_strong_hits_are_those_of_all_pairs(spark):
    rng = random.Random(12)
    names = made_up(rng, 800)
    queries = [(i, n[: rng.randint(1, len(n))].strip()) for i, n in enumerate(rng.choices(names, k=60))] + [(100 + i, " ".join(reversed([t[:3] for t in n.split()]))) for i, n in enumerate(rng.choices(names, k=30))]
    want = set()
    for i, q in queries:
        for n in names:
            toks, asks = n.split(), q.split()
            if q and (n.startswith(q) or any(t.startswith(q) for t in toks) or all(any(t.startswith(x) for t in toks) for x in asks)):
                want.add((i, n))
    index = search.build_index(spark.createDataFrame([(k, n) for k, n in enumerate(names)], "place_id long, name string"), F.col("name"))
    rows = search.strong_matches(index, spark.createDataFrame(queries, "query_id long, q string")).select("query_id", "norm").collect()
    assert {(r["query_id"], r["norm"]) for r in rows} == want and len(rows) == len(want) > 500
