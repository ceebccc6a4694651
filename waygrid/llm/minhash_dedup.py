"""Near-duplicates by MinHash: many universal hash minima, banding, verification, connected components.

Words are lower-cased in A-Z and cut at \\x20 and \\x09-\\x0D; a document's set holds its distinct shingles of five
words (with fewer words: all of them as one). Documents link where 100 * intersection >= 75 * union.

1. One pass gives each document a 128-bit fingerprint of its set and BANDS bucket keys, each of ROWS minima of
   universal hashes. Documents of one set form a class and go on as one row, so thousands of copies cost as much as one.
2. Each bucket links its classes with one pivot, of TURNS orders of pivots that the buckets take turns with: never all
   pairs. Sizes that rule a link out drop a pair; the rest are confirmed on full sets, which are rebuilt once, from one
   text of each class that shares a bucket.
3. Components of the confirmed links come from alternating large-star and small-star.
4. A pivot may miss links between the others of its bucket. So buckets that still hold several components are compared
   in pairs of blocks of at most about BLOCK classes: first signatures alone, which tell the classes that may have a
   link to another component; full sets are fetched for these only, and confirm links. Then components of the
   components. A pair of one component is not compared, as nothing can change. No link that shares a bucket is lost.

What can be lost: a link of similarity 0.75 shares no bucket with a chance of (1 - 0.75^ROWS)^BANDS, 5e-6, and one of
0.8 with 2e-8. Signatures estimate similarity with a deviation of at most 0.029 near the threshold; pairs MARGIN (five
and a half deviations, a chance of 2e-8) below it are not looked at further. They are kept as one byte a minimum: equal
minima have equal bytes, so this loses nothing. Documents of similarity 0.2 share a bucket with a chance of 1.4 %, of
0.1 with 0.05 %.

A document without words (null, empty or blank text) has no set and links with nothing. Repeated rows and null
doc_ids are members like others; the component's id is its smallest doc_id that is not null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygrid.llm.components import components, named
from waygrid.llm.shared import arrow_batches, cut, map_texts, small
from waygrid.llm.text import Texts, keyed, mix, windows

SHINGLE, PERCENT = 5, 75
ROWS, BANDS = 5, 45
HASHES = ROWS * BANDS
MARGIN = 0.16
#: Equal minima of a pair that is looked at.
LEAST_ALIKE = (PERCENT / 100 - MARGIN) * HASHES
TURNS = 4
BLOCK, BLOCK_SHINGLES, BUNDLE = 512, 1 << 21, 1024

_A, _B = keyed(HASHES, 11) | np.uint64(1), keyed(HASHES, 12)
_PER_BAND = keyed(BANDS, 14)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted in each; text d has out[first[d]:first[d + 1]]."""
    t = Texts(column)
    words = t.words(lowered=True)
    grams, at = windows(words, t.first, SHINGLE)
    owner = t.owner(t.first)[at]
    n = t.n_words
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    whole = np.zeros(len(short), np.uint64)
    for k, c in enumerate(keyed(SHINGLE, 2)[: SHINGLE - 1]):
        has = n[short] > k
        whole[has] += words[t.first[short[has]] + k] * (c | np.uint64(1))
    grams, owner = np.concatenate([grams, mix(whole + n[short].astype(np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(t.n + 1))


def _binary(rows: np.ndarray, width: int, valid: np.ndarray) -> pa.Array:
    """One binary value of ``width`` bytes a row; null where not valid."""
    data = np.ascontiguousarray(rows).tobytes()
    return pa.array([data[i * width : (i + 1) * width] if ok else None for i, ok in enumerate(valid)], pa.binary())


def fingerprints(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each set that do not depend on the order of its members."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    for k, salt in enumerate(keyed(2, 13)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ salt), dtype=np.uint64)])
        out[:, k] = sums[first[1:]] - sums[first[:-1]]
    return out


def minima(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signatures: for each set the least value of each hash a * x + b, upper half of 64 bits."""
    out = np.zeros((len(first) - 1, HASHES), np.uint32)
    has = np.flatnonzero(np.diff(first))
    if len(has):
        hashed, starts = np.empty_like(grams), first[has]
        for i in range(HASHES):
            np.multiply(grams, _A[i], out=hashed)
            np.add(hashed, _B[i], out=hashed)
            out[has, i] = np.minimum.reduceat(hashed, starts) >> np.uint64(32)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's minima."""
    out = np.zeros((len(signatures), BANDS), np.uint64)
    for k, c in enumerate(keyed(ROWS, 15)):
        out += mix(signatures[:, k::ROWS].astype(np.uint64) + c)
    return mix(out + _PER_BAND[None, :])


def row_key(doc_id: str, text: str) -> Column:
    """128 bits of a row's id and text: rows that agree in both have one key."""
    null = F.lit("-")
    given = F.concat(F.coalesce(F.concat(F.lit("+"), F.col(doc_id).cast("string")), null), F.lit(chr(0)), F.coalesce(F.concat(F.lit("+"), F.col(text).cast("string")), null))
    return F.unhex(F.md5(given))


def sketches(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row_key, n_shingles, set_id, bands) of every document; set_id and bands are null without words."""

    def compute(batch, _):
        grams, first = shingle_sets(batch.column(1))
        n = np.diff(first)
        keys = band_keys(minima(grams, first)).view(np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()), mask=pa.array(n == 0))
        return [batch.column(2), pa.array(n, pa.int64()), _binary(fingerprints(grams, first), 16, n > 0), bands]

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), row_key(doc_id, text).alias("row_key"))
    out = map_texts(rows, compute, "row_key binary, n_shingles bigint, set_id binary, bands array<bigint>", keep=["doc_id"], more=[F.col("row_key")])
    return out.select("doc.doc_id", "row_key", "n_shingles", "set_id", "bands")


def _may_link(a: str, b: str):
    """Sizes of two sets that can reach the threshold."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """Memberships of buckets that hold two classes or more, with the bucket's pivot: (band, node, n, pivot, pn).

    Few buckets hold more than one class, so bare keys are counted first, and only what is left gets pivots. The pivot
    comes first in the bucket's order of nodes. There are TURNS orders: few, so that the buckets of one group mostly
    agree in their pivots and a class has few pairs."""
    bands = classes.select(F.explode("bands").alias("band"), "node", "n")
    held = bands.groupBy("band").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select(F.col("band").alias("in_band"))
    shared = cut(bands.join(small(cut(held)), F.col("band") == F.col("in_band"), "left_semi"))
    turn = F.xxhash64(F.pmod("band", F.lit(TURNS)), "node")
    first = F.min(F.struct(turn.alias("turn"), F.col("node").alias("pivot"), F.col("n").alias("pn"))).alias("p")
    pivots = shared.groupBy("band").agg(first).select(F.col("band").alias("in_band"), "p.pivot", "p.pn")
    return shared.join(small(cut(pivots)), F.col("band") == F.col("in_band")).select("band", "node", "n", "pivot", "pn")


def _full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, *, text: str, doc_id: str) -> DataFrame:
    """(of, n, signature, members) for the classes that share a bucket, rebuilt from one text each. Sets are not
    shuffled: where rows that agree in id and text are repeated, each task builds the set once and one of them stays."""
    wanted = small(cut(classes.join(nodes, "node").select(F.col("any_row").alias("in_row"), F.col("node").alias("of"))))
    texts = docs.select(F.col(text).cast("string").alias("text"), row_key(doc_id, text).alias("row_key"))
    found = texts.join(wanted, F.col("row_key") == F.col("in_row")).select("of", "text")

    def build(batch, state):
        seen = state.setdefault("seen", set())
        fresh = np.array([not (of in seen or seen.add(of)) for of in batch.column(2).to_pylist()], bool)
        grams, first = shingle_sets(batch.column(1))
        members = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(grams.view(np.int64)), mask=pa.array(~fresh))
        return [pa.array(np.diff(first), pa.int64()), _binary(minima(grams, first).astype(np.uint8), HASHES, fresh), members]

    sets = map_texts(found, build, "n bigint, signature binary, members array<bigint>", keep=["of"], more=[F.col("of")])
    sets = cut(sets.filter("members is not null").select("doc.of", "n", "signature", "members", F.monotonically_increasing_id().alias("place")))
    again = sets.groupBy("of").agg(F.collect_list("place").alias("places")).filter("size(places) > 1")
    gone = cut(again.select(F.explode(F.expr("slice(places, 2, size(places) - 1)")).alias("gone")))
    return sets.join(small(gone), F.col("place") == F.col("gone"), "left_anti").drop("place")


def _pivot_links(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (u, v) of each bucket's classes with its pivot."""
    pairs = shared.filter(F.col("node") != F.col("pivot")).filter(_may_link("n", "pn")).select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).distinct()
    a, b = sets.select(F.col("of").alias("u"), F.col("members").alias("a")), sets.select(F.col("of").alias("v"), F.col("members").alias("b"))
    both = pairs.join(a, "u").join(b, "v").withColumn("shared", F.size(F.array_intersect("a", "b")))
    return both.filter(100 * F.col("shared") >= PERCENT * (F.size("a") + F.size("b") - F.col("shared"))).select("u", "v")


def _block_pairs(pdf: pd.DataFrame):
    """The pairs of blocks that a group holds, as places in it: (left, right), which are one array on the diagonal. A
    group is one pair of blocks of a large bucket, or a bundle of small buckets."""
    band = pdf["band"].to_numpy()
    order = np.argsort(band, kind="stable")
    mine, i, j = (pdf[c].to_numpy() for c in ("mine", "i", "j"))
    for at in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
        if i[at[0]] == j[at[0]]:
            yield at, at
        else:
            yield at[mine[at] == i[at]], at[mine[at] == j[at]]


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, sizes and numbered components of a group's rows."""
    return np.frombuffer(b"".join(pdf["signature"]), np.uint8).reshape(-1, HASHES), pdf["n"].to_numpy(), pd.factorize(pdf["root"])[0].copy()


def _fits(n: int, others: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(others, n) >= PERCENT * np.maximum(others, n)


def _may_link_across(pdf: pd.DataFrame) -> pd.DataFrame:
    """The classes of a group that may have a link to another component, by size and signature."""
    sig, n, root = _arrays(pdf)
    found = np.zeros(len(pdf), bool)
    for left, right in _block_pairs(pdf):
        if left is right and (root[left] == root[left[0]]).all():
            continue
        sig_r, n_r, root_r = sig[right], n[right], root[right]
        for k in left:
            ok = (root_r != root[k]) & _fits(n[k], n_r)
            if ok.any():
                ok &= np.count_nonzero(sig_r == sig[k], axis=1) >= LEAST_ALIKE
                found[right[ok]] = True
                found[k] |= ok.any()
    return pdf.loc[found, ["bundle", "band", "i", "j", "mine", "node", "root"]]


def _links_across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of components that a confirmed link joins. Components that are joined are not compared again, so a group
    returns fewer pairs than it has classes."""
    sig, n, root = _arrays(pdf)
    members = [m.view(np.uint64) for m in pdf["members"]]  # sorted as they were built
    name = pdf["root"].to_numpy()
    u, v = [], []
    for left, right in _block_pairs(pdf):
        for place, k in enumerate(left):
            others = right[place + 1 :] if left is right else right
            others = others[(root[others] != root[k]) & _fits(n[k], n[others])]
            alike = np.count_nonzero(sig[others] == sig[k], axis=1)
            x = members[k]
            for i in others[np.argsort(-alike, kind="stable")[: int((alike >= LEAST_ALIKE).sum())]]:
                if root[i] == root[k]:
                    continue
                y = members[i]
                common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                if 100 * common >= PERCENT * (len(x) + len(y) - common):
                    u.append(max(name[k], name[i]))
                    v.append(min(name[k], name[i]))
                    root[root == root[i]] = root[k]
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def _cross_links(shared: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of components with a confirmed link between them, from blocks of bounded numbers and bytes. Of buckets
    with the same classes one is compared. Buckets of one block are bundled, some BUNDLE memberships together, so that few
    groups go to Python."""
    arrow_batches(shared.sparkSession)
    placed = cut(shared.join(roots, F.col("node") == F.col("in_root"), "left").select("band", "node", "n", F.coalesce("root", "node").alias("root")))
    same = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"same{k}") for k in range(2)]
    mixed = placed.groupBy("band").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("total"), F.min("root").alias("lo"), F.max("root").alias("hi"), *same).filter("lo <> hi")
    mixed = mixed.groupBy("held", "total", "same0", "same1").agg(F.min("band").alias("band"))
    blocks = F.greatest(F.ceil(F.col("held") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    mixed = cut(mixed.select(F.col("band").alias("in_band"), blocks.alias("blocks"), "held", "total"))
    few = mixed.filter("blocks = 1").agg(F.sum("held"), F.sum("total")).first()
    bundles = max(1, (few[0] or 0) // BUNDLE, (few[1] or 0) // BLOCK_SHINGLES)
    members = placed.join(small(mixed.select("in_band", "blocks")), F.col("band") == F.col("in_band")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j")))).alias("pair")
    bundle = F.when(F.col("blocks") > 1, F.col("band")).otherwise(F.pmod("band", F.lit(bundles))).alias("bundle")
    signed = members.join(sets.select("of", "signature"), F.col("node") == F.col("of")).select(bundle, "band", "mine", "node", "n", "root", "signature", pair)
    signed = signed.select("bundle", "band", "pair.i", "pair.j", "mine", "node", "n", "root", "signature")
    kind = dict(signed.dtypes)
    found = ", ".join(f"{c} {kind[c]}" for c in ("bundle", "band", "i", "j", "mine", "node", "root"))
    alike = cut(signed.groupBy("bundle", "i", "j").applyInPandas(_may_link_across, found))
    full = alike.join(sets, F.col("node") == F.col("of")).select("bundle", "band", "i", "j", "mine", "node", "n", "root", "signature", "members")
    return full.groupBy("bundle", "i", "j").applyInPandas(_links_across, "u bigint, v bigint").distinct()


def _grouped(docs: DataFrame, *, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Every document's (doc_id, row_key, n_shingles, set_id), and for the sets that several documents have or that
    are linked (of_set, component_id, kept_row): the row with the component's smallest doc_id, then smallest key."""
    base = cut(sketches(docs, text=text, doc_id=doc_id))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("best")
    classes = base.filter("set_id is not null").groupBy("set_id").agg(first, F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.select("*", F.col("best.row_key").alias("any_row"), F.monotonically_increasing_id().alias("node")))
    shared = cut(_shared_buckets(classes))
    sets = _full_sets(shared.select("node").distinct(), classes, docs, text=text, doc_id=doc_id)
    links = cut(_pivot_links(shared, sets))
    roots = components(links).select(F.col("node").alias("in_root"), "root")
    across = cut(_cross_links(shared, sets, roots))
    nodes = classes.join(roots, F.col("node") == F.col("in_root"), "left").select("node", "set_id", "copies", "best", "root")
    if across.take(1):
        joined = components(across).select(F.col("node").alias("was"), F.col("root").alias("now"))
        nodes = nodes.join(joined, F.coalesce("root", "node") == F.col("was"), "left").select("node", "set_id", "copies", "best", F.coalesce("now", "root").alias("root"))
    nodes = nodes.select(F.col("set_id").alias("node"), "copies", "best", "root")
    lone = nodes.filter("root is null and copies > 1").select("node", "best")
    labels = lone.union(named(nodes.filter("root is not null").select("node", "root", "best"), "best").select("node", "best"))
    return base, cut(labels.select(F.col("node").alias("of_set"), F.col("best.doc_id").alias("component_id"), F.col("best.row_key").alias("kept_row")))


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept."""
    base, labels = _grouped(docs, text=text, doc_id=doc_id)
    out = base.select("doc_id", "n_shingles", "set_id").join(labels, F.col("set_id") == F.col("of_set"), "left")
    own = F.when(F.col("of_set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: one row of each component, with the smallest doc_id (null comes last), and of rows
    that share it the one whose text has the smallest digest. Rows are told apart by id and text together, so
    one id with two texts loses neither unless the texts are alike. Rows without words stay."""
    base, labels = _grouped(docs, text=text, doc_id=doc_id)
    marked = base.filter("set_id is not null").join(labels, F.col("set_id") == F.col("of_set"))
    counted = cut(marked.groupBy("row_key", "kept_row").agg(F.count(F.lit(1)).alias("rows")))
    gone = small(cut(counted.filter("row_key <> kept_row").select(F.col("row_key").alias("in_row"))))
    again = counted.filter("row_key = kept_row and rows > 1").select(F.col("row_key").alias("in_row"))
    key = row_key(doc_id, text)
    kept = docs.join(gone, key == gone["in_row"], "left_anti")
    if not again.take(1):
        return kept
    again = small(cut(again))
    return kept.join(again, key == again["in_row"], "left_anti").union(kept.join(again, key == again["in_row"], "left_semi").dropDuplicates([doc_id, text]))
