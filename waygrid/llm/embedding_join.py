"""Embedding near-duplicates as an exact metric range join.

On unit vectors cosine >= c is Euclidean distance <= r with r^2 = 2 - 2c. Pivots partition the vectors: each lives in
the cell of its nearest pivot. A vector is also sent, as a guest, to every other cell that may hold a partner. For
pivots p (home) and q, a vector v can have a partner in q's cell only if

* d(v, q) - d(v, p) <= 2 r (triangle inequality, twice),
* its distance from the bisector of p and q is at most r, and
* d(v, q) <= radius of q's cell + r (triangle inequality).

So every cell, joined by itself, finds all partners of those who live in it, and no pair is found twice from one
side. Cells are compared in blocks of at most BLOCK residents and BLOCK residents or guests, each a task's group of
its own, so a hot cell is many small groups. A block returns counts and a spanning forest of its links, never pairs.

Equal vectors form a class and go on as one row. Vectors that are null, zero, empty or hold null or non-finite
components link with nothing; so do vectors of different lengths with one another. Repeated rows are vectors of
their own. component_id is the smallest vec_id reachable that is not null.

In many dimensions the bounds exclude less the more alike all distances are: work is then a share of all block pairs,
still in matrix products of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.llm.components import components, named
from waygrid.llm.shared import arrow_batches, cut, small

COSINE = 0.95
#: Vectors of a block, and rows of it that a product takes at once.
BLOCK, STRIP = 8192, 512
#: Cells are as many as the root of the number of vectors over this: pivots and their sample grow slower than the data,
#: and both the vectors of a cell and the cells of a vector grow evenly.
CELLS_ROOT = 32


def n_cells(n: int) -> int:
    return max(1, math.isqrt(n) // CELLS_ROOT)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is divided by its largest component first: squares of very large or small ones are no numbers."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pivots(classes: DataFrame, cells: int) -> np.ndarray:
    """Unit vectors far from one another, out of a seeded sample of at most 8 a cell."""
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(8 * cells).select("x").collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["x"]), []).append(r["x"])
    if not by_length:
        return np.zeros((0, 1))
    x = _unit(np.array(max(by_length.values(), key=len), float))
    chosen = [0]
    far = 2 - 2 * x @ x[0]
    while len(chosen) < min(cells, len(x)) and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 2 - 2 * x @ x[chosen[-1]])
    return x[chosen]


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have the pivots' width (others get a zero row)."""
    lists = column.to_pylist()
    fits = np.array([len(v) == width for v in lists], bool)
    x = np.zeros((len(lists), width))
    if fits.any():
        x[fits] = _unit(np.array([v for v, f in zip(lists, fits) if f], float))
    return x, fits


def _homes(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds home, the nearest pivot (-1 - width for vectors of another width), and far, the distance from it."""
    width = pivots.shape[1]

    def run(batches):
        for batch in filter(len, batches):
            x, fits = _matrix(batch.column(1), width)
            d = np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))
            home = np.where(fits, d.argmin(1), [-1 - len(v) for v in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home, pa.int32()), pa.array(np.where(fits, d.min(1), 2.0))], ["cid", "home", "far"])

    return classes.select("cid", "x").mapInArrow(run, "cid binary, home int, far double")


def _dealt(classes: DataFrame, pivots: np.ndarray, radius: dict[int, float], r: float) -> DataFrame:
    """(cid, cell, guest): each vector in its home and in every cell that the bounds do not exclude."""
    width, slack = pivots.shape[1], 1e-9
    radii = np.array([radius.get(i, -1.0) for i in range(len(pivots))])
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-12))

    def run(batches):
        for batch in filter(len, batches):
            lists = batch.column(1)
            x, fits = _matrix(lists, width)
            d2 = np.maximum(2 - 2 * x @ pivots.T, 0)
            d = np.sqrt(d2)
            home = d.argmin(1)
            own, own2 = d[np.arange(len(d)), home][:, None], d2[np.arange(len(d)), home][:, None]
            near = (d - own <= 2 * r + slack) & ((d2 - own2) / (2 * between[home]) <= r + slack) & (d <= radii + r + slack) & (radii >= 0) & fits[:, None]
            near[np.arange(len(d)), home] = fits
            row, cell = np.nonzero(near)
            lone = np.flatnonzero(~fits)
            cells = np.concatenate([cell, [-1 - len(lists[int(i)]) for i in lone]])
            rows = np.concatenate([row, lone]).astype(np.int64)
            guest = np.concatenate([cell != home[row], np.zeros(len(lone), bool)])
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), lists.take(taken), batch.column(2).take(taken), pa.array(cells, pa.int32()), pa.array(guest)], ["cid", "x", "held", "cell", "guest"])

    return classes.select("cid", "x", "held").mapInArrow(run, "cid binary, x array<double>, held bigint, cell int, guest boolean")


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what a block's links connect: at most rows + columns of them."""
    edges, open_rows = [], linked.any(1)
    open_cols = linked.any(0)
    while open_rows.any():
        seed = int(open_rows.argmax())
        open_rows[seed] = False
        rows = [seed]
        while rows:
            cols = []
            for i in rows:
                found = np.flatnonzero(linked[i] & open_cols)
                open_cols[found] = False
                edges += [(i, int(c)) for c in found]
                cols += found.tolist()
            rows = []
            for c in cols:
                found = np.flatnonzero(linked[:, c] & open_rows)
                open_rows[found] = False
                edges += [(int(i), c) for i in found]
                rows += found.tolist()
    return edges


def _compare(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        left = pdf[~pdf["guest"] & (pdf["part"] == i) & pdf["asks"]]
        right = pdf[(pdf["part"] == j) & ~pdf["asks"]]
        empty = pd.DataFrame({"u": [], "v": [], "links": []})
        if left.empty or right.empty:
            return empty
        unit = [_unit(np.array(f["x"].tolist(), float)) for f in (left, right)]
        linked = np.concatenate([unit[0][k : k + STRIP] @ unit[1].T >= cosine for k in range(0, len(left), STRIP)])
        ids = [f["cid"].to_numpy() for f in (left, right)]
        place = {c: k for k, c in enumerate(ids[1])}
        for k, c in enumerate(ids[0]):
            if c in place:
                linked[k, place[c]] = False
        held = right["held"].to_numpy()
        links = np.concatenate([linked[k : k + STRIP] @ held for k in range(0, len(left), STRIP)])  # a whole block as numbers would be 8 times as large
        has = np.flatnonzero(links)
        counts = pd.DataFrame({"u": ids[0][has], "v": None, "links": links[has]})
        edges = _forest(linked)
        return pd.concat([counts, pd.DataFrame({"u": [ids[0][a] for a, _ in edges], "v": [ids[1][b] for _, b in edges], "links": 0})]) if edges else counts if len(counts) else empty

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links (other vectors linked directly), component_id and kept."""
    arrow_batches(vectors.sparkSession)
    r = math.sqrt(max(0.0, 2 - 2 * cosine))
    x = F.col("x")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    rows = rows.withColumn("cid", F.when(F.coalesce(finite, F.lit(False)), F.unhex(F.md5(F.array_join(F.transform("x", lambda v: (v + F.lit(0.0)).cast("string")), ",")))))
    classes = cut(rows.filter("cid is not null").groupBy("cid").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("held"), F.min("vec_id").alias("any_id")))
    pivots = _pivots(classes, n_cells(classes.count()))
    radius = {q["home"]: q["radius"] for q in _homes(classes, pivots).filter("home >= 0").groupBy("home").agg(F.max("far").alias("radius")).collect()}
    dealt = _dealt(classes, pivots, radius, r)
    sizes = dealt.groupBy("cell").agg(F.count_if(~F.col("guest")).alias("live"), F.count(F.lit(1)).alias("all"))
    sizes = sizes.filter("live > 0").select(F.col("cell").alias("of_cell"), F.struct(F.ceil(F.col("live") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("cols")).alias("b"))
    placed = dealt.join(small(cut(sizes)), F.col("cell") == F.col("of_cell"))
    row_part, col_part = F.pmod(F.xxhash64("cid"), F.col("b.rows")).cast("int"), F.pmod(F.xxhash64("cid"), F.col("b.cols")).cast("int")
    asking = placed.filter("not guest").withColumn("i", row_part).withColumn("part", F.col("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b.cols") - 1))).withColumn("asks", F.lit(True))
    asked = placed.withColumn("j", col_part).withColumn("part", F.col("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b.rows") - 1))).withColumn("asks", F.lit(False))
    cols = ["cid", F.col("x").cast("array<float>").alias("x") if dict(vectors.dtypes)[embedding] == "array<float>" else "x", "held", "guest", "cell", "i", "j", "part", "asks"]
    blocks = asking.select(*cols).union(asked.select(*cols))
    found = cut(blocks.groupBy("cell", "i", "j").applyInPandas(_compare(cosine), "u binary, v binary, links bigint"))
    counts = found.groupBy(F.col("u").alias("c")).agg(F.sum("links").alias("others"))
    roots = components(found.filter("v is not null").select("u", "v"))
    linked = classes.select("cid", "any_id").join(roots, F.col("cid") == F.col("node")).select("node", "root", "any_id")
    names = named(linked, "any_id").select(F.col("node").alias("linked"), F.col("any_id").alias("component_id"))
    labels = classes.select("cid", "held", "any_id").join(names, F.col("cid") == F.col("linked"), "left").join(counts, F.col("cid") == F.col("c"), "left")
    labels = labels.withColumn("component_id", F.when(F.col("linked").isNull(), F.col("any_id")).otherwise(F.col("component_id")))
    labels = cut(labels.select(F.col("cid").alias("of"), (F.coalesce("others", F.lit(0)) + F.col("held") - 1).alias("n_links"), "component_id"))
    out = rows.select("vec_id", "cid").join(labels, F.col("cid") == F.col("of"), "left")
    own = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
