"""Quality classifier: a factorisation machine over hashed words, word endings, structure statistics and length.

A document is a sparse vector x. Its score is the logistic of

    w0 + sum_i w_i x_i + sum_(i<j) <v_i, v_j> x_i x_j,

where the pairwise part is half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): linear in the features.

The model is fitted in one task on at most ``sample`` labelled documents, the first in a seeded order of their ids;
that bound is a parameter and holds at any size. Scoring covers every text as a whole, where it lies. Labels,
languages, sources and ids are no features.

A null or empty text has the structure features alone and gets a score like others. Labels without quality are left
out; of several labels of one document the highest counts, and of several rows of a labelled id the fit reads one. Without labels of both kinds all scores are the share of
label 1, or 0.5 without any. Repeated rows get repeated scores.
"""

from __future__ import annotations

import io
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.llm.shared import map_texts
from waygrid.llm.text import Texts, keyed, mix, runs


@dataclass(frozen=True)
class Machine:
    sample: int = 8192  # labelled documents that the fit reads at most
    buckets: int = 1 << 15  # hashed words and endings
    rank: int = 8
    epochs: int = 12
    batch: int = 64
    rate: float = 0.08
    decay: float = 2e-5
    seed: int = 5
    threshold: float = 0.3


_KINDS = ("upper", "lower", "digit", "stop", "mark", "blank", "line", "high")


def _kind_table() -> np.ndarray:
    t = np.full(256, _KINDS.index("mark"))
    t[ord("A") : ord("Z") + 1] = _KINDS.index("upper")
    t[ord("a") : ord("z") + 1] = _KINDS.index("lower")
    t[ord("0") : ord("9") + 1] = _KINDS.index("digit")
    t[[ord(c) for c in ".,;:?'\"-"]] = _KINDS.index("stop")
    t[[0x20, 0x09]] = _KINDS.index("blank")
    t[[0x0A, 0x0D]] = _KINDS.index("line")
    t[0x80:] = _KINDS.index("high")
    return t


_KIND = _kind_table()
_ALNUM = np.isin(_KIND, [_KINDS.index(k) for k in ("upper", "lower", "digit", "high")])
#: Bins of each structure statistic; a (statistic, bin) is one feature.
_BINS = 16
_N_STATS = len(_KINDS) + 7
STATS_X = 0.35


def _share_bins(share: np.ndarray) -> np.ndarray:
    """Bins of shares from 0 to 1, finer near 0."""
    return np.clip(np.floor(np.sqrt(np.clip(share, 0, 1)) * _BINS), 0, _BINS - 1).astype(np.int64)


def _log_bins(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(x, 0) + 1)), 0, _BINS - 1).astype(np.int64)


def features(column: pa.Array, m: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and each text's first feature. Words and endings have the numbers below ``buckets``."""
    t = Texts(column)
    words, owner = t.words(lowered=True), t.owner(t.first)
    last, before = t.data[t.end - 1].astype(np.uint64), t.data[np.maximum(t.end - 2, t.start)].astype(np.uint64)
    odd = ~_ALNUM[last.astype(np.int64)]
    endings = mix(last[odd] * np.uint64(256) + before[odd] + keyed(1, 6)[0])
    mask = np.uint64(m.buckets - 1)
    key = np.concatenate([owner, owner[odd]]) * m.buckets + np.concatenate([words & mask, endings & mask]).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    of, number = key // m.buckets, key % m.buckets
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(of, value**2, t.n))
    value = value / norm[of]

    size = np.maximum(np.diff(t.offsets), 1)
    docs = np.repeat(np.arange(t.n), np.diff(t.offsets))
    kinds = np.bincount(docs * len(_KINDS) + _KIND[t.data], minlength=t.n * len(_KINDS)).reshape(t.n, -1)
    n = np.maximum(t.n_words, 1)
    distinct = np.bincount(np.unique(np.stack([owner.astype(np.uint64), words], 1), axis=0)[:, 0].astype(np.int64), minlength=t.n) if len(words) else np.zeros(t.n)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    lone = np.bincount(owner[odd & (t.end - t.start == 1)], minlength=t.n)
    caps = np.bincount(owner[(_KIND[t.data[t.start]] == 0) & (_KIND[t.data[np.maximum(t.end - 2, t.start)]] == 0)], minlength=t.n) if len(words) else np.zeros(t.n)
    bins = [
        *(_share_bins(kinds[:, k] / size) for k in range(len(_KINDS))),
        _share_bins(np.bincount(owner[odd], minlength=t.n) / n), _share_bins(distinct / n), _share_bins(np.bincount(owner[again], minlength=t.n) / n), _share_bins(lone / n), _share_bins(caps / n),
        _log_bins(size), np.clip(np.diff(t.offsets) // n, 0, _BINS - 1),
    ]
    stats = np.stack([m.buckets + s * _BINS + b for s, b in enumerate(bins)], 1)
    of = np.concatenate([of, np.repeat(np.arange(t.n), _N_STATS)])
    number = np.concatenate([number, stats.ravel()])
    value = np.concatenate([value, np.full(stats.size, STATS_X)])
    order = np.argsort(of, kind="stable")
    return number[order], value[order], np.searchsorted(of[order], np.arange(t.n + 1))


def margins(model: dict, number: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """w0 + linear part + pairwise part of each text, by the sum-of-squares identity."""
    if len(first) < 2:
        return np.zeros(0)
    vx = model["v"][number] * value[:, None]
    sums = np.add.reduceat(vx, first[:-1])
    squares = np.add.reduceat((vx**2).sum(1), first[:-1])
    return model["w0"] + np.add.reduceat(model["w"][number] * value, first[:-1]) + 0.5 * ((sums**2).sum(1) - squares)


def fit(number: np.ndarray, value: np.ndarray, first: np.ndarray, label: np.ndarray, m: Machine) -> dict:
    """AdaGrad on the logistic loss, rarer class weighed up to a quarter; a fixed order, so fits agree."""
    size = m.buckets + _N_STATS * _BINS
    rng = np.random.default_rng(m.seed)
    share = float(label.mean()) if len(label) else 0.5
    model = {"w0": float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), "w": np.zeros(size), "v": rng.normal(0, 0.02, (size, m.rank))}
    if len(label) == 0 or share in (0.0, 1.0):
        model["v"][:] = 0
        return model
    rare = max(1.0, 0.25 / min(share, 1 - share))
    weight = np.where(label == (share < 0.5), rare, 1.0)
    gw, gv, g0 = np.full(size, 1e-8), np.full((size, m.rank), 1e-8), 1e-8
    for _ in range(m.epochs):
        for part in np.array_split(rng.permutation(len(label)), -(-len(label) // m.batch)):
            lengths = first[part + 1] - first[part]
            at = np.repeat(first[part] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            num, x = number[at], value[at]
            starts = np.concatenate([[0], np.cumsum(lengths)])
            miss = (1 / (1 + np.exp(-margins(model, num, x, starts))) - label[part]) * weight[part]
            of = np.repeat(np.arange(len(part)), lengths)
            vx = model["v"][num] * x[:, None]
            sums = np.add.reduceat(vx, starts[:-1])
            used, back = np.unique(num, return_inverse=True)
            dw = np.bincount(back, miss[of] * x, len(used)) / len(part) + m.decay * model["w"][used]
            each = (miss[of] * x)[:, None] * (sums[of] - vx)
            dv = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(m.rank)], 1) / len(part) + m.decay * model["v"][used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += miss.mean() ** 2
            model["w"][used] -= m.rate * dw / np.sqrt(gw[used])
            model["v"][used] -= m.rate * dv / np.sqrt(gv[used])
            model["w0"] -= m.rate * miss.mean() / np.sqrt(g0)
    return model


def train(docs: DataFrame, labels: DataFrame, m: Machine = Machine(), *, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> dict:
    """Fits the machine on a bounded sample of labelled documents; labels has doc_id and the label."""
    ids = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("labelled")).agg(F.max(F.col(label)).cast("double").alias("label"))
    ids = ids.orderBy(F.xxhash64(F.lit(m.seed), "labelled"), "labelled").limit(m.sample)  # a proven bound for the broadcast
    rows = docs.select(F.col(doc_id).alias("labelled"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "labelled")
    # One row an id, whatever rows there are: that with the smallest digest of its text, found inside the tasks first.
    first = F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("first")
    rows = rows.groupBy("labelled").agg(F.first("label").alias("label"), first).select("labelled", "label", "first.text")

    def extract(batches):
        for batch in batches:
            for begin, end in runs(batch.column(2)):
                number, value, first = features(batch.column(2).slice(begin, end - begin), m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(number, pa.int32())), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value, pa.float32()))],
                    ["labelled", "label", "number", "value"],
                )

    def fit_all(batches):
        held = [b for b in batches if len(b)]
        if held:
            table = pa.Table.from_batches(held).sort_by("labelled").combine_chunks()
            lists = [table.column(c).combine_chunks() for c in ("number", "value")]
            lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
            first = np.concatenate([[0], np.cumsum([len(x) for x in lists[0]])])
            model = fit(lists[0].flatten().to_numpy().astype(np.int64), lists[1].flatten().to_numpy().astype(float), first, table.column("label").to_numpy(), m)
        else:
            model = fit(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), np.zeros(0), m)
        out = io.BytesIO()
        np.savez_compressed(out, w0=model["w0"], w=model["w"].astype(np.float32), v=model["v"].astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    id_type = dict(rows.dtypes)["labelled"]
    vectors = rows.mapInArrow(extract, f"labelled {id_type}, label double, number array<int>, value array<float>")
    packed = vectors.repartition(1).mapInArrow(fit_all, "model binary").first()["model"]
    with np.load(io.BytesIO(packed)) as f:
        return {"w0": float(f["w0"]), "w": f["w"].astype(float), "v": f["v"].astype(float)}


def score(docs: DataFrame, model: dict, m: Machine = Machine(), *, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (None: all) in the struct doc, then score (0 to 1) and predicted. The model is a few MB,
    fixed by buckets and rank."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch, _):
        p = 1 / (1 + np.exp(-np.clip(margins(shared.value, *features(batch.column(1), m)), -500, 500)))
        return [pa.array(p), pa.array((p >= m.threshold).astype(np.int32))]

    return map_texts(docs, compute, "score double, predicted int", keep=keep, text=text)
