"""Alignment of two tokenizers' tokens by lockstep vectorised merging.

Each text is encoded by A (byte-level BPE, over a space and the text) and by B (a SentencePiece model, which adds that
space). Byte offsets where tokens of both end cut them into groups; an A and a B token that overlap in bytes are a link.

1. One state vector holds, for all lanes of a run of texts at once, the current A and B token. Each step emits a link for
   every lane, and a cut where both tokens end at one byte; the token that ends first is left behind (at a cut, both), and
   lanes that are through are compacted away. A lane is a text, or a stretch of a long one: a text is split behind some
   LANE_BYTES, before a blank, where both A and B have a token's end, so that a long text does not hold up a run.
2. Links of one id pair are summed over the corpus, and each B id's highest sum marks its best pairs. Each task sums
   its own links first.
3. The most frequent pairs, at most SENT_PAIRS by a threshold taken from a histogram of their counts, are sent to
   all tasks, which look up their links. Links of the other pairs are joined to their counts, summed by text first.

The driver sees the histogram and the frequent pairs, both of bounded size. Texts that are null or empty, or whose
joined tokens of A or B are other bytes than a space and the text (one that holds the marker U+2581, for instance),
have no tokens: zeros and ''. Rows are told apart by a number of their own, so repeated rows and null ids stay rows
of their own; an empty table gives an empty result.

A's ids come from a fast encoder made of A's own file where a text's characters are ones that both encoders split alike
(below U+0240, in runs of bounded length); other texts go through A's library itself.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waygrid.llm.sentencepiece_codec import MARK, Codec
from waygrid.llm.shared import arrow_batches, cut, map_texts, whole_row
from waygrid.llm.text import runs

LANE_BYTES = 2048
SENT_PAIRS = 400_000
#: Links that a task sums before it passes the sums on.
TASK_LINKS = 4_000_000
#: The fast encoder is trusted with bytes below ODD_LEAD, the first byte of U+0240 and beyond, and with runs of blanks or of
#: other bytes that are shorter than LONG_RUN.
ODD_LEAD, LONG_RUN = 0xC9, 400
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def unusual(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts of a run the fast encoder is not trusted with."""
    blank = _BLANK[data]
    marked = np.zeros(len(data) + 1, bool)
    marked[1:-1] = blank[1:] != blank[:-1]
    marked[offsets] = True
    edges = np.flatnonzero(marked)
    long = edges[:-1][np.diff(edges) >= LONG_RUN]
    at = np.concatenate([np.flatnonzero(data >= ODD_LEAD), long])
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, at, "right") - 1] = True
    return out


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one character: the printable ones of Latin-1 as themselves, the others,
    in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class SideA:
    """A byte-level BPE tokenizer file: ids and each id's bytes."""

    def __init__(self, file: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        import tokenizers

        self.library = tokenizers.Tokenizer.from_str(file)
        self.library.encode_special_tokens = True
        of = byte_of_char()
        spec = json.loads(file)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        coded = {i: bytes(of[c] for c in t) for t, i in vocabulary.items()}
        self.bytes = [coded.get(i, b"") for i in range(1 + max(spec["model"]["vocab"].values()))]
        self.fast = None
        if pattern:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: i for i, b in coded.items()}, special_tokens={}).encode_ordinary

    def encode(self, texts: Sequence[str], odd: Sequence[bool] | None = None) -> list[list[int]]:
        """Ids of each text; ``odd`` texts (None: all) go through the library."""
        plain = [self.fast is not None and odd is not None and not odd[k] for k in range(len(texts))]
        others = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.fast(t) if p else next(others).ids for t, p in zip(texts, plain)]


class SideB:
    """A SentencePiece model: ids, without begin and end, and each id's bytes."""

    def __init__(self, model: bytes):
        self.codec = Codec(model)
        sp = self.codec.sp
        written = re.compile("<0x([0-9A-F]{2})>").fullmatch
        self.bytes = [bytes([int(written(p)[1], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(sp.id_to_piece, range(sp.get_piece_size())))]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, np.uint32)[1:-1] for ids in self.codec.encode(texts)]


class Tokens:
    """One side's tokens of a run of texts: ids, ends in bytes from the run's start, and the first token of each text."""

    def __init__(self, ids: list[np.ndarray], lengths: np.ndarray):
        self.ids = np.concatenate([*ids, np.empty(0, np.int64)]).astype(np.int64)
        self.first = np.cumsum([0, *map(len, ids)])
        self.ends = np.cumsum(lengths[self.ids])

    def after(self, place: np.ndarray) -> np.ndarray:
        """The token that starts at each of these byte places."""
        return np.searchsorted(self.ends, place, "right")


def lanes(a: Tokens, b: Tokens, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where lanes start: those of texts, and in long texts the first blanks behind each LANE_BYTES at which
    tokens of A and of B end. data and offsets: the run's bytes, and where its texts start and end."""
    long = np.flatnonzero(np.diff(offsets) > LANE_BYTES)
    starts = offsets[:-1][np.diff(offsets) > 0]
    if not len(long):
        return starts
    blanks = np.flatnonzero(data == 0x20)
    wanted = np.concatenate([np.arange(offsets[d] + LANE_BYTES, offsets[d + 1], LANE_BYTES) for d in long])
    at = np.searchsorted(blanks, wanted)
    places = blanks[at[at < len(blanks)]]
    chosen = np.zeros(len(data) + 1, np.int8)
    for side in (a, b):
        chosen[side.ends] += 1
    marked = np.zeros(len(data), bool)
    marked[places[chosen[places] == 2]] = True
    marked[starts] = True
    return np.flatnonzero(marked)


def merge(a: Tokens, b: Tokens, starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links as places of their A and their B token, and the places of the A and the B tokens that end a group.

    starts: byte places where lanes start. A lane is through where the next one starts.
    """
    i, j = a.after(starts), b.after(starts)
    through = np.append(starts[1:], total)
    a_ends, b_ends = a.ends, b.ends
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(i):
        end_a, end_b = a_ends[i], b_ends[j]
        links_a.append(i)
        links_b.append(j)
        both = end_a == end_b
        cuts_a.append(i[both])
        cuts_b.append(j[both])
        done = both & (end_a == through)
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        if done.any():
            left = ~done
            i, j, through = i[left], j[left], through[left]
    none = [np.empty(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (links_a, links_b, cuts_a, cuts_b))


def written_ids(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of the numbers below n, from the left, with room for a sign behind them; and how many they are."""
    digits = [str(i).encode() for i in range(n)]
    width = max(map(len, digits), default=1)
    cells = np.frombuffer(b"".join(d.ljust(width + 1) for d in digits), np.uint8).reshape(n, width + 1)
    return cells, np.array([len(d) for d in digits])


def group_texts(a: Tokens, b: Tokens, last_a: np.ndarray, last_b: np.ndarray, digits: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text: its groups in order, A's ids before B's."""
    cut_a, cut_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    cut_a[last_a], cut_b[last_b] = True, True
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    n_groups = int(cut_a.sum())
    upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=n_groups)), np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n_groups))])
    place_a, place_b = np.arange(len(a.ids)) + upto_b[group_a], np.arange(len(b.ids)) + upto_a[group_b] if n_groups else np.arange(0)
    ids, signs = np.empty(len(a.ids) + len(b.ids), np.int64), np.empty(len(a.ids) + len(b.ids), np.uint8)
    ids[place_a], ids[place_b] = a.ids, b.ids
    signs[place_a], signs[place_b] = np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))
    cells, sizes = digits[0][ids], digits[1][ids]
    cells[np.arange(len(ids)), sizes] = signs
    flat = cells[np.arange(cells.shape[1]) <= sizes[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])[a.first + b.first]
    return [flat[s : max(s, e - 1)] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]  # without the last sign


class Aligner:
    """One task's two tokenizers."""

    def __init__(self, file: str, pattern: str | None, model: bytes):
        self.a, self.b = SideA(file, pattern), SideB(model)
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        self.digits = written_ids(max(map(len, self.lengths)))

    def align(self, column: pa.Array) -> dict[str, list | np.ndarray]:
        """By text: n_a, n_b, n_groups, n_links, groups (bytes) and the id pairs of its links, a * (B's size) + b."""
        texts = [t or "" for t in column.to_pylist()]
        spaced = [" " + t for t in texts]
        coded = [t.encode("utf-8", "replace") for t in spaced]
        odd = unusual(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
        ids_a, ids_b = self.a.encode(spaced, odd), self.b.encode(texts)
        for k, data in enumerate(coded):
            sides = ((self.a, ids_a[k]), (self.b, ids_b[k].tolist())) if texts[k] else ()
            if not sides or any(b"".join(map(side.bytes.__getitem__, own)) != data for side, own in sides):
                ids_a[k], ids_b[k], coded[k] = [], ids_b[k][:0], b""
        a, b = Tokens([np.array(x, np.int64) for x in ids_a], self.lengths[0]), Tokens(ids_b, self.lengths[1])
        offsets = np.cumsum([0, *map(len, coded)])
        starts = lanes(a, b, np.frombuffer(b"".join(coded), np.uint8), offsets)
        at_a, at_b, last_a, last_b = merge(a, b, starts, int(offsets[-1]))
        owner = np.searchsorted(a.first, at_a, "right") - 1
        order = np.argsort(owner, kind="stable")
        n = len(texts)
        n_links = np.bincount(owner, minlength=n)
        keys = (a.ids[at_a] * len(self.b.bytes) + b.ids[at_b])[order]
        return {
            "n_a": np.diff(a.first), "n_b": np.diff(b.first), "n_groups": np.bincount(np.searchsorted(a.first, last_a, "right") - 1, minlength=n), "n_links": n_links,
            "groups": group_texts(a, b, last_a, last_b, self.digits), "keys": np.split(keys, np.cumsum(n_links)[:-1]) if n else [],
        }


def _packed(keys: np.ndarray) -> bytes:
    """Id pairs in 4 bytes where they fit, behind a byte that says so."""
    narrow = not len(keys) or keys.max() < 1 << 32
    return (b"\4" if narrow else b"\10") + keys.astype("<u4" if narrow else "<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<u8", offset=1).astype(np.int64)


def aligned(docs: DataFrame, file_a: str, model_b: str, *, pattern_a: str | None = None, text: str = "text", keep: Sequence[str] | None = None, with_groups: bool = False) -> DataFrame:
    """The columns ``keep`` (None: all) in the struct doc, then n_a, n_b, n_groups, n_links, groups_sha256 (if asked for,
    groups too) and links, the packed id pairs. The tokenizers' files are read on the driver and sent along, a few MB."""
    with open(file_a, encoding="utf-8") as f, open(model_b, "rb") as g:
        files = f.read(), g.read()
    sent = docs.sparkSession.sparkContext.broadcast(files)

    def compute(batch, state):
        aligner = state.get("aligner") or state.setdefault("aligner", Aligner(sent.value[0], pattern_a, sent.value[1]))
        found = aligner.align(batch.column(1))
        out = [pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
        out.append(pa.array([g and hashlib.sha256(g).hexdigest() or "" for g in found["groups"]], pa.string()))
        if with_groups:
            out.append(pa.array([g.decode() for g in found["groups"]], pa.string()))
        return [*out, pa.array(map(_packed, found["keys"]), pa.binary())]

    fields = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, " + "groups string, " * with_groups + "links binary"
    return map_texts(docs, compute, fields, keep=keep, text=text)


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each id pair, and whether no pair of the same B id holds more."""
    arrow_batches(links.sparkSession)

    def count(batches):
        held, waiting = [], 0

        def summed():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(_unpacked(data))
                waiting += len(held[-1])
                if waiting > TASK_LINKS:
                    yield summed()
                    waiting = 0
        if held:
            yield summed()

    counts = cut(links.select("links").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    of_b = F.pmod("pair", F.lit(size_b))
    most = counts.groupBy(of_b.alias("of_b")).agg(F.max("n").alias("most"))
    return counts.join(most, of_b == F.col("of_b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent_pairs(counts: DataFrame, most: int = SENT_PAIRS) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A least count that at most ``most`` pairs reach, and these pairs (sorted), their counts and whether they are best.
    Counts are put in classes of an eighth of a doubling, so the histogram has some hundred rows."""
    level = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("least")).collect(), key=lambda r: -r["level"]):
        held += r["held"]
        if held > most:
            break
        least = r["least"]
    if least is None:
        return 1 << 62, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
    sent = counts.filter(F.col("n") >= least).select("pair", "n", "best").toArrow().sort_by("pair")
    return least, tuple(sent[c].to_numpy() for c in ("pair", "n", "best"))


def align_tokenizers(docs: DataFrame, file_a: str, model_b: str, *, pattern_a: str | None = None, text: str = "text", keep: Sequence[str] | None = None, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """The columns ``keep`` (None: all) in the struct doc, then n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256."""
    import sentencepiece

    kept = docs.select(whole_row(keep), F.col(text).cast("string").alias("text"))
    found = aligned(kept, file_a, model_b, pattern_a=pattern_a, keep=["doc"])
    plain = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    base = cut(found.select(F.monotonically_increasing_id().alias("row"), F.col("doc.doc").alias("doc"), *plain, "links"))
    size_b = sentencepiece.SentencePieceProcessor(model_file=model_b).get_piece_size()
    counts = cut(pair_counts(base, size_b))
    least, frequent = frequent_pairs(counts, sent_pairs)
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def look_up(batches):
        pairs, n, best = sent.value
        for batch in batches:
            for begin, end in runs(batch.column(batch.num_columns - 1)):
                part = batch.slice(begin, end - begin)
                out = [[], [], [], []]
                for data in part.column(part.num_columns - 1).to_pylist():
                    keys = _unpacked(data)
                    at = np.minimum(np.searchsorted(pairs, keys), max(0, len(pairs) - 1))
                    hit = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
                    rest, times = np.unique(keys[~hit], return_counts=True)
                    for o, value in zip(out, (int(best[at[hit]].sum()), int(n[at[hit]].sum()), rest, times)):
                        o.append(value)
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, out, kinds)], names)

    arrow_batches(docs.sparkSession)
    added = T.StructType.fromDDL("own_best bigint, own_sum bigint, rest array<bigint>, times array<bigint>")
    schema = T.StructType([*base.drop("links").schema, *added])
    names = schema.names
    looked = cut(base.mapInArrow(look_up, schema))
    rest = looked.filter(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", "x.rest", "x.times")
    rare = counts.filter(F.col("n") < least)
    sums = rest.join(rare, F.col("rest") == F.col("pair")).groupBy(F.col("row").alias("of_row")).agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    none = F.lit(0)
    total = {"n_best": F.col("own_best") + F.coalesce("more_best", none), "count_sum": F.col("own_sum") + F.coalesce("more_sum", none)}
    out = looked.join(sums, F.col("row") == F.col("of_row"), "left")
    return out.select("doc", *plain[:-1], *[v.alias(k) for k, v in total.items()], "groups_sha256")
