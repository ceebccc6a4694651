"""SentencePiece encoding and decoding with a distinct-chunk table.

No piece of the model crosses a whitespace marker, so a text's pieces are those of its marked words: runs of markers
with the non-markers after them. Each task keeps a table of the distinct marked words it has met, has the library
segment each of them once, and joins the ids back by position. The table lives in the task that reads the texts:
a table of the whole corpus would grow with it, and meeting it again would shuffle every word's position. When it
holds TABLE_WORDS words it starts anew, so memory is bounded whatever the texts; a lost executor costs its tasks.

A marked word may itself be cut at characters that no piece of two or more characters holds (line breaks, for
instance): no merge can cross them. That keeps the words few and long texts without blanks cheap.

A null text counts as empty and has the begin and end ids alone. Texts that a piece could cross (a model with
other settings) are encoded whole; the result is the library's in every case.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waygrid.llm.shared import map_texts

MARK = "▁"
#: Distinct words a task keeps at most, and the longest word it keeps, in characters.
TABLE_WORDS, KEPT_CHARS = 400_000, 64


class Codec:
    """One task's tokenizer with its table."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        pieces = [p.piece for p in proto.pieces if p.type == p.NORMAL]
        user = [p for p in proto.pieces if p.type == p.USER_DEFINED]
        self.by_words = (
            train.model_type == train.BPE and train.byte_fallback and not train.treat_whitespace_as_suffix and not user and not norm.precompiled_charsmap
            and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        )
        joined = {c for p in pieces if len(p) > 1 for c in p}
        #: ASCII control characters that never merge: words end before and after them.
        self.alone = {c for c in map(chr, [*range(1, 32), 127]) if c not in joined}
        barrier = "".join(map(re.escape, sorted(self.alone)))
        self.cut = re.compile(f"{MARK}*[^{MARK}{barrier}]+|{MARK}+|[{barrier}]").findall
        self.table: dict[str, bytes] = {}
        self.bos, self.eos = (array("I", [i]).tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.lead = len(self.sp.encode("\n"))

    def _segment(self, words: set[str]) -> dict[str, bytes]:
        """Marked words' ids. Markers alone, or a word without one, are encoded behind a barrier, whose ids are left out."""
        marked = [w for w in words if w[0] == MARK != w[-1]]
        others = [w for w in words if not w[0] == MARK != w[-1]]
        out = {w: array("I", ids).tobytes() for w, ids in zip(marked, self.sp.encode([w[1:] for w in marked], num_threads=1))}
        out.update((w, array("I", ids[self.lead :]).tobytes()) for w, ids in zip(others, self.sp.encode(["\n" + w for w in others], num_threads=1)))
        return out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of whole texts with begin and end, as unsigned 32-bit integers in the machine's order (little-endian
        wherever Spark and its Arrow batches run)."""
        plain = [self.by_words and "\n" in self.alone and "\0" not in t for t in texts]
        words = [self.cut(MARK + t.replace(" ", MARK)) if t and p else [] for t, p in zip(texts, plain)]
        used = set().union(*words)
        fresh = used.difference(self.table)
        if len(self.table) + len(fresh) > TABLE_WORDS:
            self.table.clear()
            fresh = used
        own = self._segment(fresh)
        table = self.table
        table.update((w, ids) for w, ids in own.items() if len(w) <= KEPT_CHARS)
        rest = {w: ids for w, ids in own.items() if len(w) > KEPT_CHARS}
        out = []
        for t, p, ws in zip(texts, plain, words):
            if not p:
                body = array("I", self.sp.encode(t)).tobytes()
            elif rest:
                body = b"".join([table.get(w) or rest[w] for w in ws])
            else:
                body = b"".join([table[w] for w in ws])
            out.append(self.bos + body + self.eos)
        if len(table) > TABLE_WORDS:
            table.clear()
        return out

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, "<u4").tolist())


def encode_texts(docs: DataFrame, model_path: str, *, text: str = "text", keep: Sequence[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Encodes every text and decodes it again: the columns ``keep`` in the struct doc, then n_tokens, ids (if
    asked for), ids_sha256 and decoded_sha256. The model's file is read on the driver and sent along, at most a few MB."""
    with open(model_path, "rb") as f:
        model = f.read()

    def compute(batch, state):
        codec = state.get("codec") or state.setdefault("codec", Codec(model))
        ids = codec.encode([t or "" for t in batch.column(1).to_pylist()])
        out = [pa.array([len(x) // 4 for x in ids], pa.int64())]
        if with_ids:
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), flat))
        out.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
        out.append(pa.array([hashlib.sha256(codec.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids]))
        return out

    fields = "n_tokens bigint, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, compute, fields, keep=keep, text=text)
