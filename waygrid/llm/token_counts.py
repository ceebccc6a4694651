"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

A pre-token is a marker and a word, a run of characters other than \\x20 and \\x09-\\x0D. Its best segmentation into
pieces has the highest sum of piece scores; of equal sums the one with fewer tokens counts. The best score and count
of a prefix depend on the prefix alone, so words that share a prefix share its work: the distinct words of a run are
taken in order, which walks their trie depth first, and only the current path is kept. The count at a word's end is
stored in the task's table of words, so a word that comes again costs a lookup.

The scores are those of a public vocabulary whose pieces are ranked, not trained here: a piece of rank r has
log(1 / ((r + 1) H)), H the sum of all 1 / (r + 1). A character that no piece covers costs one token for each of its
UTF-8 bytes, with a penalty below every score.

Tables start anew at TABLE_WORDS words, so memory is bounded. A null, empty or blank text has no pre-tokens and 0
tokens. Rows are independent and stay in their task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from waygrid.llm.shared import map_texts

MARK = "▁"
TABLE_WORDS, KEPT_CHARS = 500_000, 64
_words = re.compile(r"[^\x20\x09-\x0D]+").findall


class Unigram:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        #: Ends of pieces: a substring that is none of them ends no piece, and neither does a longer one.
        self.ends = {p[i:] for p in scores for i in range(len(p))}
        self.unknown = min(scores.values()) - 10.0
        self.table: dict[str, int] = {}

    @classmethod
    def ranked(cls, pieces: Sequence[str]) -> Unigram:
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        return cls({p: -math.log(r + 1) - total for r, p in enumerate(pieces)})

    def count_words(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word. Sorted words visit the trie depth first; score and count are the path."""
        out, last = {}, ""
        score, count = [0.0], [0]
        scores, ends, unknown = self.scores.get, self.ends, self.unknown
        for w in sorted(words):
            marked = MARK + w
            shared, most = 0, min(len(last), len(marked))
            while shared < most and last[shared] == marked[shared]:
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                best = None
                for begin in range(end - 1, max(-1, end - 1 - self.longest), -1):
                    part = marked[begin:end]
                    if part not in ends:
                        break
                    if (own := scores(part)) is not None:
                        s, c = score[begin] + own, count[begin] + 1
                        if best is None or s > best or s == best and c < tokens:
                            best, tokens = s, c
                if best is None or score[end - 1] + unknown > best:
                    n_bytes = len(marked[end - 1].encode("utf-8", "replace"))
                    if best is None or score[end - 1] + n_bytes * unknown > best:
                        best, tokens = score[end - 1] + n_bytes * unknown, count[end - 1] + n_bytes
                score.append(best)
                count.append(tokens)
            out[w], last = count[-1], marked
        return out

    def count_texts(self, texts: Sequence[str]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        words = [_words(t) for t in texts]
        used = set().union(*words)
        fresh = used.difference(self.table)
        if len(self.table) + len(fresh) > TABLE_WORDS:
            self.table.clear()
            fresh = used
        own = self.count_words(fresh)
        table = self.table | own if any(len(w) > KEPT_CHARS for w in own) else self.table
        self.table.update((w, c) for w, c in own.items() if len(w) <= KEPT_CHARS)
        out = [len(ws) for ws in words], [sum(map(table.__getitem__, ws)) for ws in words]
        if len(self.table) > TABLE_WORDS:
            self.table.clear()
        return out


def piece_ranks(model: bytes) -> list[str]:
    """The ordinary pieces of a SentencePiece model, best first."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    return [p.piece for p in sorted((p for p in proto.pieces if p.type == p.NORMAL), key=lambda p: -p.score)]


def count_tokens(docs: DataFrame, model_path: str, *, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (None: all) in the struct doc, then n_pretokens and n_tokens."""
    with open(model_path, "rb") as f:
        model = f.read()

    def compute(batch, state):
        unigram = state.get("unigram") or state.setdefault("unigram", Unigram.ranked(piece_ranks(model)))
        return [pa.array(x, pa.int64()) for x in unigram.count_texts([t or "" for t in batch.column(1).to_pylist()])]

    return map_texts(docs, compute, "n_pretokens bigint, n_tokens bigint", keep=keep, text=text)
