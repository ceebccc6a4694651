"""Quality rules by distribution divergence.

Each document's histograms of character classes and of common words are compared by Jensen-Shannon distance with
references of its language, which are sums over the whole corpus. Minimum-length guards leave short texts and
languages with little text alone.

The square of a clean text's word distance is about a constant over its words, as few words hit few bins; so the word
rule's limit falls with the number of words. A text in two languages is far from its own language's words and no junk,
so the rule takes the nearest of its language and the languages of COMMON.

Two passes over the texts: the first adds up one histogram per language and task, the second scores. References of
languages with a share of the corpus are sent to all tasks, and their texts stay where they are; only texts of rare
languages, whose number of references has no bound, are joined with them. Both ways give the same results. A null or empty text has no words and fails the base rules; a null language is a language of its
own. Repeated rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.llm.shared import arrow_batches, cut, map_rows, map_texts, whole_row
from waygrid.llm.text import Texts, keyed, mix, runs, windows

#: Very common words of the languages that the histograms tell apart.
COMMON = {
    "en": "the of and to in is that it was for on are as with his they be at one have this from or had by but not what all were we when your can said there an",
    "fr": "le la les de des du un une et est en que qui dans pour par sur au aux avec ne pas ce il elle se son plus ou mais nous vous leur",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine dem als auch es an werden aus er hat dass sie nach wird bei einer um am",
    "es": "el la los las de que y en un una ser se no haber por con su para como estar tener le lo todo pero más hacer o poder este ir del al",
}
_WORDS = sorted({w for text in COMMON.values() for w in text.split()})
#: Character classes, by the first byte of a character's UTF-8; continuation bytes (-1) are not counted.
_CLASSES = ["vowel", "consonant", "upper", "digit", "stop", "quote", "symbol", "blank", "line", "other", "latin", "two", "three", "four"]


def _class_table() -> np.ndarray:
    t = np.full(256, _CLASSES.index("other"), np.int64)
    for name, chars in (("consonant", "bcdfghjklmnpqrstvwxyz"), ("vowel", "aeiou"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("stop", ".,;:?"), ("quote", "'\"()-"), ("symbol", "#*$%&|<>!=_/\\{}[]@^~`+"), ("blank", " \t"), ("line", "\n\r")):
        t[[ord(c) for c in chars]] = _CLASSES.index(name)
    t[0x80:0xC0] = -1
    t[0xC0:0xE0] = _CLASSES.index("two")
    t[[0xC2, 0xC3, 0xC5]] = _CLASSES.index("latin")
    t[0xE0:0xF0] = _CLASSES.index("three")
    t[0xF0:] = _CLASSES.index("four")
    return t


_CLASS = _class_table()
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_LEAD = (np.arange(256) & 0xC0) != 0x80
N_CLASSES, N_COMMON = len(_CLASSES), len(_WORDS) + 1


@dataclass(frozen=True)
class Rules:
    """Limits. Distances are square roots of Jensen-Shannon divergences in bits, so from 0 to 1."""

    min_words: int = 50  # base rule
    most_repeat_pct: int = 50  # base rule
    guard_chars: int = 200  # fewer characters: no verdict from the character histogram
    guard_words: int = 50  # fewer words: no verdict from the word histogram
    guard_reference_words: int = 2_000  # a language with fewer words is compared with nothing
    reference_share: float = 0.001  # of the corpus's words: references from here on, at most 1,000, are sent to all tasks; others are joined
    most_class_distance: float = 0.30
    most_word_distance: float = 0.25  # of a text without end
    word_noise: float = 6.0  # over the number of words: what the square of the word distance may have besides


def _common_table() -> tuple[np.ndarray, np.ndarray]:
    hashed = Texts(pa.array(_WORDS)).words(lowered=True)
    order = np.argsort(hashed)
    return hashed[order], order


def histograms(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Per text, characters by class and words by common word (the last bin: all others; outer punctuation stays on words)."""
    docs = np.repeat(np.arange(t.n), np.diff(t.offsets))
    kind = _CLASS[t.data]
    counted = kind >= 0
    chars = np.bincount(docs[counted] * N_CLASSES + kind[counted], minlength=t.n * N_CLASSES).reshape(t.n, N_CLASSES)
    table, order = _common_table()
    hashed = t.words(lowered=True)
    place = np.minimum(np.searchsorted(table, hashed), len(table) - 1)
    bins = np.where(table[place] == hashed, order[place], N_COMMON - 1)
    words = np.bincount(t.owner(t.first) * N_COMMON + bins, minlength=t.n * N_COMMON).reshape(t.n, N_COMMON)
    return chars, words


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts p from the row of counts q."""

    def part(a, m):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(1)

    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = q / np.maximum(q.sum(1, keepdims=True), 1)
    m = (p + q) / 2
    return np.sqrt(np.clip((part(p, m) + part(q, m)) / 2, 0, 1))


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """The counts of the base rules."""
    lines, ends = t._edges(t.data != ord("\n"))
    before = np.concatenate([[0], np.cumsum(t.in_word)])
    filled = before[ends] > before[lines]
    lines, ends = lines[filled], ends[filled]
    owner = np.searchsorted(t.offsets, lines, side="right") - 1
    per_text = np.bincount(owner, minlength=t.n)
    salt = keyed(1, 3)[0]
    by_text = np.unique(np.stack([owner.astype(np.uint64), t.hashes(lines, ends)], 1), axis=0)[:, 0].astype(np.int64) if len(lines) else np.empty(0, np.int64)
    grams, at = windows(t.words(), t.first, 3)
    word_owner = t.owner(t.first)
    repeated = np.zeros(len(word_owner) + 1, np.int64)
    if len(grams):
        _, inverse, times = np.unique(mix(grams + word_owner[at].astype(np.uint64) * (salt | np.uint64(1))), return_inverse=True, return_counts=True)
        again = at[times[inverse] > 1]
        np.add.at(repeated, again, 1)
        np.add.at(repeated, again + 3, -1)
    covered = np.cumsum(repeated[:-1]) > 0
    return {
        "n_words": t.n_words,
        "word_chars": t.count(t.in_word & _LEAD[t.data]),
        "n_symbols": t.count(_SYMBOL[t.data]),
        "n_dup_lines": per_text - np.bincount(by_text, minlength=t.n),
        "n_repeat_words": np.bincount(word_owner[covered], minlength=t.n),
    }


def references(docs: DataFrame, rules: Rules = Rules(), *, text: str = "text", lang: str = "lang") -> tuple[dict, DataFrame | None]:
    """Histogram sums of each language over all documents: those of COMMON and at most 1 / reference_share others here,
    and a table (lang, bins) of the rest, if any."""

    def sums(batches):
        for batch in batches:
            total: dict = {}
            for begin, end in runs(batch.column(1)):
                t = Texts(batch.column(1).slice(begin, end - begin))
                both = np.hstack(histograms(t))
                langs = batch.column(0).slice(begin, end - begin).to_pylist()
                for name in set(langs):
                    total[name] = total.get(name, 0) + both[[x == name for x in langs]].sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([list(map(int, x)) for x in total.values()], pa.list_(pa.int64()))], ["lang", "bins"])

    parts = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(sums, "lang string, bins array<bigint>")
    by_lang = parts.groupBy("lang").agg(F.array(*[F.sum(F.col("bins")[i]) for i in range(N_CLASSES + N_COMMON)]).alias("bins"), F.sum(F.aggregate(F.slice("bins", N_CLASSES + 1, N_COMMON), F.lit(0).cast("long"), lambda a, b: a + b)).alias("words"))
    by_lang = cut(by_lang)
    total = by_lang.agg(F.sum("words")).first()[0] or 0
    enough = by_lang.filter(F.col("words") >= rules.guard_reference_words)
    sent = (F.col("words") >= rules.reference_share * total) | F.coalesce(F.col("lang").isin(*COMMON), F.lit(False))
    rare = enough.filter(~sent).select("lang", "bins")
    return {r["lang"]: np.array(r["bins"], float) for r in enough.filter(sent).collect()}, rare if rare.take(1) else None


def quality_rules(docs: DataFrame, rules: Rules = Rules(), *, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Counts, distances and verdict of each document: the columns ``keep`` (None: all) in the struct doc, then
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance and word_distance (null where a
    guard holds), base_failed and kept."""
    arrow_batches(docs.sparkSession)
    refs, rare = references(docs, rules, text=text, lang=lang)

    def judge(batch, state):
        t = Texts(batch.column(1))
        base = base_counts(t)
        chars, words = histograms(t)
        names = batch.column(2).to_pylist()
        own = refs
        if batch.num_columns > 3:  # a rare language's rows bring its reference
            have = batch.column(3).is_valid().to_pylist()
            own = {names[i]: np.array(batch.column(3)[i].as_py(), float) for i in {x: i for i, x in enumerate(names) if have[i]}.values()}
        far = {"class": np.full(t.n, np.nan), "word": np.full(t.n, np.nan)}
        nearest = np.min([np.ones(t.n), *(distance(words, refs[x][None, N_CLASSES:]) for x in COMMON if x in refs)], axis=0)
        for name in set(names):
            if (ref := own.get(name)) is not None:
                mine = np.array([x == name for x in names])
                far["class"][mine] = distance(chars[mine], ref[None, :N_CLASSES])
                far["word"][mine] = distance(words[mine], ref[None, N_CLASSES:])
        far["class"][chars.sum(1) < rules.guard_chars] = np.nan
        far["word"][t.n_words < rules.guard_words] = np.nan
        failed = (base["n_words"] < rules.min_words) | (100 * base["n_repeat_words"] > rules.most_repeat_pct * base["n_words"])
        most_word = np.sqrt(rules.most_word_distance**2 + rules.word_noise / np.maximum(t.n_words, 1))
        odd = (far["class"] > rules.most_class_distance) | (np.minimum(far["word"], nearest) > most_word)
        return [*(pa.array(x, pa.int64()) for x in base.values()), *(pa.array(x, pa.float64(), mask=np.isnan(x)) for x in far.values()), pa.array(failed), pa.array(~failed & ~odd)]

    fields = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, class_distance double, word_distance double, base_failed boolean, kept boolean"
    own_text, language = F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    if rare is None:
        return map_texts(docs, judge, fields, keep=keep, text=text, more=[language])
    rows = docs.select(whole_row(keep), own_text, language)
    here = F.when(F.col("lang").isNull(), F.lit(None in refs)).otherwise(F.col("lang").isin([x for x in refs if x is not None]))
    joined = rows.filter(~here).join(rare.withColumnRenamed("lang", "of_lang"), F.col("lang").eqNullSafe(F.col("of_lang")), "left").select("doc", "text", "lang", "bins")
    return map_rows(rows.filter(here), judge, fields).unionByName(map_rows(joined, judge, fields))
