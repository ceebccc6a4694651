"""Spelling variants of words, found with a variable-length gram index.

1. Words are counted inside tasks and summed by one aggregate. A word occurrence in a document may lose a letter first,
   by a rule that depends on the document and the word alone (``slip``), which plants misspellings to be found.
2. The gram dictionary starts with all grams of QMIN characters. A gram that is too frequent among the words is pruned:
   the next character is added to it, up to QMAX. So only the frequent grams are stored, the stems that go on; their
   number has a bound, MOST_STEMS, as the limit of frequency follows the input: limit = characters x lengths / bound.
3. A word is decomposed: at each place stands the longest gram of the dictionary.
4. Two words are near if one inserted, deleted or replaced character parts them. Then they have a left part u and a
   right part v in common. Which grams an edit behind u can affect follows from u alone: those that a stem at u's end
   may lengthen, and those behind it. Likewise grams of v that a gram from before v could cover. For each place of an
   edit a word is posted in the list of the last gram of u and the first gram of v that no edit there can affect, each
   with its place, so with all that lies before it or behind it; where no gram is safe, all of u or v stands in. A word
   has a list for each pair of neighbouring safe grams, fewer than it has places, and near words share one.
5. Lists are merged by a join on their 64-bit names, and each pair is verified by its edit distance inside the join, so
   only near pairs leave it.

Forms: the near word with the largest count (ties: smallest in code-point order) if that count is at least RATIO times
the word's own. Counts double along a chain of forms, so roots are found by pointer doubling in few rounds.

Null and empty texts have no words; a null doc_id counts as the empty string in ``slip``. Repeated rows are counted
each. An empty table, or one without frequent words, gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.llm.shared import arrow_batches, cut

QMIN, QMAX, MOST_STEMS, LONG = 2, 5, 20_000, 64
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Distinct words that a task counts before it passes them on.
TABLE_WORDS = 200_000
MOST_ROUNDS = 40

_words = re.compile("[A-Za-zÀ-ÿ]+").findall
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def slip(doc_id: str, word: str) -> str:
    """The word, or the word without one letter where a checksum of document and word is divided by 97."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", change: Callable[[str, str], str] | None = slip) -> DataFrame:
    """(word, n): occurrences of each lower-cased word in all texts, after ``change`` if one is given."""
    arrow_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def counted():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                if not t:
                    continue
                own = Counter(_words(t.translate(_LOWER)))
                if change is None:
                    total.update(own)
                else:
                    for w, n in own.items():
                        total[change(i or "", w)] += n
                if len(total) > TABLE_WORDS:
                    yield counted()
        yield counted()

    parts = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string")).mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def gram_stems(words: DataFrame, most: int = MOST_STEMS) -> set[str]:
    """The frequent grams of QMIN to QMAX - 1 characters, which the dictionary lengthens: at most ``most``, since the
    words have no more than characters x lengths grams and each stem has more than ``limit`` of them."""
    words = words.filter(F.length("word") <= LONG + 1)
    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    limit = chars * (QMAX - QMIN) // most + 1
    lengths = F.array(*map(F.lit, range(QMIN, QMAX)))
    places = F.transform(F.sequence(F.lit(1), F.length("word")), lambda p: F.transform(lengths, lambda q: F.substr("word", p, q)))
    # A gram at the word's end comes out shorter for each longer length; it counts once, where its length is the one asked for.
    grams = words.select(F.posexplode(F.flatten(places)).alias("i", "gram")).filter(F.length("gram") == QMIN + F.pmod("i", F.lit(QMAX - QMIN)))
    frequent = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= limit)
    return set(frequent.select("gram").toArrow()["gram"].to_pylist())


def gram_ends(word: str, stems: set[str]) -> list[int]:
    """Where the longest gram of the dictionary that starts at each place ends; 0 where less than QMIN characters follow."""
    n, out = len(word), []
    for p in range(n):
        q = p + QMIN
        while q < n and q - p < QMAX and word[p:q] in stems:
            q += 1
        out.append(q if q <= n else 0)
    return out


def lists_of(word: str, stems: set[str]) -> set[tuple[str, str]]:
    """The lists that a word is posted in: for each place of an edit, what its safe grams keep on the left and on the right.

    Left of i: a stem that ends at i may go on behind it, so grams from its start on are not safe. Right of e: a gram
    from before e may reach QMAX - 1 characters far, so the first gram that ends behind these is safe.
    """
    n, ends = len(word), gram_ends(word, stems)
    left, reach = [], 0
    for i in range(n + 1):
        first = max(0, i - 1)
        for j in range(i - QMIN, max(-1, i - QMAX), -1):
            if word[j:i] in stems:
                first = j
        reach = max(ends[:first], default=0)
        left.append(word[:reach] if reach else word[:i])
    right = []
    for e in range(n + 1):
        start = next((p for p in range(e, n) if ends[p] >= e + QMAX), e)
        right.append(word[start:])
    return {(left[i], right[e]) for i in range(n + 1) for e in (i, i + 1) if e <= n}


def long_lists_of(word: str) -> set[tuple[str, str]]:
    """The lists of a long word. Of two near words, m the shorter's length, an edit at m // 2 or behind leaves the first m // 2
    characters as they are, and one before that the last m - m // 2. A word may be the shorter one or the longer one."""
    n = len(word)
    return {x for m in (n, n - 1) for x in ((f"{m} " + word[: m // 2], ""), (f"{m}", word[n - (m - m // 2) :]))}


def all_lists_of(word: str, stems: set[str]) -> set[tuple[str, str]]:
    """Words of LONG and LONG + 1 characters are in lists of both kinds, as near words may be on either side."""
    lists = lists_of(word, stems) if len(word) <= LONG + 1 else set()
    return lists | long_lists_of(word) if len(word) >= LONG else lists


def postings(words: DataFrame, stems: set[str]) -> DataFrame:
    """(list, word, n): the lists, by name, that each of words (word, n) is posted in."""
    sent = words.sparkSession.sparkContext.broadcast(stems)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [["\0".join(k) for k in all_lists_of(w, sent.value)] for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.string()))], ["word", "n", "keys"])

    posted = words.select("word", "n").mapInArrow(post, "word string, n bigint, keys array<string>")
    return posted.select(F.explode("keys").alias("key"), "word", "n").select(F.xxhash64("key").alias("list"), "word", "n")


def near_pairs(words: DataFrame, stems: set[str]) -> DataFrame:
    """(word, n, near, near_n) for each word and each other that one inserted, deleted or replaced character parts from it."""
    a = postings(words, stems)
    same_list = F.col("a.list") == F.col("b.list")
    alike = (F.abs(F.length("a.word") - F.length("b.word")) <= 1) & (F.col("a.word") != F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1)
    return a.alias("a").join(a.alias("b"), same_list & alike).select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n")).distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for links (word, form), which run to larger counts and so have no circles: pointer doubling."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(MOST_ROUNDS):
        next_ = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = links.join(next_, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = cut(step)
        links = step.select("word", "root")
        if not step.filter("moved").take(1):
            return links
    raise RuntimeError("forms run in a circle")


def variants(words: DataFrame, *, ratio: float = RATIO, most_stems: int = MOST_STEMS) -> DataFrame:
    """For distinct words (word, n): word, form, root, n, n_near and form_n."""
    words = cut(words.select("word", "n"))
    pairs = near_pairs(words, gram_stems(words, most_stems))
    # Of equal counts the smaller word: min of (-count, word) is the largest count first.
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    held = words.alias("w").join(best.alias("p"), F.col("w.word") == F.col("p.word"), "left")
    near_n = -F.col("best.less")
    takes = near_n >= ratio * F.col("n")
    found = cut(held.select("w.word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, near_n).alias("form_n")))
    roots = follow(found.filter("form is not null"))
    out = found.alias("f").join(roots.alias("r"), F.col("f.word") == F.col("r.word"), "left")
    return out.select("f.word", "form", F.coalesce("root", "f.word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", change: Callable[[str, str], str] | None = slip, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """The variants among the frequent words of all texts."""
    counts = word_counts(docs, text=text, doc_id=doc_id, change=change)
    return variants(counts.filter((F.length("word") >= least_length) & (F.col("n") >= least_count)))


def respelled(docs: DataFrame, roots: DataFrame, *, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """(n_variants): how many words of each text have another root in ``roots`` (word, root), with the columns ``keep``
    (None: all) in the struct doc. Words are joined to their roots; a text is not sent along."""
    from waygrid.llm.shared import whole_row

    numbered = cut(docs.select(whole_row(keep), F.col(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = numbered.select("row", F.explode(F.regexp_extract_all(lowered, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("word"))
    changed = words.join(roots.filter("word <> root").select("word"), "word").groupBy("row").agg(F.count(F.lit(1)).alias("n_variants"))
    return numbered.join(changed, "row", "left").select("doc", F.coalesce("n_variants", F.lit(0)).alias("n_variants"))
