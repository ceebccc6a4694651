"""Ranked place search as a join of queries with an index of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import SearchRanks
from waygrid.functions.geo import haversine
from waygrid.functions.strings import collated, digits_of, edit_distance_column, fuzzy_budget, normalise, tokens
from waygrid.plans.lineage import cut


def build_index(places: DataFrame, norm: Column | None = None) -> DataFrame:
    """Adds norm and toks. Names are normalised once, and a name that many places share once a task at most."""
    return places.withColumn("norm", normalise(F.col("name")) if norm is None else norm).withColumn("toks", tokens(F.col("norm")))


def _names(index: DataFrame) -> DataFrame:
    return index.select("norm", "toks").distinct()


#: Letters of a token that it is found by, at most.
LEAD = 4


def strong_matches(index: DataFrame, queries: DataFrame, cfg: SearchRanks = SearchRanks()) -> DataFrame:
    """Pairs of queries (query_id, q, and qlat, qlon that may be null) and names with the bonus of their first match:
    equal, prefix, prefix of a token, every query token a prefix of some token.

    Every kind of match implies that each token of the query is a prefix of some token of the name. So names are found by the
    first letters of their tokens, one to LEAD of them, and a query asks with as many letters as its longest token has."""
    leads = F.flatten(F.transform("toks", lambda t: F.transform(F.sequence(F.lit(1), F.least(F.length(t), F.lit(LEAD))), lambda n: F.substr(t, F.lit(1), n))))
    names = _names(index).select("norm", "toks", F.explode(F.array_distinct(leads)).alias("lead"))
    asked = queries.select("query_id", "q").filter("q <> ''").withColumn("qtoks", tokens(F.col("q")))
    longest = F.element_at(F.array_sort(F.transform("qtoks", lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), -1)["t"]
    pairs = asked.withColumn("lead", F.substring(longest, 1, LEAD)).join(names, "lead")
    bonus = (
        F.when(F.col("norm") == F.col("q"), cfg.exact)
        .when(F.col("norm").startswith(F.col("q")), cfg.prefix)
        .when(F.exists("toks", lambda t: t.startswith(F.col("q"))), cfg.token_prefix)
        .when(F.forall("qtoks", lambda x: F.exists("toks", lambda t: t.startswith(x))), cfg.all_tokens)
    )
    return pairs.withColumn("bonus", bonus).filter("bonus is not null").select("query_id", "norm", "bonus")


#: Most edits of a match; up to so many characters a part is found by what deletions leave of it, beyond by its segments. Edits
#: of two neighbours that are swapped may lie in two segments, so one more than twice the edits are made.
MOST_EDITS, SHORT = 2, 15
SEGMENTS = 2 * MOST_EDITS + 1


def _without_one(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))


def deletions(s: Column) -> Column:
    """A string and what is left of it without one and without two of its characters. Strings within two edits, swapped
    neighbours counting one, have one of these in common."""
    once = F.when(F.length(s) > 0, F.array_distinct(_without_one(s))).otherwise(F.array().cast("array<string>"))
    twice = F.flatten(F.transform(once, lambda t: F.when(F.length(t) > 0, _without_one(t)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(s), once, twice))


def _segment(length: Column, k: Column) -> tuple[Column, Column]:
    """Where segment k (from 0) of a string of a length begins, and how long it is."""
    begin = F.floor(length * k / SEGMENTS).cast("int")
    return begin, F.floor(length * (k + 1) / SEGMENTS).cast("int") - begin


def _posted(parts: DataFrame) -> DataFrame:
    """(key, part, name_digits): what parts of names are found by."""
    short = parts.filter(F.length("part") <= SHORT).select(F.explode(deletions(F.col("part"))).alias("key"), "part", "name_digits")
    n = F.length("part")

    def segment(k):
        begin, size = _segment(n, k)
        return F.concat_ws(" ", n, k, F.substr(F.col("part"), begin + 1, size))

    segments = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), segment)
    return short.unionByName(parts.filter(n > SHORT).select(F.explode(segments).alias("key"), "part", "name_digits"))


def _asked(asked: DataFrame) -> DataFrame:
    """Adds the keys that a query looks under: its own deletions for short parts, and for each length that a longer part may
    have, each segment wherever up to MOST_EDITS edits may have moved it to."""
    n = F.length("q")
    short = F.when(n - MOST_EDITS <= SHORT, deletions(F.col("q"))).otherwise(F.array().cast("array<string>"))

    def of_length(length):
        def of_segment(k):
            begin, size = _segment(length, k)
            return F.transform(F.sequence(F.lit(-MOST_EDITS), F.lit(MOST_EDITS)), lambda d: F.when((begin + d >= 0) & (begin + d + size <= n), F.concat_ws(" ", length, k, F.substr(F.col("q"), begin + d + 1, size))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), of_segment))

    lengths = F.filter(F.sequence(n - MOST_EDITS, n + MOST_EDITS), lambda x: x > SHORT)
    keys = F.array_distinct(F.filter(F.concat(short, F.flatten(F.transform(lengths, of_length))), lambda k: k.isNotNull()))
    return asked.withColumn("key", F.explode(keys))


def fuzzy_matches(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, norm, edits): names within the edit budget of queries, as a whole or by a token. Digits must agree.

    The parts of names, each once whatever number of names has it, are posted under what two deletions leave of them, or,
    if they are long, under their segments, one of which two edits must leave as it is. A query meets the parts that share
    a key and the digits; distances decide."""
    asked = queries.select("query_id", "q").filter("q <> ''").withColumn("most", F.when(F.length("q") <= 4, 1).otherwise(2)).withColumn("digits", digits_of(F.col("q")))
    names = _names(index).withColumn("name_digits", digits_of(F.col("norm"))).withColumn("part", F.explode(F.array_distinct(F.concat(F.array("norm"), F.col("toks")))))
    names = cut(names.select("norm", "part", "name_digits"))  # posted by part, and joined back to their names
    met = _asked(cut(asked)).join(_posted(names.select("part", "name_digits").distinct()), "key").filter((F.col("digits") == F.col("name_digits")) & (F.abs(F.length("part") - F.length("q")) <= F.col("most")))
    near = cut(met.select("query_id", "q", "most", "part", "name_digits").distinct())
    scored = near.withColumn("edits", edit_distance_column(F.col("q"), F.col("part"), 2)).filter(F.col("edits") <= F.least(F.col("most"), fuzzy_budget(F.greatest(F.length("q"), F.length("part")), 2)))
    return scored.select("query_id", "part", "name_digits", "edits").join(names.select("norm", "part", "name_digits"), ["part", "name_digits"]).groupBy("query_id", "norm").agg(F.min("edits").alias("edits"))


def search(index: DataFrame, queries: DataFrame, cfg: SearchRanks = SearchRanks(), *, fuzzy: bool = True, limit: int | None = None) -> DataFrame:
    """The best ``limit`` places of each query by score, then name as locales order it, then place_id. Fuzzy matches count only for
    queries without a strong one; places near a query that has coordinates get a bonus that falls with distance."""
    strong = strong_matches(index, queries, cfg).withColumn("edits", F.lit(0))
    hits = strong
    if fuzzy:
        weak = queries.join(strong.select("query_id").distinct(), "query_id", "left_anti")
        hits = strong.unionByName(fuzzy_matches(index, weak).withColumn("bonus", F.lit(None).cast("double")))
    where = queries.select("query_id", "qlat", "qlon")
    near = F.coalesce(cfg.locality * F.exp(-haversine(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon")) / cfg.locality_m), F.lit(0.0))
    score = F.when(F.col("bonus").isNotNull(), F.col("importance") + F.col("bonus")).otherwise(cfg.fuzzy * F.col("importance") - cfg.per_edit * F.col("edits")) + near
    ranked = hits.join(index, "norm").join(where, "query_id").withColumn("score", score)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), collated(F.col("name")), "name", "place_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (limit or cfg.limit)).select("query_id", "rank", "place_id", "name", "score")
