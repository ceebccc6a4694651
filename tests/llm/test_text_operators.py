"""Operators that look at one text at a time, against plain Python on whole small tables and odd cases."""

import hashlib
import math
import os
import random
import re
import zlib
from array import array
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from waygrid.llm import license_scan, pii, quality_classifier, quality_rules, sentencepiece_codec, token_counts
from waygrid.llm.queries import PIECE_MODEL, QUERIES

WORDS = re.compile("[^\x20\x09-\x0d]+").findall
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "a b c a b c"), (5, "a b c a b c"), (None, "null id"), (7, "é漢😀 \x00 word " * 20), (8, "long " * 30000), (9, "y" * 200000), (10, "line\nline\n\nline\n \n")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, "s", 3, "clash", "clash") for (i, t), lang in zip(ODD, [None, "en", "de"] * 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, doc string")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_codec_agrees_with_the_library(spark, sf_dir, documents, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)

    def expected(text):
        ids = [sp.bos_id(), *sp.encode(text or ""), sp.eos_id()]
        return len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    got = QUERIES["op1_sentencepiece"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == {i: expected(t) for i, t in documents.items()}
    found = sentencepiece_codec.encode_texts(odd, PIECE_MODEL).select("doc.doc_id", "doc.text", "n_tokens", "ids_sha256", "decoded_sha256", F.size("ids").alias("n"), "doc.n_words").collect()
    assert len(found) == len(ODD)
    for r in found:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(r["text"]) and r["n"] == r["n_tokens"] and r["n_words"] == "clash"


def test_codec_on_random_texts():
    codec = sentencepiece_codec.Codec(open(PIECE_MODEL, "rb").read())
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab the\n\t\r é▁　漢😀\x0b\x00\x7f'.<s></s>") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids == array("I", [1, *codec.sp.encode(text), 2]).tobytes()


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans(spark, sf_dir, documents):
    for r in QUERIES["op5_pii"](spark, sf_dir).collect():
        base = brute_pii(documents[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{b}:{e}" for k, b, e in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
    rng = random.Random(5)
    for _ in range(20000):
        t = "".join(rng.choice("ab0123456789..@@--++ ()é%_1234567890") for _ in range(rng.randint(0, 60)))
        assert pii.detect(t) == brute_pii(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john.doe (at) example (dot) com ok", "email", "john.doe (at) example (dot) com"),
        ("é jo at example dot co dot uk now", "email", "jo at example dot co dot uk"),
        ("j​o@exаmple.com", "email", "j​o@exаmple.com"),
        ("call plus one two three, four five six seven eight nine zero", "phone", "plus one two three, four five six seven eight nine zero"),
        ("card four one one one 1111 1111 1111", "card", "four one one one 1111 1111 1111"),
        ("host 192 dot 168 dot 1 dot 1 up", "ip", "192 dot 168 dot 1 dot 1"),
    ],
)
def test_pii_disguises(text, kind, found):
    base, added = pii.find(text)
    assert [(k, text[b:e]) for k, b, e in added] == [(kind, found)] and not base
    assert found not in pii.redact(text, added)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("host one nine two (dot) one six eight (dot) 0 [.] one up", "ip", "one nine two (dot) one six eight (dot) 0 [.] one"),
        ("192 dot one six eight dot 1 dot nine", "ip", "192 dot one six eight dot 1 dot nine"),
        ("plus one five five five - one two three - four five six seven.", "phone", "plus one five five five - one two three - four five six seven"),
        ("call plus 44 20 7946 0958 now", "phone", "plus 44 20 7946 0958"),
        *((f"write jane at firm dot {end} ok", "email", f"jane at firm dot {end}") for end in ("it", "in", "be", "ie", "dk", "no", "ai", "me", "xyz", "museum")),
    ],
)
def test_pii_spelled_groups_and_endings(text, kind, found):
    base, added = pii.find(text)
    assert [(k, text[b:e]) for k, b, e in added] == [(kind, found)] and not base


@pytest.mark.parametrize("text", ["two plus 3 is five", "in 2020 - 2021 - 2022 - 2023", "take one dot two dot three", "look at vector dot product", "met at the dot in it"])
def test_pii_leaves_near_misses(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize("text", ["we look at this dot product", "met at home", "one two three four five six seven", "", "plain (at) last", "un deux un deux"])
def test_pii_leaves_clean_texts(text):
    assert pii.find(text) == ([], [])


def test_pii_generated_disguises():
    """Addresses, numbers and cards put in among words, disguised at random: each is found at its own offsets."""
    rng = random.Random(11)
    digits = "zero one two three four five six seven eight nine".split()
    alike = str.maketrans({"a": "а", "e": "е", "o": "о", "c": "с", "p": "р"})

    def email():
        name, host, end = ("".join(rng.choices("bdfghklmnrstuvz", k=rng.randint(3, 7))) for _ in range(3))
        at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("{at}", "{dot}"), (" at ", " dot "), ("＠", ".")])
        return "email", f"{name}{at}{host}{dot}{end[:3]}"

    def homoglyph():
        name = "".join(rng.choices("aeocp", k=5))
        return "email", f"x{name.translate(alike)}@{name}.com"

    def ip():
        return "ip", " dot ".join(rng.choice([str, lambda n: " ".join(digits[int(c)] for c in str(n))])(rng.randint(0, 255)) for _ in range(3)) + " dot " + digits[rng.randint(0, 9)]

    def phone():
        return "phone", "plus " + " ".join(digits[rng.randint(0, 9)] for _ in range(rng.randint(9, 15)))

    def card():
        body = [rng.randint(0, 9) for _ in range(15)]
        total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(body))
        return "card", " ".join(digits[d] for d in [*body, -total % 10])

    words = ["river", "über", "漢字", "stone", "ñandú", "😀", "plain"]
    for _ in range(2000):
        kind, disguise = rng.choice([email, homoglyph, ip, phone, card])()
        lead, tail = ("".join(rng.choice(words) + ", " for _ in range(rng.randint(0, 4))) for _ in range(2))
        text = f"{lead}; {disguise} ; {tail}"
        base, added = pii.find(text)
        found = [(k, text[b:e]) for k, b, e in added]
        assert (kind, disguise) in found and not base, (text, base, found)
        assert disguise not in pii.redact(text, added)


def test_pii_odd_rows_and_linear_time(odd):
    assert odd.count() == pii.redact_documents(odd).count()
    assert pii.redact_documents(odd).columns == odd.columns
    for t in ("9" * 200000, "a" * 200000, "a@" * 100000, "1." * 100000, "+1 " * 50000, "one " * 30000):
        pii.find(t)


def brute_rules(s):
    w = WORDS(s or "")
    grams, covered = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)), set()
    for k in range(len(w) - 2):
        if grams[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (s or "").split("\n") if WORDS(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", s or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, sf_dir, documents, odd):
    for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect():
        want = brute_rules(documents[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])
    for r in quality_rules.quality_rules(odd).select("doc.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect():
        assert tuple(r)[1:] == brute_rules(r["text"])


def brute_distances(rows, rules):
    """(class distance, word distance, kept) of each (lang, text), in plain Python."""

    def classes(text):
        c = Counter()
        for ch in text:
            name = next((n for n, chars in CLASS_CHARS if ch in chars), None)
            o = ord(ch)
            lead = ch.encode()[0]
            c[name or ("other" if o < 128 else "latin" if lead in (0xC2, 0xC3, 0xC5) else "two" if o < 0x800 else "three" if o < 0x10000 else "four")] += 1
        return c

    def commons(text):
        return Counter(w if w in quality_rules._WORDS else "" for w in (x.translate(LOWERED) for x in WORDS(text)))

    def js(p, q):
        a, b = max(1, sum(p.values())), max(1, sum(q.values()))
        total = 0.0
        for k in set(p) | set(q):
            x, y = p[k] / a, q[k] / b
            m = (x + y) / 2
            total += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
        return math.sqrt(min(1, max(0, total)))

    refs = {}
    for lang, text in rows:
        c, w = refs.setdefault(lang, (Counter(), Counter()))
        c.update(classes(text or ""))
        w.update(commons(text or ""))
    refs = {k: v for k, v in refs.items() if sum(v[1].values()) >= rules.guard_reference_words}
    out = []
    for lang, text in rows:
        text = text or ""
        n, failed = len(WORDS(text)), brute_rules(text)[-1]
        ref = refs.get(lang)
        c = js(classes(text), ref[0]) if ref and len(text) >= rules.guard_chars else None
        w = js(commons(text), ref[1]) if ref and n >= rules.guard_words else None
        odd = c is not None and c > rules.most_class_distance
        if w is not None:
            nearest = min([w, 1.0, *(js(commons(text), refs[x][1]) for x in quality_rules.COMMON if x in refs)])
            odd |= nearest > math.sqrt(rules.most_word_distance**2 + rules.word_noise / max(n, 1))
        out.append((c, w, not failed and not odd))
    return out


CLASS_CHARS = [
    ("vowel", "aeiou"), ("consonant", "bcdfghjklmnpqrstvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("stop", ".,;:?"), ("quote", "'\"()-"),
    ("symbol", "#*$%&|<>!=_/\\{}[]@^~`+"), ("blank", " \t"), ("line", "\n\r"),
]
LOWERED = {c: c + 32 for c in range(65, 91)}


def test_quality_rules_distances_and_verdict(spark, sf_dir):
    """Both distances, the guards and the verdict of every document against plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]
    want = dict(zip((i for i, _, _ in rows), brute_distances([(x, t) for _, x, t in rows], quality_rules.Rules())))
    for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect():
        c, w, kept = want[r["doc_id"]]
        assert r["kept"] == kept
        for got, expected in ((r["class_distance"], c), (r["word_distance"], w)):
            assert (got is None) == (expected is None) and (got is None or abs(got - expected) < 1e-6)


def test_quality_rules_tell_null_from_empty_language(spark):
    rows = [(1, "the cat of " * 100, None), (2, "zu und der " * 100, "")]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), quality_rules.Rules(guard_reference_words=1)).collect()
    assert all(r["class_distance"] < 1e-6 and r["word_distance"] < 1e-6 for r in got)


def test_quality_rules_keep_clean_and_drop_junk(spark, sf_dir):
    rules = QUERIES["op9_quality_rules"](spark, sf_dir.replace("0.001", "0.01"))
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    rows = rules.join(labels, "doc_id").filter("not base_failed").select("kept", "quality").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)


def test_quality_rules_drop_junk_by_words(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    rules = quality_rules.Rules()
    rows = QUERIES["op9_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("not base_failed and quality = 0").collect()
    assert sum(not r["kept"] for r in rows) > 0.8 * len(rows)
    by_words = [r for r in rows if not r["kept"] and not (r["class_distance"] or 0) > rules.most_class_distance]
    assert len(by_words) > 0.2 * len(rows)


def test_quality_rules_judge_rare_languages(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("lang", F.when(F.col("lang") != "en", F.concat("lang", F.lit("-x"))))
    few, many = (sorted(map(str, quality_rules.quality_rules(docs, quality_rules.Rules(reference_share=share), keep=["doc_id", "lang"]).collect())) for share in (0.5, 0.0))
    assert few == many
    far = quality_rules.quality_rules(docs, quality_rules.Rules(reference_share=0.5)).filter("n_words >= 50 and doc.lang is not null")
    assert far.count() > 0 and far.filter("word_distance is null").count() == 0
    assert quality_rules.quality_rules(odd, quality_rules.Rules(reference_share=2.0, guard_reference_words=1)).count() == len(ODD)


def test_quality_classifier_holds_out(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    rows = QUERIES["op2_quality_classifier"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.9


def test_quality_classifier_identity_and_odd_rows(spark, odd):
    import numpy as np
    import pyarrow as pa

    m = quality_classifier.Machine(buckets=1 << 8, rank=3)
    rng = np.random.default_rng(1)
    size = m.buckets + quality_classifier._N_STATS * quality_classifier._BINS
    model = {"w0": 0.3, "w": rng.normal(size=size), "v": rng.normal(size=(size, 3))}
    number, value, first = quality_classifier.features(pa.array([t for _, t in ODD[:8]]), m)
    got = quality_classifier.margins(model, number, value, first)
    for d in range(8):
        i, x = number[first[d] : first[d + 1]], value[first[d] : first[d + 1]]
        pairs = sum(model["v"][i[a]] @ model["v"][i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(got[d] - (0.3 + (model["w"][i] * x).sum() + pairs)) < 1e-9
    none = quality_classifier.train(odd, spark.createDataFrame([], "doc_id long, quality int"), m)
    assert {round(r["score"], 6) for r in quality_classifier.score(odd, none, m).collect()} == {0.5}


def test_token_counts(spark, sf_dir, documents, odd):
    pieces = token_counts.piece_ranks(open(PIECE_MODEL, "rb").read())
    model = token_counts.Unigram.ranked(pieces)

    def brute(word):
        w = token_counts.MARK + word
        best = [(0.0, 0)] + [None] * len(w)
        for end in range(1, len(w) + 1):
            n = len(w[end - 1].encode())
            options = [(best[end - 1][0] + n * model.unknown, -(best[end - 1][1] + n))]
            options += [(best[b][0] + model.scores[w[b:end]], -(best[b][1] + 1)) for b in range(max(0, end - model.longest), end) if w[b:end] in model.scores]
            s, c = max(options)
            best[end] = s, -c
        return best[-1][1]

    counts = {}
    for r in QUERIES["op7_token_counts"](spark, sf_dir).collect():
        words = WORDS(documents[r["doc_id"]] or "")
        for w in words:
            if w not in counts:
                counts[w] = brute(w)
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(counts[w] for w in words))
    assert token_counts.count_tokens(odd, PIECE_MODEL).count() == len(ODD)


#: Full texts where this machine has them.
FULL_TEXTS = {n: f"/usr/share/common-licenses/{f}" for n, f in (
    ("Apache-2.0", "Apache-2.0"), ("Artistic-1.0-Perl", "Artistic"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.2", "GFDL-1.2"), ("GFDL-1.3", "GFDL-1.3"), ("GPL-1.0", "GPL-1"), ("GPL-2.0", "GPL-2"),
    ("GPL-3.0", "GPL-3"), ("LGPL-2.0", "LGPL-2"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-1.1", "MPL-1.1"), ("MPL-2.0", "MPL-2.0"),
)}


def test_license_scan(spark, sf_dir, odd):
    texts = [(i, t.upper().replace("LICENSE", "Licence").replace("\n\n", "\n * ") if i % 2 else "Copyright (c) 2020 A B\n" + t) for i, (_, t) in enumerate(license_scan.KNOWN)]
    docs = spark.createDataFrame([*texts, (100, "MIT License and more words"), (101, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["license_id"] for r in license_scan.scan_licenses(docs, license_scan.known_digests(spark), keep=["doc_id"]).select("doc.doc_id", "license_id").collect()}
    assert found == {**{i: name for i, (name, _) in enumerate(license_scan.KNOWN)}, 100: None, 101: None}
    full = [(n, open(path).read()) for n, path in FULL_TEXTS.items() if os.path.exists(path)]
    wrapped = license_scan.KNOWN[7][1].replace("above copyright", "above\ncopyright")
    planted = spark.createDataFrame([*enumerate(t for _, t in full), (200, wrapped)], "doc_id long, text string")
    found = {r["doc_id"]: r["license_id"] for r in license_scan.scan_licenses(planted, license_scan.known_digests(spark)).select("doc.doc_id", "license_id").collect()}
    assert found == {**{i: n for i, (n, _) in enumerate(full)}, 200: "ISC"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.sql(license_scan.oracle_sql()).fetchall()) == sorted(map(tuple, QUERIES["op10_license_scan"](spark, sf_dir).collect()))
    assert license_scan.scan_licenses(odd, license_scan.known_digests(spark)).count() == len(ODD)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert sentencepiece_codec.encode_texts(none, PIECE_MODEL).count() == 0
    assert pii.find_pii(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert token_counts.count_tokens(none, PIECE_MODEL).count() == 0
    assert license_scan.scan_licenses(none, license_scan.known_digests(spark)).count() == 0
