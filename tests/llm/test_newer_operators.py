"""Secrets, spelling variants and token alignment, against plain Python on whole small tables and odd cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waygrid.llm import secret_scan, spelling, token_alignment
from waygrid.llm.queries import BYTE_FILE, PIECE_MODEL, QUERIES

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "token=abcdefgh9 token"), (5, "token=abcdefgh9 token"), (None, "null id words"), (7, "é漢😀 \x00 ▁ word " * 20), (8, "long " * 30000), (9, "y" * 100000), (10, "line\nline\n\n  line\n \n")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", "clash", "clash") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a string, doc string, row string")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# --- secrets ---

PLAIN = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}


def brute_secrets(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, g, least)) in enumerate(PLAIN.items()) for m in p.finditer(text) if len(m[g]) >= least]
    return [(kind, b, e) for b, _, e, kind in sorted(found)]


def test_secrets_of_the_given_table(spark, sf_dir, documents):
    texts = dict(documents)
    got = QUERIES["op11_secrets"](spark, sf_dir).collect()
    assert len(got) == len(documents)
    for r in got:
        base = brute_secrets(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(secret_scan.joined(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in base) for k in PLAIN]


def test_secrets_of_random_texts():
    rng = random.Random(6)
    bits = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "AKIA", "ABCD1234", "=", ":", " ", "'", '"', "0123456789abcdef", "deadbeef", "\n", "é", "ſecret", "Key", "x", "tok", "en"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    found, tried = secret_scan.Scanner(secret_scan.BASE).scan(pa.array(texts))
    for t, spans in zip(texts, found):
        assert spans == brute_secrets(t), t
    low = [t.lower() for t in texts]
    plain = [not any(k in t for k in ("password", "passwd", "secret", "token", "api_key", "apikey", "aki", "kia")) for t in low]
    assert 1000 < sum(plain) and all(n == 1 for n, p in zip(tried, plain) if p)  # only the rule without trigrams looks at these


KEYS = {
    "github": "ghp_" + "aB3" * 12, "gitlab": "glpat-" + "x1Y2" * 5, "slack": "xoxb-123456789012-abcdef", "stripe": "sk_live_" + "a1" * 10, "google": "AIza" + "Sy_-1" * 7,
    "npm": "npm_" + "Zz9" * 12, "jwt": "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2Q", "private_key": "-----BEGIN RSA PRIVATE KEY-----\nMIIB\nAg==\n", "basic_auth": "HTTPS://me:hunter22@h",
}


@pytest.mark.parametrize("kind", KEYS)
def test_added_kinds_are_found(kind):
    key = KEYS[kind]
    spans, _ = secret_scan.Scanner(secret_scan.ADDED).scan(pa.array([f"né {key} z", key[:7], f"no{key[1:]}"]))
    assert (kind, 3, 3 + len(key)) in spans[0] and not spans[1] and all(k != kind for k, *_ in spans[2])


def test_queries_hold_wherever_an_expression_matches():
    """The index may let through too much, never too little: over random expressions and texts, and all rules."""
    rng = random.Random(7)

    def expression(depth=0):
        kind = rng.randrange(7 if depth < 3 else 2)
        if kind < 2:
            return "".join(rng.choice("abC") for _ in range(rng.randint(1, 4)))
        if kind == 2:
            return "[" + "".join(rng.sample("abcd", 2)) + "]"
        if kind == 3:
            return f"(?:{expression(depth + 1)}|{expression(depth + 1)})"
        if kind == 4:
            return f"(?:{expression(depth + 1)}){rng.choice(['?', '*', '+', '{2}', '{2,3}', '{0,2}'])}"
        if kind == 5:
            return expression(depth + 1) + rng.choice([".", "\\w", "[^a]"]) + expression(depth + 1)
        return expression(depth + 1) + expression(depth + 1)

    def holds(query, text):
        if query is True:
            return True
        return query in text if isinstance(query, bytes) else (all if query[0] == "and" else any)(holds(q, text) for q in query[1])

    matched = asked = 0
    for _ in range(1500):
        pattern, flags = expression(), rng.choice([0, re.IGNORECASE]) | re.ASCII
        query = secret_scan.trigram_query(pattern, flags)
        asked += query is not True
        for _ in range(20):
            text = "".join(rng.choice("abcCd") for _ in range(rng.randint(0, 16)))
            if re.search(pattern, text, flags):
                matched += 1
                assert holds(query, text.lower().encode()), (pattern, text, query)
    assert matched > 3000 and asked > 300  # enough of both for the test to say something
    assert [secret_scan.trigram_query(r.pattern, r.flags) is True for r in secret_scan.BASE] == [False, False, True]


def test_postings_are_those_of_each_text():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 30))).encode() for _ in range(200)]
    asked = [b"abc", b"aaa", b"cab", "é".encode() + b"a"]
    found = secret_scan.Index(asked).postings(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert {t: x.tolist() for t, x in found.items()} == {t: [k for k, text in enumerate(texts) if t in text] for t in asked}
    assert all(not len(x) for x in secret_scan.Index(asked).postings(np.empty(0, np.uint8), np.zeros(1, int)).values())


def test_secrets_of_odd_rows(spark, odd):
    out = secret_scan.find_secrets(odd).select("doc.*", "n_assign", "spans", "redacted").collect()
    assert len(out) == len(ODD) and {r["n_a"] for r in out} == {"clash"}
    assert [(r["n_assign"], r["spans"], r["redacted"]) for r in out if r["doc_id"] == 5] == [(1, "assign:0:15", "<ASSIGN> token")] * 2
    assert [r["redacted"] for r in out if r["doc_id"] == 1] == [None]
    kept = secret_scan.redact_secrets(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) and secret_scan.redact_secrets(odd.limit(0)).count() == 0


# --- spelling ---


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    out, words = {}, sorted(counts)
    for w in words:
        around = [x for x in words if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 2 * counts[w] else None
        out[w] = [form, w, counts[w], len(around), counts.get(form)]
    for w in words:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(x) for w, x in out.items()}


def plain_counts(documents):
    counts = Counter()
    for i, t in documents:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_of_the_given_table(spark, sf_dir, documents):
    counts = plain_counts(documents)
    got = rows_of(QUERIES["op12_spelling"](spark, sf_dir))
    assert {w: x[2] for w, x in got.items()} == counts and len(counts) > 2000
    # All pairs by their common deletions: independent of the index.
    by_deletion = defaultdict(set)
    for w in counts:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_deletion[k].add(w)
    around = {w: {x for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in by_deletion[k] if x != w and near(w, x)} for w in counts}
    for w, (form, _, n, n_near, form_n) in got.items():
        best = min(around[w], key=lambda x: (-counts[x], x), default=None)
        takes = best is not None and counts[best] >= 2 * n
        assert (form, n_near, form_n) == (best if takes else None, len(around[w]), counts[best] if takes else None)
    for w, x in got.items():
        assert x[1] == (got[x[0]][1] if x[0] else w)


@pytest.mark.parametrize("alphabet, most", [("ab", 4), ("abc", 30), ("abcdé", 10_000)])
def test_spelling_of_random_words(spark, alphabet, most):
    """Few stems to many, so that grams of all lengths occur; words of one letter repeated; ties in counts."""
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))): rng.choice([3, 3, 4, 9, 40]) for _ in range(400)}
    words |= {"a" * k: k for k in range(5, 12)}
    got = rows_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), most_stems=most))
    assert got == brute_variants(words)


def test_near_words_share_a_list_whatever_the_dictionary():
    rng = random.Random(3)
    for trial in range(150):
        words = list({"".join(rng.choice("abcd"[: 2 + trial % 3]) for _ in range(rng.randint(1, 10))) for _ in range(50)})
        grams = Counter(w[p : p + q] for w in words for q in range(spelling.QMIN, spelling.QMAX) for p in range(len(w) - q + 1))
        stems = {g for g, n in grams.items() if n >= rng.choice([2, 6, 20])}
        lists = {w: spelling.lists_of(w, stems) for w in words}
        assert all(lists[a] & lists[b] for a in words for b in words if near(a, b))


def test_long_words_have_four_lists(spark):
    """Around the length from which words have halves for grams, and far beyond it."""
    rng = random.Random(12)
    words = {}
    for n in (*range(spelling.LONG - 2, spelling.LONG + 4), 5000):
        for _ in range(6):
            w = "".join(rng.choice("ab") for _ in range(n))
            i = rng.randrange(n)
            words |= {w: 9, w[:i] + "c" + w[i + 1 :]: 4, w[:i] + w[i + 1 :]: 3, w[:i] + "d" + w[i:]: 3, w[: n // 2] + "e" + w[n // 2 :]: 5}
    assert rows_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute_variants(words)
    assert len(spelling.all_lists_of("x" * 100_000, set())) == 4


def test_stems_keep_their_bound(spark):
    words = spark.createDataFrame([(f"{a}{b}common", 3) for a in "abcdefgh" for b in "abcdefgh"], "word string, n long")
    stems = spelling.gram_stems(words, 40)
    assert 0 < len(stems) <= 40 and "com" in stems and "ab" not in stems
    assert spelling.gram_stems(words.limit(0)) == set()


def test_spelling_of_odd_rows(spark, odd):
    again = odd.union(odd).union(odd)
    got = rows_of(spelling.spelling_variants(again))
    counts = plain_counts(ODD * 3)
    assert {w: x[2] for w, x in got.items()} == counts and "words" in counts
    assert spelling.spelling_variants(odd.limit(0)).count() == 0
    roots = spark.createDataFrame([("tokan", "token"), ("token", "token"), ("words", "word")], "word string, root string")
    found = spelling.respelled(odd, roots).select("doc.doc_id", "n_variants").collect()
    assert sorted((r["doc_id"] or 0, r["n_variants"]) for r in found if r["n_variants"]) == [(0, 1)] and len(found) == len(ODD)


def test_chains_of_forms(spark):
    chain = [("aaaaa", 3), ("aaaab", 7), ("aaabb", 15), ("aabbb", 31), ("abbbb", 63), ("bbbbb", 127)]
    got = rows_of(spelling.variants(spark.createDataFrame(chain, "word string, n long")))
    assert {x[1] for x in got.values()} == {"bbbbb"} and got == brute_variants(dict(chain))


# --- alignment ---


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    chars = token_alignment.byte_of_char()
    names = {i: t for t, i in json.load(open(BYTE_FILE))["model"]["vocab"].items()}

    def pieces(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    return a, b, lambda i: bytes(chars[c] for c in names[i]), pieces


def brute_alignment(text, libraries):
    """(a ids, b ids, groups, links) with plain loops."""
    a, b, bytes_a, bytes_b = libraries
    data = (" " + (text or "")).encode()
    ids_a, ids_b = a.encode(data.decode(), add_special_tokens=False).ids, b.encode(text or "")
    if not text or b"".join(map(bytes_a, ids_a)) != data or b"".join(map(bytes_b, ids_b)) != data:
        return [], [], [], []
    ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((bytes_a, ids_a), (bytes_b, ids_b))]
    spans = [list(zip([0, *e[:-1]], e)) for e in ends]
    links, k = [], 0
    for i, (s, e) in enumerate(spans[0]):
        while spans[1][k][1] <= s:
            k += 1
        j = k
        while j < len(ids_b) and spans[1][j][0] < e:
            links.append((ids_a[i], ids_b[j]))
            j += 1
    groups, x, y = [], 0, 0
    for place in sorted(set(ends[0]) & set(ends[1])):
        i, j = ends[0].index(place, x) + 1, ends[1].index(place, y) + 1
        groups.append((ids_a[x:i], ids_b[y:j]))
        x, y = i, j
    return ids_a, ids_b, groups, links


def written(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def brute_rows(texts, libraries):
    found = [brute_alignment(t, libraries) for t in texts]
    n = Counter(x for *_, links in found for x in links)
    most = defaultdict(int)
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    return [(len(a), len(b), len(g), len(x), sum(n[p] == most[p[1]] for p in x), sum(n[p] for p in x), hashlib.sha256(written(g).encode()).hexdigest() if g else "") for a, b, g, x in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_the_given_table(spark, sf_dir, documents, libraries):
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_token_alignment"](spark, sf_dir).collect()}
    assert got == dict(zip([i for i, _ in documents], brute_rows([t for _, t in documents], libraries)))


@pytest.mark.parametrize("sent", [0, 50, 10**6])
def test_alignment_of_odd_rows(spark, odd, libraries, sent):
    """Whether all pairs are sent along, some or none, the rows are the same."""
    out = token_alignment.align_tokenizers(odd, BYTE_FILE, PIECE_MODEL, sent_pairs=sent).select("doc.*", *[F.col(c).alias(f"x_{c}") for c in COLUMNS]).collect()
    assert {(r["n_a"], r["row"]) for r in out} == {("clash", "clash")}
    expected = brute_rows([t for _, t in ODD], libraries)
    assert Counter((r["text"], *(r[f"x_{c}"] for c in COLUMNS)) for r in out) == Counter((t, *x) for (_, t), x in zip(ODD, expected))
    assert [r["x_n_a"] for r in out if r["doc_id"] == 7] == [0]  # holds the marker
    assert token_alignment.align_tokenizers(odd.limit(0), BYTE_FILE, PIECE_MODEL).count() == 0


def test_alignment_of_random_texts(libraries):
    """Odd characters, byte pieces, long texts in lanes, runs of blanks and special tokens' strings."""
    import public_tokenizers

    aligner = token_alignment.Aligner(open(BYTE_FILE, encoding="utf-8").read(), public_tokenizers.PATTERN, open(PIECE_MODEL, "rb").read())
    rng = random.Random(9)
    bits = [*"abtheinéß漢😀 \n\t\r\x0b\x00\x7f ́'.,0123456789", "  ", " the", "tion", "<s>", "</s>", "<|endoftext|>", "'ll", "▁", "　"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice(bits[:-3]) for _ in range(9000)) for _ in range(4)] + ["word " * 3000, "x" * 5000, " " * 3000]
    found = aligner.align(pa.array(texts))
    for k, t in enumerate(texts):
        a, b, groups, links = brute_alignment(t, libraries)
        assert (found["n_a"][k], found["n_b"][k], found["n_groups"][k], found["n_links"][k]) == (len(a), len(b), len(groups), len(links)), t
        assert found["groups"][k].decode() == written(groups)
        assert sorted(found["keys"][k].tolist()) == sorted(i * 32000 + j for i, j in links)


def test_the_fast_encoder_agrees_with_the_library(libraries):
    import public_tokenizers

    side = token_alignment.SideA(open(BYTE_FILE, encoding="utf-8").read(), public_tokenizers.PATTERN)
    rng = random.Random(10)
    chars = [chr(c) for c in range(0x240)]
    texts = [f"{x}{c}{y}" for c in chars for x in ("", " ", "a", "1", ".", "  ", "'") for y in ("", " ", "a", "2", "!", "\n ")]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randint(1, 50))) for _ in range(5000)]
    coded = [t.encode() for t in texts]
    odd = token_alignment.unusual(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
    want = [e.ids for e in libraries[0].encode_batch(texts, add_special_tokens=False)]
    assert not odd.any() and [list(x) for x in side.encode(texts, odd)] == want == [list(x) for x in side.encode(texts)]
    coded = [b" plain text", b" " * 400, b" " + b"x" * 400, " \u0250".encode(), b" x" * 400, b""]
    assert token_alignment.unusual(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])).tolist() == [False, True, True, True, False, False]


def test_lanes_split_long_texts_only_where_both_sides_end():
    a, b = token_alignment.Tokens([np.arange(6)], np.array([3, 2, 4, 1, 5, 5])), token_alignment.Tokens([np.arange(5)], np.array([5, 5, 4, 1, 5]))
    data = np.frombuffer(b"aaa b ccc ddddd eeee"[:20], np.uint8)
    at = token_alignment.merge(a, b, np.array([0]), 20)
    assert list(zip(at[0].tolist(), at[1].tolist())) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (4, 3), (5, 4)]
    split = token_alignment.merge(a, b, np.array([0, 5, 15]), 20)
    assert sorted(zip(split[0].tolist(), split[1].tolist())) == sorted(zip(at[0].tolist(), at[1].tolist()))
    assert token_alignment.lanes(a, b, data, np.array([0, 20])).tolist() == [0]
