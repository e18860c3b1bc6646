"""Spelling variants, whitening and trie encoding against brute force, numpy and the tokenizer library."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from areaflow.llm import bpe_trie, spelling, whitening
from areaflow.llm.queries import op12_embedding_whitening, op13_bpe_trie
from areaflow.llm.tokens import vocabulary_path

RNG = random.Random(17)


# --- spelling ------------------------------------------------------------------------

def brute_variants(rows):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            seen[word] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]

    out, forms, beside = {}, {}, {}
    for w in n:
        beside[w] = [x for x in n if near(w, x)]
        best = min(beside[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            forms[w] = best
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, n[w], len(beside[w]), n.get(forms.get(w)))
    return out


def words_of(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.fixture(scope="module")
def spelt():
    base = ["".join(RNG.choice("abéÿ") for _ in range(RNG.randint(4, 8))) for _ in range(220)]
    base += ["commonprefix" + "".join(RNG.choice("xyz") for _ in range(5)) for _ in range(90)]
    base += ["".join(RNG.choice("xyz") for _ in range(5)) + "commonending" for _ in range(60)]
    rows = []
    for k in range(60):
        words = [RNG.choice(base) for _ in range(120)]
        rows.append((k, RNG.choice([" ", "\n", "-", "1"]).join(w.upper() if RNG.random() < 0.2 and w.isascii() else w for w in words)))
    rows += [(None, " ".join(base[:40])), rows[3], (61, None), (62, ""), (63, "q" * 5000 + " ÀÉÎÕÜ ×÷×÷× àéîõü")]
    rows += [(64 + k, "Great great " * 3 + "grate greats") for k in range(3)]
    return rows


@pytest.mark.parametrize("limit", [4, 100_000])
def test_variants_against_all_pairs(spark, spelt, limit):
    docs = spark.createDataFrame([(*r, "clash", 1, "x") for r in spelt], "doc_id long, text string, word string, n long, root string")
    assert words_of(spelling.variants(docs.repartition(5), limit=limit)) == brute_variants(spelt)


def test_long_lists_are_split(spark, spelt):
    docs = spark.createDataFrame(spelt, "doc_id long, text string").repartition(3)
    lists = spelling._lists(spelling.vocabulary(docs).cache(), 5, 8)
    sizes = lists.groupBy("list").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect()
    assert all(r.n <= 8 or r.r <= 1 for r in sizes) and max(r.n for r in sizes) > 2


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (None, "a b c")], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_scan_of_a_sorted_list(seed):
    rng = random.Random(seed)
    many = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([7, 8]))) for _ in range(150)})
    want = {(i, j) for i, a in enumerate(many) for j, b in enumerate(many) if i < j and 7 in (len(a), len(b))
            and (spelling.shared_prefix(a, b) < 4) and one_edit(a, b)}
    assert set(spelling.near_in(many, 7, 4)) == want


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


# --- whitening --------------------------------------------------------------------------

def fitted(rows):
    x = np.array([np.floor(256 * np.array(v, float)) for _, v in rows])
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    return x, fit, np.linalg.eigh(centred.T @ centred / len(fit))


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, v) for k, v in enumerate((rng.normal(size=(300, 9)) * np.arange(1, 10)).tolist())]
    rows += [(1000 + k, rows[0][1]) for k in range(150)] + [(None, rows[5][1]), rows[7]]
    odd = [(2000, None), (2001, [None] * 9), (2002, [float("nan")] + [0.0] * 8), (2003, [float("inf")] + [0.0] * 8), (2004, [1.0]), (2005, [])]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows + odd], "vec_id long, embedding array<float>, n int, whitened string")
    x, fit, (values, axes) = fitted([(k, np.array(v, np.float32)) for k, v in rows])
    order = np.argsort(-values)[:4]
    got = defaultdict(list)
    for r in whitening.whitened(df.repartition(4)).collect():
        got[r.vec_id].append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[7]) == 2
    want = (x - fit.mean(axis=0)) @ axes[:, order] / np.sqrt(values[order])
    have = np.array([got[k][0].whitened for k, _ in rows])
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-10)
    assert np.allclose(have * np.sign(have[3] * want[3]), want, atol=1e-10)
    first = got[0][0]
    assert np.allclose(first.explained, values[order] / values.sum(), rtol=1e-12) and first.n == len(fit)
    sums = [int(v) for v in fit.sum(axis=0)]
    assert int(first.deviation) == sum((len(fit) * int(a) - s) ** 2 for a, s in zip(x[0], sums, strict=True))
    assert 0 <= first.identity_error < 1e-9


def test_whitening_of_equal_and_missing_eigenvalues(spark, tmp_path):
    points = [[a, b, c, 0.0, 7.0] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-2.0, 2.0)]
    df = spark.createDataFrame(list(enumerate(points)), "vec_id long, embedding array<double>")
    rows = whitening.whitened(df).collect()
    assert all(len(r.whitened) == 3 for r in rows)  # two entries do not vary
    assert np.allclose(rows[0].explained, [4 / 6, 1 / 6, 1 / 6]) and rows[0].identity_error < 1e-12
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op12_embedding_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted((r.vec_id, r.component) for r in out.collect()) == [(k, c) for k in range(8) for c in (1, 2, 3)]


def test_whitening_without_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert whitening.whitened(df).count() == 0


def test_whitening_of_great_entries(spark):
    rows = [(k, [1e30 * (k % 2), float(k), -1e15 * k]) for k in range(6)]
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 6 and all(np.isfinite(r.whitened).all() for r in out)


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(-10 ** 6, 10 ** 6, (6, 6)).astype(object)
    m = (a @ a.T).tolist()
    poly = whitening.characteristic(spark, m)
    # Faddeev-LeVerrier in integers.
    want, b = [1], [[int(i == j) for j in range(6)] for i in range(6)]
    for k in range(1, 7):
        ab = (np.array(m, object) @ np.array(b, object))
        c = -sum(ab[i][i] for i in range(6)) // k
        want.append(c)
        b = (ab + np.array([[c * (i == j) for j in range(6)] for i in range(6)], object)).tolist()
    assert poly == want[::-1]


def test_roots_that_almost_meet():
    roots = [3 * 10 ** 12, 3 * 10 ** 12 + 1, 7, 7, 7, 0]
    poly = [1]
    for r in roots:
        poly = [(poly[k - 1] if k else 0) - r * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    found = whitening.greatest_roots(poly, 6, sum(roots))
    assert [round(k / 2 ** e) if e < 1000 else None for k, e in found] == [3 * 10 ** 12 + 1, 3 * 10 ** 12, 7, 7, 7]


# --- trie encoding --------------------------------------------------------------------------

TEXTS = ["", " ", "a" * 3000, "x <|endoftext|> y<|endoftext|>", "日本語 текст    x\n\n\t  y", "é" * 700 + "😀" * 9, "\x00\x1c x \x85\xa0 b",
         "don't we'll 3.14  --  !!\n\n\n", "".join(RNG.choice("aab") for _ in range(3000)),
         "".join(chr(RNG.randint(32, 0x2fff)) for _ in range(4000)), "".join(RNG.choice("0123456789 .,=#é") for _ in range(6000)),
         " ".join("".join(RNG.choice("etaoinshrdlu") for _ in range(RNG.randint(1, 30))) for _ in range(4000))]


@pytest.mark.parametrize("small", [False, True])
def test_trie_against_the_library(monkeypatch, small):
    from tokenizers import Tokenizer

    if small:
        for name, value in (("REMEMBERED", 20), ("TRIE_BYTES", 50), ("LONG_WORD", 6), ("SLICE", 100)):
            monkeypatch.setattr(bpe_trie, name, value)
    library, own = Tokenizer.from_file(vocabulary_path()), bpe_trie.TrieEncoder(vocabulary_path())
    for text, ids in zip(TEXTS, own.encode(TEXTS), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids.tolist()) == library.decode(want, skip_special_tokens=False)
    assert own.decode([10 ** 6, 64]) == "a"


def test_every_token_ends_its_own_bytes():
    own = bpe_trie.TrieEncoder(vocabulary_path())
    sample = sorted(own.merges.parts)[::97]
    assert all(own.alone(own.merges.bytes[t]) == (t,) for t in sample)


def test_encoded_table(spark, tmp_path):
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "x"), (99, None), (0, ""), (5, TEXTS[5])]
    spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, ids string, row_key int").repartition(3).write.parquet(
        f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_bpe_trie(spark, str(tmp_path)).collect()), key=str)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_trie.decoded(bpe_trie.encoded(empty)).count() == 0
