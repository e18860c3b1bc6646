"""Text operators against brute-force versions, on a small table with every odd case."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from areaflow.llm import chats, decontaminate, jaccard, lines, packing, quality, secrets, suffixes, token_files, toxicity
from areaflow.llm.tokens import encoder, vocabulary_path

SCHEMA = "doc_id long, text string, source string, spans string, row_key string, kept string, n_chars long"
RNG = random.Random(11)


def prose(n):
    return " ".join("".join(RNG.choice(["an", "ti", "or", "he", "lu", "ré"]) for _ in range(RNG.randint(1, 4))) for _ in range(n))


def _texts():
    base = [prose(90) for _ in range(6)]
    shared = prose(60)
    near = base[0].split()
    near[40] = "other"
    lined = "\n".join(prose(12) for _ in range(6))
    return [*base, None, "", "one", "one", "two words here", base[1], " ".join(near), prose(30) + " " + shared + " " + prose(9),
            prose(20) + shared + prose(20), lined, prose(25) + "\n" + lined + "\n" + prose(5), "a" * 700, prose(4000),
            "x  y\n\n z \t", "ab " * 300]


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "clash", "clash", "clash", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(None, TEXTS[2], None, None, None, None, None), rows[3], (3, TEXTS[4], "s0", "", "", "", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(docs):
    """Rows in the order of the operators: null first, then id, then row key; equal rows once."""
    from areaflow.llm.common import KEY, keyed

    rows = {(r["doc_id"], r[KEY], r["text"]) for r in keyed(docs).collect()}
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_suffixes_against_every_string(docs, none):
    seen, want = set(), []
    for doc, _, text in listed(docs):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            x = raw[s:s + 100]
            if x in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(x)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = {tuple(r) for r in suffixes.deduplicated(docs).collect()}
    assert got == set(want)
    assert suffixes.deduplicated(docs).count() == docs.count()
    assert suffixes.deduplicated(none).count() == 0


def test_suffixes_of_a_very_common_gram(spark, docs):
    """Grams beyond the limit are compared as single strings; the result is the same."""
    line = prose(40)
    common = spark.createDataFrame([(100 + k, f"{prose(8)}{line}{prose(8)}" + (f" {prose(3)}{line}" if k % 3 == 1 else "")) for k in range(40)],
                                   "doc_id long, text string")
    some = docs.select("doc_id", "text").unionByName(common)
    want = sorted(suffixes.deduplicated(some).collect(), key=str)
    assert sorted(suffixes.deduplicated(some, limit=2).collect(), key=str) == want
    assert {r["n_removed"] > 0 for r in want if (r["doc_id"] or 0) >= 100} == {True, False}
    parts = suffixes._strings
    assert parts(b"h" * 8 + b"R" * 100 + b"l" * 3 + b"\3", (0, 0, 5, 3, 3))[0] == (5, b"lll" + b"R" * 97)


def test_a_very_common_gram_leaves_a_row_a_context(spark):
    """What leaves the merge follows the contexts, not their strings; held at once or a left length at a time, the same bytes repeat."""
    line = prose(40)
    texts = {k: f"{prose(8)}{line}{prose(8)}" for k in range(40)}
    starts = {k: suffixes.runs(t.encode())[1].tolist() for k, t in texts.items()}
    rows = spark.createDataFrame([(k, k, t, starts[k]) for k, t in texts.items()], "doc_id long, row_key long, text string, starts array<long>")
    runs = suffixes._sorted_runs(rows, 4)
    met = suffixes._meet(runs, 4, 2).filter("spans is null").collect()
    assert 0 < len(met) <= sum(len(v) for v in starts.values())
    assert all(texts[r.doc_id].encode()[r.start:r.start + len(r.strings)] == r.strings for r in met)

    def covered(held):
        packed = suffixes._meet(runs, 4, 1 << 16, held, 3).toPandas()
        assert len(packed) <= 4 * 3  # ranges by buckets, however many documents
        return {(r.doc_id, b) for r in suffixes._by_document(packed).itertuples()
                for lo, hi in np.frombuffer(r.spans, "<u4").reshape(-1, 2).tolist() for b in range(lo, hi)}

    assert covered(0) == covered(2_000) != set()


def test_suffix_ranges_are_even_and_ordered():
    h = suffixes.runs(np.random.default_rng(3).integers(97, 123, 3_000_000, np.uint8).tobytes())[0]
    part = suffixes.ranges_of(np.sort(h), 50)
    assert (np.diff(part) >= 0).all()
    share = np.bincount(part, minlength=50) / len(h) * 50
    assert 0.9 < share.min() and share.max() < 1.1
    ends = np.array([0, (1 << 64) - 1], np.uint64)
    assert suffixes.ranges_of(ends, 7).tolist() == [0, 6] and suffixes.ranges_of(ends, 1).tolist() == [0, 0]


@pytest.mark.parametrize("runs", [1, 2, 5])
def test_loser_tree(runs):
    rows = sorted(bytes(RNG.choice(b"ab") for _ in range(RNG.randint(0, 9))) for _ in range(200))
    split = [sorted(rows[k::runs]) for k in range(runs)]
    coded = [[(x, suffixes.shared(x, p, 0), None) for p, x in zip([b"", *r], r, strict=False)] for r in split]
    out = list(suffixes.merged([iter(c) for c in coded]))
    assert [x for x, _, _ in out] == rows
    assert [k for _, k, _ in out] == [suffixes.shared(a, b, 0) for a, b in zip([b"", *rows], rows, strict=False)]


def test_jaccard_groups(docs, none):
    rows = listed(docs)
    sets = []
    for _, _, text in rows:
        w = text.encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, r in enumerate(rows):
        least.setdefault(find(k), [])
        if r[0] is not None:
            least[find(k)].append(r[0])
    want = {(r[0], len(sets[k]), min(least[find(k)], default=None)) for k, r in enumerate(rows)}
    got = jaccard.joined(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(r) for r in got} == want and len(got) == docs.count()
    assert jaccard.joined(none).count() == 0
    stays = jaccard.one_of_each(docs)
    assert stays.columns == docs.columns
    assert len(least) == len({(r["doc_id"], r["text"]) for r in stays.collect()})


def chance_sets(n, count, seed):
    """Sets of n shingles of which two neighbours share one, by chance."""
    rng = np.random.default_rng(seed)
    out = [rng.integers(0, 2**64, n, np.uint64) for _ in range(count)]
    for x, y in zip(out, out[1:], strict=False):
        y[0] = x[1]
    return [np.unique(x) for x in out]


def test_long_sets_that_meet_by_chance_make_no_group(spark):
    sets = chance_sets(3000, 30, 5)
    sets[20] = np.unique(np.append(sets[10][:2900], sets[20][:100]))  # near
    sets[21] = np.unique(sets[10].copy())
    sets[21] = sets[21][sets[21] != sets[21][7]]  # near, of another size
    rows, records = [], []
    for c, x in enumerate(sets):
        rows.append((c, len(x), bytearray(jaccard.counted(x).tobytes()), None))
        at = np.argsort(x >> np.uint64(7), kind="stable")[:len(x) - -(-80 * len(x) // 100) + 1]
        for p, h in enumerate(x[at]):
            records.append((h, c, len(x), p))
        for q, y in enumerate(sets):  # met at the first places, as where counters tell nothing of rarity
            if abs(q - c) == 1:
                records += [(h, c, len(x), 0) for h in np.intersect1d(x, y)]
    rec = np.array(records, jaccard._POSTING)
    postings = spark.createDataFrame([(b, bytearray(zlib.compress(rec[rec["h"] % 3 == b].tobytes()))) for b in range(3)],
                                     "bucket int, records binary")
    classes = spark.createDataFrame(rows, "c long, n int, parts binary, coarse binary").cache()
    lists = jaccard._lists(postings).cache()
    found = {tuple(sorted(r)) for r in jaccard._near(lists, classes).collect()}
    assert found == {(10, 20), (10, 21), (20, 21)}
    pairs = [(r["g"], r["c"]) for r in lists.filter("size = 0").collect()]
    assert len(pairs) == len(set(pairs)) and {(3, 4), (10, 20)} <= set(pairs)


def test_no_pair_at_the_threshold_is_filtered():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 3000))
        x = np.unique(rng.integers(0, 2**64, n, np.uint64))
        less = int(rng.integers(0, len(x) // 5 + 1))
        more = int(rng.integers(0, (len(x) - less) * 100 // 80 - len(x) + 1)) if less * 5 < len(x) else 0
        y = np.unique(np.append(rng.permutation(x)[less:], rng.integers(0, 2**64, max(more, 0), np.uint64)))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 80 * (len(x) + len(y) - shared):
            continue
        a, b = sorted((x, y), key=len)
        s, t = jaccard.counted(a).astype(int), jaccard.counted(b).astype(int)
        k = min(len(s), len(t))
        apart = abs(jaccard.folded(s, k) - jaccard.folded(t, k)).sum()
        assert (len(a) + len(b) - apart) // 2 >= jaccard.needed(len(a), len(b))
        order = np.unique(np.append(a, b))
        p, q = np.searchsorted(a, order), np.searchsorted(b, order)
        first = np.flatnonzero(np.isin(order, a) & np.isin(order, b))[0]
        assert jaccard.tried(*(np.array([v]) for v in (len(a), p[first], len(b), q[first]))).all()


def test_short_lists_of_near_copies_stay_lists(spark):
    members = 8
    rec = np.array([(h, c, 100, 2) for h in (1, 2, 3) for c in range(members)] + [(1, 50, 400, 3)], jaccard._POSTING)
    got = jaccard._lists(spark.createDataFrame([(0, bytearray(zlib.compress(rec.tobytes())))], "bucket int, records binary")).collect()
    assert sorted(r["c"] for r in got) == list(range(members)) and {r["size"] for r in got} == {members}
    assert len({r["g"] for r in got}) == 1


def test_only_wanted_texts_travel(spark):
    docs = spark.createDataFrame([(k if k % 7 else None, f"text number {k}") for k in range(2000)] + [(5, None)], "doc_id long, text string")
    some = jaccard.keyed(docs).filter("text in ('', 'text number 0', 'text number 77', 'text number 1999')")
    got = jaccard._marked(docs, some.select("doc_id", jaccard.KEY)).collect()
    assert {r["text"] for r in some.collect()} <= {r["text"] for r in got} and len(got) < 10
    assert jaccard._marked(docs, some.filter("false").select("doc_id", jaccard.KEY)).count() == 0


def test_lines_against_all_runs(docs, none):
    rows, seen, want = listed(docs), {}, {}
    for doc, key, text in rows:
        number, digests, words = lines.line_digests(text)
        flat = [digests[16 * k:16 * k + 16] for k in range(len(words))]
        gone = set()
        for lo in range(len(flat)):
            for hi in range(lo, len(flat)):
                run = tuple(flat[lo:hi + 1])
                if sum(words[lo:hi + 1]) >= lines.MIN_WORDS and run in seen:
                    gone.update(number[lo:hi + 1])
                seen.setdefault(run, (doc, key))
        want[text] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text
    out = lines.without_repeats(docs).collect()
    assert len(out) == docs.count()
    keep = {text for text in want if sum(t == text for _, _, t in rows) == 1}
    texts = [r["text"] or "" for r in out]
    assert all(want[t] in texts for t in keep)
    assert lines.without_repeats(docs).columns == docs.columns and lines.without_repeats(none).count() == 0


def test_leaks(spark, docs, none):
    item = prose(30)
    at = next(i for i in range(50, 80) if item[i].isascii() and item[i].isalpha())  # edits count bytes
    near = item[:at] + "Q" + item[at + 1:]
    more = spark.createDataFrame([(100, prose(50) + " " + item + " " + prose(50)), (101, "y " + near), (102, item[:60]), (103, None)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "Hi!")], "item_id long, text string")
    got = decontaminate.leaks(more, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got} == {(100, 1, 0), (101, 1, 1)}
    assert {r["doc_id"] for r in decontaminate.clean_documents(more, bench).collect()} == {102, 103}
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(docs, bench).columns == docs.columns


def test_leaks_at_the_stated_limit(spark):
    items = {5: "Über dürre Wälder ziehen Nebelfähren, während Straßen ruhig schlafen", 6: "the seven quick owls", 7: "winter tales"}
    near = {6: "tha seven qucik owls".replace("qucik", "quyck"), 7: "winter tades"}
    letters = "abcdefghijklmnopqrstuvwxyz" * 9
    items |= {m: "".join(letters[(7 * i + i * i // 26 + m) % len(letters)] for i in range(m)) for m in (47, 100, 233, 1000)}
    for m in (47, 100, 233, 1000):
        x, e = list(items[m]), m // 10
        for k in range(e):
            x[k * m // e + m // e // 2] = "0"
        near[m] = "".join(x)
    near[5] = items[5].upper()
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame([(m, "zq " + x + " qz") for m, x in near.items()], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(5, 5, 0), (6, 6, 2), (7, 7, 1), *[(m, m, m // 10) for m in (47, 100, 233, 1000)]}


def test_token_files(spark, docs, none, tmp_path):
    tokenizer = encoder(vocabulary_path()).tokenizer
    at, want = 0, []
    from areaflow.llm.common import KEY, keyed

    for r in sorted(keyed(docs).collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[KEY])):
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    token_files.write_tokens(docs, f"{tmp_path}/a")
    assert sorted(map(tuple, token_files.read_tokens(spark, f"{tmp_path}/a", with_ids=False).collect()), key=lambda r: r[1]) == want
    one = token_files.read_tokens(spark, f"{tmp_path}/a", [0]).collect()
    assert [tokenizer.decode(r["ids"][:-1]) for r in one] == [TEXTS[0]]
    assert token_files.encoded(none).count() == 0


def test_packing(docs, none):
    out = packing.packed(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:k]) for k, (o, _) in enumerate(places))
        assert sum(n for _, n in places) <= 1024
    assert len(by) == -(-sum(r["length"] for r in out) // 1024)
    long = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == 18)
    assert all(n == 1024 for _, _, n in long[1:]) and long[1][1] == long[0][2]
    assert packing.packed(none).count() == 0


def test_local_search_empties_bins():
    lengths = [7, 5, 4, 3, 6, 5]
    bins = packing.local_search([[0], [1], [2, 3], [4], [5]], lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(6)) and len(bins) == 3


@pytest.mark.parametrize("many", [1, 200])
def test_local_search_tries_every_bin(many):
    lengths = [504] * 6 * many + [258] * 6 * many + [254] * 6 * many + [242] * 12 * many  # 9 bins hold what best fit puts into 11
    bins = packing.local_search(packing.best_fit(lengths, 1000), lengths, 1000)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and len(bins) <= 10 * many
    fill = [sum(lengths[i] for i in b) for b in bins]
    assert max(fill) <= 1000
    kinds = {tuple(sorted(lengths[i] for i in b)) for b in bins}
    for giver in kinds:
        for taker in kinds:
            for x in giver:
                for back in [(), *[(y,) for y in taker], *[(y, z) for k, y in enumerate(taker) for z in taker[:k]]]:
                    gain = x - sum(back)
                    assert (not 0 < gain <= 1000 - sum(taker) or sum(taker) + gain <= sum(giver)
                            or giver == taker and sum(giver in (tuple(sorted(lengths[i] for i in b)),) for b in bins) == 1)


def test_quality(docs, none):
    out = {(r["doc_id"], r["n_words"]): r for r in quality.judged(docs).collect()}
    assert out[(6, 0)]["base_failed"] and not out[(6, 0)]["kept"]
    assert quality.measure("a b c\na b c\n \nx|y é") == (8, 10, 1, 1, 6)
    assert quality.measure("") == (0, 0, 0, 0, 0)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {0, 1} <= {r["doc_id"] for r in kept.collect()}
    assert quality.keep_good(none).count() == 0


def test_quality_of_hosts(spark):
    """A bad host's documents must pass every rule; the same documents at a good host, or at one with a single page, stay."""
    words = [f"w{i}" for i in range(60)]
    plain = " ".join(words)
    noisy = " ".join(words[:40] + ["#"] * 20)  # one symbol for three words, far from the base rules
    rows = [(i, noisy, "bad") for i in range(80)] + [(100 + i, plain, "bad") for i in range(20)]
    rows += [(1000 * h + i, noisy if i == 7 else plain, f"good{h}") for h in range(1, 11) for i in range(100)] + [(20000, noisy, "single")]
    out = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert {d for d, r in out.items() if not r["kept"]} == set(range(80))
    assert out[0]["worst"] > 0.5 > out[1007]["worst"]
    # the rate of a host by hand: failures and documents, with the prior fitted to the hosts
    n, fails, hosts = 1101, [80, *[1] * 10, 1], [100, *[100] * 10, 1]
    mean = sum(fails) / n
    spread = sum(f * f / h for f, h in zip(fails, hosts, strict=True)) / n - mean ** 2
    between = spread - mean * (1 - mean) * 11 / n
    weight = min(max(mean * (1 - mean) / between - 1, 2.0), n)
    assert out[0]["worst"] == pytest.approx((80 + mean * weight) / (100 + weight))
    assert out[20000]["worst"] == pytest.approx((1 + mean * weight) / (1 + weight))
    single = (1 + mean * weight) / (1 + weight) > 0.5
    assert out[20000]["kept"] != single


def test_toxicity(spark, none):
    rows = [(i, prose(20) + (" jerk them" if i % 3 == 0 else " jerk" if i % 3 == 1 else " them")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(1, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(400) if out[i]["held_out"]]
    assert held and sum(out[i]["predicted"] == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert out[None]["held_out"] and 0 <= out[900]["score"] <= 1
    assert toxicity.toxicity(none, labels).count() == 0


def test_toxicity_of_pairs_alone():
    """Two terms that say nothing alone, and a rare one that only toxic rows hold."""
    rng = np.random.default_rng(3)
    sets = [{10 + k % 2, 20 + k // 2 % 2, *(100 + rng.integers(0, 300, 15)).tolist()} for k in range(800)]
    labels = np.array([int(k % 2 == k // 2 % 2) for k in range(800)])
    machine = toxicity.fit(sets[:600], labels[:600], 0.5)
    right = [(machine.score(s) >= 0.5) == bool(y) for s, y in zip(sets[600:], labels[600:], strict=True)]
    assert np.mean(right) >= 0.9
    rare = [{1, 2, 3} | ({9} if k < 10 and k % 2 else set()) for k in range(600)]
    machine = toxicity.fit(rare, np.arange(600) % 2, 0.5)
    assert machine.score({1, 2, 3, 9}) > machine.score({1, 2, 3}) + 0.1


def test_secrets_layers():
    from base64 import b64encode
    from gzip import compress
    from urllib.parse import quote

    secret = "password=Zx81hhQQ22lm"
    assert secrets.scan("hello " + secret)[1] == [("assign", 6, 27)]
    assert secrets.scan("token: short") == ([], [], 0, 0)[:1] + ([], 0, 0)
    wrapped = "q " + b64encode(compress(("my " + quote(secret, safe="") + " ").encode())).decode() + " z"
    base, spans, layers, _ = secrets.scan(wrapped)
    assert (base, spans) == ([], [("assign", 2, len(wrapped) - 2)]) and layers == 2
    inside = "see x%20" + quote(secret, safe="") + "%20y"
    assert [inside[a:b] for _, a, b in secrets.scan(inside)[1]] == [quote(secret, safe="")]
    assert secrets.scan("0" * 23 + " " + "a" * 24)[0] == [("hex", 24, 48)]
    assert secrets.scan("%2525252525")[1] == []


@pytest.mark.parametrize("text", [
    "%70assword: hunter22x", '"p%61ssword": "hunter22x"', "password%3D hunter22x", r'"\u0070assword": "hunter22x"',
    "%70assword: %68unter22x", r"p%61ssword: \x68unter22x"])
def test_secrets_beside_plain_text(text):
    _, spans, _, _ = secrets.scan("so, " + text + ", it is")
    assert [("so, " + text)[lo:hi].strip('"') for k, lo, hi in spans if k == "assign"] == [text.strip('"')]


def test_secrets_in_compressed_bytes():
    from base64 import b64encode, encodebytes
    from gzip import compress
    from urllib.parse import quote, quote_plus

    secret = b"password=Zx81hhQQ22lm"
    noise = bytes(RNG.choice(b"abcdefgh, ") for _ in range(300))
    far = b64encode(compress(b"some words, " * (20 << 20 >> 3) + secret)).decode()
    members = b64encode(compress(b"one, ") + compress(secret)).decode()
    twice = b64encode(compress(compress(noise + secret))).decode()
    packed = compress(noise + b" " + secret)
    forms = [far, members, twice, quote(packed), quote_plus(packed), "".join(f"%{c:02x}" for c in packed),
             "".join(f"\\x{c:02x}" for c in packed), repr(packed)[2:-1], "".join(f"&#{c};" for c in packed),
             encodebytes(packed).decode().strip(), encodebytes(noise + b", " + secret).decode().strip()]
    for k, x in enumerate(forms):
        base, spans, _, cut = secrets.scan("see, " + x + "\nlast words")
        assert (base, cut) == ([], 0) and ("assign", 5, 5 + len(x)) in spans, (k, spans, x[:100])
    assert secrets.scan(b64encode(packed[:-60]).decode())[3] == 1


def test_secrets_in_further_layers():
    import bz2
    import lzma
    from base64 import b64encode
    from gzip import compress
    from zlib import compress as deflate

    secret = b"password=Zx81hhQQ22lm"
    noise = bytes(RNG.choice(b"abcdefgh, ") for _ in range(300))
    whole = [b64encode(x).decode() for x in (
        bz2.compress(noise + secret), lzma.compress(noise + secret), bz2.compress(noise) + bz2.compress(secret),
        compress(lzma.compress(bz2.compress(noise + secret))), secret.decode().encode("utf-16-le"), secret.decode().encode("utf-16-be"),
        bz2.compress(b"some words, " * (20 << 20 >> 3) + secret))]
    escapes = ["".join(f"%u{c:04x}" for c in secret), "".join(f"\\U{c:08x}" for c in secret), "password&equals;Zx81hhQQ22lm",
               "password&colon;&quot;Zx81hhQQ22lm", "p%u0061ssword=Zx81hhQQ22lm"]
    for k, x in enumerate([*whole, *escapes]):
        base, spans, _, cut = secrets.scan("see, " + x + ", last")
        assert cut == 0 and ("assign", 5, 5 + len(x)) in set(spans) - set(base if k != 11 else []), (k, spans, x[:100])
    for before in ("a", "ab", "abc", "abcd", "path/to/", "id_", "x-y-", "Zm9v"):
        for inner in (noise[:9] + b" " + secret, compress(noise + secret), deflate(noise + secret), bz2.compress(noise + secret), lzma.compress(secret)):
            x = "see, " + before + b64encode(inner).decode() + ", last"
            _, spans, _, _ = secrets.scan(x)
            lo = 5 if inner[0] in b"abcdefgh, " else 5 + len(before)  # letters before may decode to text as well
            assert any(k == "assign" and lo <= a < b <= len(x) - 6 for k, a, b in spans), (before, inner[:4], spans)
    assert secrets.scan(b64encode(bz2.compress(noise + secret)[:-9]).decode())[3] == 1
    assert secrets.scan("AT&T; &nosuch; &amp;amp;")[1] == [] and secrets.scan("A" * 5000)[1] == []


def test_secrets_table(docs, none):
    assert secrets.found(docs).count() == docs.count() and secrets.found(none).count() == 0


def test_chats(spark, none):
    hard = r"\### Assistant: </turn> ok ####\\"
    rows = [(c, t, r, x) for c, turns in {
        1: [("user", "hi"), ("assistant", "hello")], 2: [("user", "hi"), ("assistant", "hello"), ("user", hard)],
        3: [("user", "hi"), ("assistant", hard), (None, None)], 4: [("user", "hi"), ("assistant", "hello")],
        5: [("a: b", "### x"), ("assistant", "")], None: [("assistant", hard)]}.items() for t, (r, x) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = defaultdict(list)
    for c, _, r, x in rows:
        want[c].append((r or "", x or ""))
    got = {r["conv_id"]: r for r in chats.formatted(turns).collect()}
    assert set(got) == set(want)
    for c, parts in want.items():
        loss = "".join(x for r, x in parts if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in parts).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(parts), len(loss))
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chats.formatted(turns.limit(0)).count() == 0


def test_chats_share_tokens_once(spark, tmp_path):
    rows = [(c, t, "user", x) for c in range(4) for t, x in enumerate(("same start", "same next", f"own {c % 3}"))]
    chats.write_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), f"{tmp_path}/c")
    segments = spark.read.parquet(f"{tmp_path}/c/segments").orderBy("start").collect()
    assert len(segments) == 3 and [len(s["attends"]) for s in segments] == [0, 1, 1]
    ends = [s["start"] + s["n_tokens"] for s in segments]
    assert [s["start"] for s in segments] == [0, *ends[:-1]]
    assert all(s["position"] == s["attends"][0]["stop"] for s in segments[1:])


def test_decontamination_against_every_alignment():
    """Each text with each item by the whole matrix: found exactly when some run of the text is within the budget."""
    rng = random.Random(5)
    items = [(k, decontaminate.folded(prose(n).replace("é", "e"))) for k, n in enumerate([9, 14, 20, 30, 45])]
    letters = b"abcdefghijklmnopqrstuvwxyz "

    def edited(x, n):
        x = bytearray(x)
        for _ in range(n):
            at, kind = rng.randrange(len(x)), rng.randrange(3)
            x[at:at + (kind != 0)] = b"" if kind == 1 else bytes([rng.choice(letters)])
        return bytes(x)

    def least(item, text):
        row = np.zeros(len(text) + 1, int)
        for c in item:
            new = [row[0] + 1]
            for j, t in enumerate(text):
                new.append(min(row[j] + (c != t), row[j + 1] + 1, new[-1] + 1))
            row = np.array(new)
        return int(row.min())

    table, hits = decontaminate.Items(items, 0.1), 0
    for trial in range(40):
        k, item = items[trial % len(items)]
        e = decontaminate.budget(len(item), 0.1)[0]
        part = edited(item.tobytes(), max(0, e - trial % 3 + 1))
        if trial % 8 == 0:
            part = part[rng.randrange(e + 2):]  # the item begins before the text does
            text = decontaminate.folded(part.decode())
        else:
            text = decontaminate.folded(prose(rng.randint(0, 12)) + " " + part.decode() + " " + prose(rng.randint(0, 12)))
        got = {i: cost for i, cost, _, _ in table.regions(text.tobytes().decode())}
        want = {i: least(x, text) for i, x in items}
        want = {i: c for i, c in want.items() if c <= decontaminate.budget(len(items[i][1]), 0.1)[0]}
        assert got == want, trial
        hits += k in want
    assert 10 < hits < 40


def test_decontamination_of_short_items_and_long_texts():
    table = decontaminate.Items([(1, decontaminate.folded("Tiny")), (2, decontaminate.folded(prose(25)))], 0.1)
    assert [r[2:] for r in table.regions("tiny, tiny words; untiny TINY")] == [(0, 4), (5, 9), (23, 27)]
    item = table.items[1][1].tobytes().decode()
    text = prose(30_000) + " " + item + " " + prose(10) + " " + item
    found = [r for r in table.regions(text) if r[0] == 2]
    assert [r[1] for r in found] == [0, 0]
    assert {decontaminate.folded(text)[s:t].tobytes().decode() for _, _, s, t in found} == {item}
