"""The stages one after the other, each on all that the one before kept."""

import random
import re
from collections import defaultdict
from math import ceil
from zlib import crc32

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from areaflow.llm import decontaminate
from areaflow.llm.common import KEY, keyed
from areaflow.llm.queries import QUERIES
from areaflow.llm.tokens import vocabulary_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def _prose(rng, n):
    return " ".join("".join(rng.choice(["an", "ti", "or", "he", "lu", "ré", "sk", "um"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _lines(rng, n, words=11):
    return "\n".join(_prose(rng, words) for _ in range(n))


def _corpus(rng):
    """Documents of every kind that a stage acts on, clean ones among them, and the benchmark."""
    items = [_prose(rng, 30), "  ".join(_prose(rng, 25).split()), _prose(rng, 40)]
    shared = _lines(rng, 6)
    clean = [_prose(rng, 90) for _ in range(8)] + [_lines(rng, 9) for _ in range(4)]
    near = clean[0].split()
    near[40] = "other"
    nearer = [*near[:60], "more", *near[60:]]
    edited = items[2][:30] + "Q" + items[2][31:60] + items[2][62:]
    texts = [*clean, " ".join(near), " ".join(nearer),  # a chain of near copies
             clean[3],  # a copy: its only line goes
             _lines(rng, 5) + "\n" + shared, _lines(rng, 6) + "\n" + shared + "\n" + _lines(rng, 3), _prose(rng, 15) + "\n" + shared + "\nend",
             _prose(rng, 40) + " " + items[0] + " " + _prose(rng, 40), _prose(rng, 30) + "\n" + items[1].upper() + "\n" + _prose(rng, 30),
             _prose(rng, 60) + " " + edited, _prose(rng, 20), "la la la " * 40, None, "", _prose(rng, 4000), _prose(rng, 900)]
    rows = [(i * 3 % 29 + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, _prose(rng, 70), None, "s", 0)]
    return rows, items


def _good(text):
    words = WORD.findall(text.encode())
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i:i + 3])].append(i)
    repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words) >= 50 and 100 * len(repeated) <= 50 * len(words)


def _without_repeats(rows):
    """Every run of lines with 20 words, by comparing all with all that came before."""
    seen, out = set(), []
    for doc, key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for a in range(len(at)):
            for b in range(a, len(at)):
                run = tuple(lines[i].strip() for i in at[a:b + 1])
                if sum(len(x.split()) for x in run) >= 20:
                    if run in seen:
                        gone.update(at[a:b + 1])
                    seen.add(run)
        out.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def _one_of_each(rows):
    """All pairs, and the components of the links."""
    sets = []
    for _, text in rows:
        w = WORD.findall(text.encode().lower())
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return [min((r for g, r in zip(group, rows, strict=True) if g == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in sorted(set(group))]


def _leaks(text, item):
    """Whether a part of the text is within a tenth of the item's length in edits: the whole matrix, row by row."""
    t, m = np.asarray(decontaminate.folded(text)), np.asarray(decontaminate.folded(item))
    steps = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, int)
    for c in m:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (t != c))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min()) <= len(m) // 10


def test_run_against_brute_force(spark, tmp_path):
    rows, items = _corpus(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    good = [(r.doc_id, r[KEY], r.text) for r in keyed(docs).collect() if _good(r.text)]
    lined = _without_repeats(good)
    single = _one_of_each(lined)
    want = {doc: text for doc, text in single if not any(_leaks(text, i) for i in items)}
    assert (len(rows), len(good), len(single), len(want)) == (28, 24, 22, 19)  # every stage has something to do

    encode = Tokenizer.from_file(vocabulary_path()).encode
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    total = 0
    for doc, text in want.items():
        ids = [*encode(text, add_special_tokens=False).ids, 2]
        parts = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(ceil(len(ids) / 1024)))
        at = 0
        for r in parts:
            raw = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32) == (at, crc32(raw)) and 0 < r.length <= 1024
            at += r.length
        assert at == len(ids)
        total += at
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= ceil(total / 1024) + 1


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
