"""BPE token ids of whole texts from a trie of their distinct words, and texts back from ids.

The encoding of a word ends in one token, and what stands before that token is again an encoding. So it
is enough to know, for every prefix, the last token of its encoding: of all tokens that end the prefix it is
the one whose seam with the last token of the rest holds, that is, merging never crosses it. The
distinct words of a slice of text go into a trie; a depth-first walk carries the last token of each prefix and the
state of an automaton that finds the tokens ending there. A prefix that many words share is settled once.

Texts are cut into words as the tokenizer file says, and its added tokens are found in texts first, as the
library does. A file that is not byte-level BPE with merges in order of their parts is refused.

Defined results: a null text is empty; an empty text has no ids; rows are kept as they are, repeated rows and null ids of
documents included; only ``doc_id`` and ``text`` are read, so other columns cannot clash. Truncation and
padding of the file are not applied. Ids outside the vocabulary decode to nothing, null ids to null, bytes that are not UTF-8
to replacement characters.

Each task works on its own texts: nothing is shuffled or gathered. What a worker remembers (``REMEMBERED`` words), a
trie (``TRIE_BYTES`` of words) and the words of a slice are bounded, also within one very long text; that bounds memory and
not results.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.llm.common import KEY, keyed, map_arrow
from areaflow.llm.tokens import visible_bytes, vocabulary_path

#: Words whose ids a worker remembers before it starts anew; it keeps the words before those until then.
REMEMBERED = 300_000
#: Bytes of new words in one trie.
TRIE_BYTES = 1 << 19
#: Words longer than this many bytes are walked alone, without nodes.
LONG_WORD = 512
#: Words that are looked up at once.
SLICE = 400_000
#: Characters whose classes are the same in every Unicode version; other texts are cut by the library.
_SETTLED = regex.compile(r"[\t-\r\x20-\x7e\xa1-ɏ]*")
#: Key of a trie node under which the word that ends there stands; bytes are the other keys.
_WORD = -1
_NEVER = 1 << 30


class Merges:
    """The tokens of a byte-level BPE file: their bytes, how they are merged, and which may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                               "byte_fallback", "ignore_merges"))
        if not (model["type"] == "BPE" and plain and spec["normalizer"] is None and pre.get("type") == "ByteLevel"
                and pre.get("use_regex") and not pre.get("add_prefix_space")):
            raise ValueError(f"{path} is not byte-level BPE without normalization")
        byte = {c: b for b, c in visible_bytes().items()}
        self.bytes = {i: bytes(map(byte.__getitem__, t)) for t, i in model["vocab"].items() if byte.keys() >= set(t)}
        vocab = model["vocab"]
        self.rank, self.parts, self.formed = {}, {}, {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[a], vocab[b]
            token = vocab[a + b]
            if max(self.formed.get(x, -1) for x in pair) >= rank or token in self.formed:
                raise ValueError(f"{path}: merge {rank} comes before its parts or is not the first of its token")
            self.rank[pair], self.parts[token], self.formed[token] = rank, pair, rank
        self.single = {self.bytes[i]: i for i in self.bytes if len(self.bytes[i]) == 1}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens with conditions")
        #: What :meth:`fits` has found, by both tokens in one number.
        self.known: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})

    def _spine(self, token: int, side: int) -> tuple[list[int], list[int]]:
        """The tokens that stood at one end of ``token`` over time, and the ranks of the merges that ended each."""
        known = self._spines[side]
        if token not in known:
            tokens = [token]
            while tokens[-1] in self.parts:
                tokens.append(self.parts[tokens[-1]][side])
            tokens.reverse()
            known[token] = tokens, [*(self.formed[t] for t in tokens[1:]), _NEVER]
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together are encoded as those two tokens.

        Both are built by their own merges in order of rank. They stay apart if no two tokens that meet at the seam
        have a merge that comes before the one which takes either away; of equal ranks the left one comes first.
        """
        (left, ends_left), (right, ends_right) = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        apart = True
        while apart:
            rank = self.rank.get((left[i], right[j]), _NEVER)
            apart = rank == _NEVER or rank >= ends_left[i] or rank > ends_right[j]
            if ends_left[i] == ends_right[j] == _NEVER:
                break
            if ends_left[i] <= ends_right[j]:
                i += 1
            else:
                j += 1
        if len(self.known) >= 4 * REMEMBERED:
            self.known.clear()
        self.known[a << 32 | b] = apart
        return apart


class Endings:
    """An automaton over bytes; in every state, the tokens that end there, longest first."""

    def __init__(self, merges: Merges):
        self.next: list[dict[int, int]] = [{}]
        token: list[int | None] = [None]
        for i in chain(merges.single.values(), merges.parts):
            state = 0
            for b in merges.bytes[i]:
                if b not in self.next[state]:
                    self.next[state][b] = len(self.next)
                    self.next.append({})
                    token.append(None)
                state = self.next[state][b]
            token[state] = i
        self.shorter = [0] * len(self.next)
        self.tokens: list[tuple[int, ...]] = [()] * len(self.next)
        queue = deque(self.next[0].values())
        own = {s: tuple(d.items()) for s, d in enumerate(self.next)}
        for s in queue:
            self.tokens[s] = (token[s],)
        while queue:
            state = queue.popleft()
            for b, s in own[state]:
                self.shorter[s] = self.step(self.shorter[state], b)
                behind = self.tokens[self.shorter[s]]
                self.tokens[s] = behind if token[s] is None else (token[s], *behind)
                queue.append(s)

    def step(self, state: int, byte: int) -> int:
        """The state behind ``byte``; ways over shorter endings are remembered in the states."""
        there = self.next[state].get(byte)
        if there is None:
            there = self.next[state][byte] = self.step(self.shorter[state], byte) if state else 0
        return there


class Decoder:
    """Texts of ids under one tokenizer file."""

    def __init__(self, merges: Merges):
        self.token_bytes = merges.bytes | {i: t.encode() for t, i in merges.added.items()}

    def decode(self, ids: Iterable[int]) -> str:
        try:
            raw = b"".join(map(self.token_bytes.__getitem__, ids))
        except KeyError:
            raw = b"".join(self.token_bytes.get(i, b"") for i in ids)
        return raw.decode("utf-8", "replace")


class TrieEncoder(Decoder):
    """Ids of texts, and texts of ids, under one tokenizer file."""

    def __init__(self, path: str):
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        super().__init__(self.merges)
        self.endings = Endings(self.merges)
        self.size = {i: len(b) for i, b in self.merges.bytes.items()}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pattern = regex.compile(PATTERN)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        added = sorted(self.merges.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def _settle(self, last: list[int], states: list[int], depth: int, byte: int) -> None:
        """Automaton state and last token of the prefix of ``depth`` bytes, from those of its shorter prefixes."""
        endings, known, size = self.endings, self.merges.known, self.size
        state = endings.next[states[depth - 1]].get(byte)
        if state is None:
            state = endings.step(states[depth - 1], byte)
        states[depth] = state
        for token in endings.tokens[state]:
            rest = depth - size[token]
            if not rest:
                break
            fits = known.get(last[rest] << 32 | token)
            if fits or fits is None and self.merges.fits(last[rest], token):
                break
        last[depth] = token

    def _ids(self, last: list[int], depth: int) -> tuple[int, ...]:
        out = []
        while depth:
            out.append(last[depth])
            depth -= self.size[last[depth]]
        return tuple(reversed(out))

    def alone(self, word: bytes) -> tuple[int, ...]:
        """A long word, as a trie of one branch."""
        last, states = [0] * (len(word) + 1), [0] * (len(word) + 1)
        for depth, byte in enumerate(word, 1):
            self._settle(last, states, depth, byte)
        return self._ids(last, len(word))

    def walked(self, trie: dict) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Every word of a trie with its ids, in depth-first order; a prefix is settled once for all words under it."""
        last, states = [0] * (LONG_WORD + 1), [0] * (LONG_WORD + 1)
        ahead = [(1, byte, node) for byte, node in trie.items()]
        while ahead:
            depth, byte, node = ahead.pop()
            self._settle(last, states, depth, byte)
            for key, below in node.items():
                if key == _WORD:
                    yield below, self._ids(last, depth)
                else:
                    ahead.append((depth + 1, key, below))

    def learn(self, new: Iterable[str]) -> None:
        """Remember the ids of words, by tries of bounded size."""
        trie: dict = {}
        held = 0
        for word in new:
            if word in self.merges.added:
                self.words[word] = (self.merges.added[word],)
                continue
            raw = word.encode()
            if len(raw) > LONG_WORD:
                self.words[word] = self.alone(raw)
                continue
            node = trie
            for byte in raw:
                below = node.get(byte)
                if below is None:
                    below = node[byte] = {}
                node = below
            node[_WORD] = word
            held += len(raw)
            if held >= TRIE_BYTES:
                self.words.update(self.walked(trie))
                trie, held = {}, 0
        self.words.update(self.walked(trie))

    def _cut(self, text: str) -> Iterator[list[str]]:
        """The words of a text without added tokens, by slices."""
        if not _SETTLED.fullmatch(text):
            yield [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        elif len(text) <= 2 * SLICE:
            yield self.pattern.findall(text)
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            while part := list(islice(found, SLICE)):
                yield part

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The words of a text, by slices; an added token is a word of its own."""
        if self.added is None or not self.added.search(text):
            yield from self._cut(text)
            return
        for k, part in enumerate(self.added.split(text)):
            if k % 2:
                yield [part]
            else:
                yield from self._cut(part)

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text. Words are looked up, and new ones learned, for many short texts together."""
        parts: list[list[np.ndarray]] = []
        held: list[tuple[int, list[str]]] = []
        waiting = 0
        for k, text in enumerate(texts):
            parts.append([])
            for words in self._pieces(text):
                held.append((k, words))
                waiting += len(words)
                if waiting >= SLICE:
                    self._look_up(held, parts)
                    held, waiting = [], 0
        self._look_up(held, parts)
        return [p[0] if len(p) == 1 else np.concatenate([np.empty(0, np.int32), *p]) for p in parts]

    def _look_up(self, held: list[tuple[int, list[str]]], parts: list[list[np.ndarray]]) -> None:
        if len(self.words) > REMEMBERED:
            self.older, self.words = self.words, {}
        new: set[str] = set().union(*(words for _, words in held)).difference(self.words)
        again = new & self.older.keys()
        self.words.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self.learn(new - again)
        find = self.words.__getitem__
        for k, words in held:
            parts[k].append(np.fromiter(chain.from_iterable(map(find, words)), np.int32))


_ENCODERS: dict[str, TrieEncoder] = {}
_DECODERS: dict[str, Decoder] = {}


def trie_encoder(path: str) -> TrieEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def decoder(path: str) -> Decoder:
    """The worker's decoder for a tokenizer file; it needs none of what encoding holds."""
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(Merges(path))
    return _DECODERS[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, row key and ``ids`` (array of int) of every row of ``docs``."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> dict:
        encode = trie_encoder(path).encode
        return {"doc_id": batch["doc_id"], KEY: batch[KEY], "ids": encode(batch["text"].to_pylist())}

    return map_arrow(keyed(docs), run, f"doc_id long, {KEY} long, ids array<int>")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of :func:`encoded` with their ``text``, from the ids alone."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> dict:
        decode = decoder(path).decode
        ids = batch["ids"]
        texts = [decode(ids[k].values.to_numpy(zero_copy_only=False).tolist()) if ids[k].is_valid else None
                 for k in range(len(ids))]
        return {"doc_id": batch["doc_id"], KEY: batch[KEY], "ids": ids, "text": texts}

    return map_arrow(tokens, run, f"doc_id long, {KEY} long, ids array<int>, text string")


def listed(ids: str | Column) -> Column:
    """Decimal ids joined by commas."""
    return F.concat_ws(",", (F.col(ids) if isinstance(ids, str) else ids).cast("array<string>"))
