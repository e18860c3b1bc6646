"""Token ids by a public tokenizer, with words remembered.

For the byte-level tokenizer whose pattern never lets a token reach over a single space between two
words, a text may be cut before each such space and the parts encoded apart. Most parts were seen
before, so a worker keeps the ids of parts and of pre-tokens in two bounded dictionaries and
calls the tokenizer's model once for each new one. Texts with other white space next to a space,
and tokenizers of another make, are encoded whole. The ids are always those of
``Tokenizer.encode(text, add_special_tokens=False)`` with special strings taken as ordinary text.
"""

from __future__ import annotations

import re

import numpy as np

from areaflow.llm.common import keeps

#: Entries a worker remembers before it starts anew; bounds its memory, not its results.
REMEMBERED = 1_000_000

_BESIDE_SPACE = re.compile(r" \s|\s ")
_SPACES = re.compile(r"\s\s")
#: Characters whose classes are the same in every Unicode version; parts with others go to the tokenizer.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
#: A word and the signs behind it: two matches of the tokenizer's pattern.
_WORD_AND_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]+)").fullmatch
_SETTLED = re.compile(r"[\t-\r\x20-\x7e\xa1-ɏ]*")


def visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pretokens(dict):
    """Ids of what the tokenizer's pattern finds in a part."""

    def __init__(self, model):
        super().__init__()
        self.model, self.table = model, visible_bytes()

    def ids(self, token: str) -> bytes:
        if token.isascii() and token.isprintable():
            mapped = token.replace(" ", self.table[32])
        else:
            mapped = token.encode().decode("latin1").translate(self.table)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])

    def __missing__(self, token: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[token] = self.ids(token)
        return ids


def _simple(part: str) -> bool:
    return bool(_LETTERS(part) or _WORD_AND_SIGNS(part))


class _Parts(dict):
    """Ids of ``lead`` and what follows it, up to the next space; most are a word, perhaps with signs.

    A line end between two such words is a match of its own. The parts on both sides of it are remembered,
    but not the whole: most words that meet at a line end do so once.
    """

    def __init__(self, encoder: TextEncoder, lead: str):
        super().__init__()
        self.encoder, self.pretokens, self.lead = encoder, encoder.pretokens, lead

    def __missing__(self, part: str) -> bytes:
        word, line_end, rest = part.partition("\n")
        if line_end:
            if _simple(word) and _simple(rest):
                return self[word] + self.pretokens[line_end] + self.encoder.starts[rest]
            return self.encoder.piece(self.lead + part)
        if len(self) >= REMEMBERED:
            self.clear()
        if _LETTERS(part):
            ids = self.pretokens.ids(self.lead + part)
        elif m := _WORD_AND_SIGNS(part):
            ids = self[m[1]] + self.pretokens[m[2]]
        else:
            ids = self.encoder.piece(self.lead + part)
        self[part] = ids
        return ids


class TextEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        pre = repr(self.tokenizer.pre_tokenizer)
        self.byte_level = (pre.startswith("ByteLevel(") and "add_prefix_space=False" in pre and "use_regex=True" in pre
                           and self.tokenizer.normalizer is None)
        self.split = regex.compile(PATTERN).findall
        self.pretokens = _Pretokens(self.tokenizer.model)
        self.parts, self.starts = _Parts(self, " "), _Parts(self, "")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, part: str) -> bytes:
        if not _SETTLED.fullmatch(part):
            return self.whole(part)
        return b"".join(map(self.pretokens.__getitem__, self.split(part)))

    def __call__(self, text: str) -> bytes:
        if not self.byte_level or _SPACES.search(text) and _BESIDE_SPACE.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        if not first or not rest or not rest[-1]:
            return self.whole(text)
        return self.piece(first) + b"".join(map(self.parts.__getitem__, rest))


_ENCODERS: dict[str, TextEncoder] = {}
keeps(_ENCODERS.clear)


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def vocabulary_path() -> str:
    """The byte-level vocabulary of 50,257 ids installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
