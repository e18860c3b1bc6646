"""Remembered parts against the tokenizer itself, on texts made to fall between the parts."""

import random

from areaflow.llm.tokens import TextEncoder, vocabulary_path

PIECES = ["a", "B", "é", " ", "\n", ".", "'", "'s", "1", "$", "\t", "ß", "日", " ", "  ", "\n\n", "ab", "l'", "'ll", ", ", "_", "İ"]


def test_parts_give_the_tokenizers_ids():
    rng = random.Random(3)
    encode = TextEncoder(vocabulary_path())
    texts = ["", " ", "word.\nnext", "word.\n next", "one\ntwo\nthree four$$$\nfive"]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    assert [x for x in texts if encode(x) != encode.whole(x)] == []
