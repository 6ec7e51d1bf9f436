"""Words that are encoded many at once get the ids that their text has as a whole."""

import random

import numpy as np

from driftgate.llm.token_files import WORDS_AT_ONCE, WordTokenizer, vocabulary_path

LETTERS = [chr(c) for low, high in [(0x21, 0x17F), (0x300, 0x370), (0x5D0, 0x5EB), (0x900, 0x980),
                                    (0x1100, 0x1200), (0x2000, 0x2070), (0xAC00, 0xAC40)]
           for c in range(low, high)] + ["\x1c", "\x85", "\xa0", "　", "﻿", "İ"]
ODD = ["<|endoftext|>", "a<|endoftext|>b", "don't", "́x", "\x00", "İİ"]


def test_ids_of_words_are_those_of_whole_texts():
    draw = random.Random(5)
    words = ODD + ["".join(draw.choices(LETTERS, k=draw.randint(1, 6))) for _ in
                   range(4 * WORDS_AT_ONCE)]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(400)]
    tokenizer = WordTokenizer(vocabulary_path())
    found = tokenizer.encode([t.encode() for t in texts] + [b"\xff\xfe a", b""])
    plain = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids
             for t in [*texts, "�� a", ""]]
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == [[*x, 1] for x in plain]
