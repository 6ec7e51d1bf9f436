"""The model that a segment's blocks share, and words that only differ in capitals and a mark."""

import numpy as np

from driftgate.llm import range_coder
from driftgate.llm.token_files import WordTokenizer, vocabulary_path


def _ids(n):
    return np.minimum(np.random.default_rng(3).zipf(1.3, n), 3000)


def test_blocks_share_a_model():
    """Ids without order cost about their entropy, which no block of 2,048 ids knows on its own."""
    ids = _ids(40 * range_coder.BLOCK)
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert sum(map(len, range_coder.encode_blocks(ids))) * 8 / len(ids) < entropy + 0.8


def test_a_block_decodes_with_the_model_alone():
    size = range_coder.BLOCK
    ids = _ids(5 * size + 77)
    model, *blocks = range_coder.encode_blocks(ids)
    assert len(blocks) == 6
    for k, block in enumerate(blocks):
        own = ids[k * size:(k + 1) * size]
        assert (range_coder.decode_blocks([model, block], [len(own)]) == own).all()


def test_damage_comes_to_an_end():
    ids = _ids(3 * range_coder.BLOCK)
    model, *blocks = range_coder.encode_blocks(ids)
    blocks = [b"\xff" * 9, blocks[1], blocks[2][:-5]]
    found = range_coder.decode_blocks([model, *blocks], [range_coder.BLOCK] * 3)
    own = slice(range_coder.BLOCK, 2 * range_coder.BLOCK)
    assert len(found) == len(ids) and (found[own] == ids[own]).all()


def test_forms_of_a_word_are_learned_once():
    tokenizer = WordTokenizer(vocabulary_path())
    asked = []
    real = tokenizer._learn_by_rules
    tokenizer._learn_by_rules = lambda new: (asked.extend(new), real(new))
    words = ["élan", "Élan", "ÉLAN.", "élan!", "Straße,", "straße", "a.", "A", "don't", "x..", "÷a",
             "é.", "Ÿ", "İ.", "<|ENDOFTEXT|>", "<|endoftext|>", "ª", "µm;", "1.", "İ", "a,b"]
    found = tokenizer.encode([w.encode() for w in words])
    plain = [tokenizer.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == [[*x, 1] for x in plain]
    assert len(tokenizer.letters) == 3 and len(asked) == 13


def test_no_texts_and_no_words():
    tokenizer = WordTokenizer(vocabulary_path())
    assert tokenizer.encode([]) == [] and tokenizer.encode([b"", b" \n"]) == [b"\x01\x00"] * 2
