"""Words of packed texts: which of them are encoded, how prose is divided, and ids as the tokenizers library gives them."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidepanel.llm import packing
from tidepanel.llm.bpe import encode_words, read_vocabulary

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(WORDS)


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_words_that_come_back_are_encoded_once(vocabulary, library, monkeypatch):
    seen = []

    def noted(v, words):
        seen.extend(words)
        return encode_words(v, words)

    monkeypatch.setattr(packing, "encode_words", noted)
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    encoder = packing.WordEncoder(vocabulary, lambda: library)
    for k in range(8):
        text = "common words, " + " ".join(chr(97 + k) + chr(97 + j) * 3 for j in range(12))
        assert list(encoder.encode([text, text])) == [ids_of(library, text)] * 2
    assert seen.count(b"common") == seen.count(b"words") == 1
    assert len(encoder.known) + len(encoder.known.earlier) <= 2 * (10 + 15)


def test_prose_needs_no_pattern(vocabulary, library):
    encoder = packing.WordEncoder(vocabulary, lambda: library)
    encoder.words = None
    texts = ["Ein Wort,noch eins.\nÉté\t à l été ,  fin .", ".a,", " ", "", "Ÿ Ǆ Ə"]
    assert list(encoder.encode(texts)) == [ids_of(library, t) for t in texts]


def test_prose_is_divided_as_by_the_pattern():
    letters = [c for c in map(chr, range(0x250)) if packing.WordEncoder.prose.fullmatch("a" + c) and not c.isspace() and c not in ".,"]
    assert len(letters) > 400 and all(re.fullmatch(f"[{packing.PLAIN_LETTERS}]+", c.lower()) for c in letters)
    for crowded in ("a..b", "a,.", "..", "a1", "it's", "a-b", "İ", "a\x0bb", "a\xa0b", "<|endoftext|>", "ɐ"):
        assert not packing.WordEncoder.prose.fullmatch(crowded)


def test_ids_are_the_library_s(vocabulary, library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    rng = random.Random(4)
    mixed = ["a", "b", "s", "t", "re", "'", "'ll", ".", ",", "!", "-", "7", " ", "\n", "é", "Œ", "İ", "̇", "K", "ß", "漢", "<|", "<|endoftext|>"]
    plain = ["th", "in", "an", "er", "a", "e", "É", "ñ", " ", " ", ",", ".", "\t"]
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 30))) for chars in (mixed, plain) for _ in range(400)] + ["ab" * 900, "a" * 901, "aab" * 300]
    encoder = packing.WordEncoder(vocabulary, lambda: library)
    for at in range(0, len(texts), 40):
        assert list(encoder.encode(texts[at : at + 40])) == [ids_of(library, t) for t in texts[at : at + 40]]
