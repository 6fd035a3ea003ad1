"""The encoder splits a text as the vocabulary does and merges each distinct part once."""

import numpy as np
import public_tokenizers
import pytest

from spendlens.llm import tokens

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")


@pytest.mark.parametrize("name", NAMES)
def test_a_word_is_merged_once_whatever_stands_around_it(name):
    encode = tokens.Encoder(open(public_tokenizers.path(name)).read())
    plain, merged, merge = tokens.Tokenizer.from_file(public_tokenizers.path(name)), [], encode.merge
    encode.merge = lambda part: merged.append(part) or merge(part)
    for text in ("so wordone wordtwo", "so wordone, wordtwo", "so wordone. wordtwo;", "so wordtwo, wordone.\n"):
        assert np.frombuffer(encode(text), encode.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(merged) == len(set(merged))


@pytest.mark.parametrize("name", NAMES)
def test_letters_that_fold_beyond_latin_and_runs_of_blanks(name):
    encode, plain = tokens.Encoder(open(public_tokenizers.path(name)).read()), tokens.Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["Ɵe", "a\x13ƛƐ.", "9Ɓb ȺȾ", "a  b \n c\t  d ", " ", "it's  don'T", "x \x85 y\r\n", "  "]
    for text in texts:
        assert np.frombuffer(encode(text), encode.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, text
