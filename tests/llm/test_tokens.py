"""Encoding by words against the library's own encoding of whole texts."""

import random

import numpy as np
import pytest

from gaugeline.llm import tokens
from gaugeline.llm.tokens import encoder, vocabulary

ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "a\n\nb", "\na", "a\n", "a\tb", "a b", "a b c", "don't we'll 'tis", "<|endoftext|> x <|startoftext|>", "x\x01 y \x01", "é́ e ́x", "ΣΑΣ Σ", "日本 語", "😀 😀x", "a" * 5000, "1234 5,6", "x\x1cy z", "a\r\nb", "##$$ %%\n&&"]
VOCABULARIES = [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")]


def same_as_library(name, space, batches):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    library.encode_special_tokens = True
    for texts in batches:
        for text, raw in zip(texts, encoder(vocabulary(name), space).encode(texts), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:200])


@pytest.mark.parametrize(("name", "space"), VOCABULARIES)
def test_ids_equal_the_librarys(name, space):
    draw = random.Random(3)
    texts = ODD + ["".join(draw.choice(["a", "the", "Zürich", " ", " ", "\n", "  ", "\t", "'s", "9", "!?", "ñ", "\x01", "　"]) for _ in range(draw.randint(1, 60))) for _ in range(400)]
    same_as_library(name, space, [texts, texts])  # the second time from memory


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize(("name", "space"), VOCABULARIES)
def test_strings_that_defeat_polynomial_hashes(name, space):
    flip = str.maketrans("ab", "ba")
    texts = []
    for n in (64, 512, 1024, 2048, 4096, 8192):
        t = thue_morse(n)
        texts += [t, t.translate(flip), f"x {t} {t.translate(flip)} {t}", f"{t.translate(flip)}\n{t}"]
    same_as_library(name, space, [texts, texts[::-1], *([t] for t in texts)])


@pytest.mark.parametrize(("name", "space"), VOCABULARIES)
def test_ids_do_not_rest_on_hashes(name, space, monkeypatch):
    """With hashes of two values, nearly all segments clash, in a batch and with what is remembered."""
    find, keys = tokens._Memory.find, []
    monkeypatch.setattr(tokens, "_VALUE", np.ones(256, np.uint64))
    monkeypatch.setattr(tokens, "_BASE", 1)
    monkeypatch.setattr(tokens, "_INVERSE", 1)
    monkeypatch.setattr(tokens, "_loaded", {})
    monkeypatch.setattr(tokens._Memory, "find", lambda self, k: (keys.append(len(set(k.tolist()))), find(self, k))[1])
    draw = random.Random(4)
    texts = [" ".join("".join(draw.choices("abcde.", k=draw.randint(1, 5))) for _ in range(50)) for _ in range(40)]
    same_as_library(name, space, [texts[:20], texts[20:], texts])
    assert max(keys) <= 8
