"""Words of every script: the hashed words of a batch against a plain reading, character by character."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from oreline.llm import tokens


def plain(text):
    """The words of a text, read character by character."""
    out, open_word = [], False
    for c in text.lower():
        code, general = ord(c), unicodedata.category(c)[0]
        alone = any(a <= code <= b for a, b in tokens.UNSPACED)
        if tokens.EMOJI[0] <= code <= tokens.EMOJI[1] or (alone and general in "LN" and code < 0x20000) or code in range(0x20000, 0x40000):
            out.append(c)
            open_word = False
        elif code in range(0xFE00, 0xFE10) or (alone and general == "M"):
            if out and open_word is not None:
                out[-1] += c
            else:
                out.append(c)
            open_word = False
        elif general in "LMN" and code < 0x20000 or c in "‌‍":
            if open_word:
                out[-1] += c
            else:
                out.append(c)
            open_word = True
        else:
            open_word = None  # nothing to go on with
    return out


def grouped(texts):
    hashes, bounds, _ = tokens.words(pa.array(texts, pa.string()))
    return [list(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def agree(texts):
    found, expected = grouped(texts), [plain(t or "") for t in texts]
    assert [len(f) for f in found] == [len(e) for e in expected]
    by_word, by_hash = {}, {}
    for own, read in zip(found, expected, strict=True):
        for h, w in zip(own, read, strict=True):
            assert by_word.setdefault(w, h) == h
            assert by_hash.setdefault(h, w) == w


TEXTS = [
    "Plain words, 12 of them",
    "“idiot” — l’été über…naïve",
    "中文句子，没有空格。ABC中12",
    "日本語の文ーです。",
    "ที่นี่ thaiกิx",
    "हिन्दी абв αβγ",
    "\U0001f600\U0001f600 a\U0001f600b ❤️ \U00020000\U00020001",
    "а́bc \U0001f1e9\U0001f1ea",
    "",
    None,
    "！　·",
]


def test_words_of_every_script():
    agree(TEXTS)
    assert plain(TEXTS[2]) == ["中", "文", "句", "子", "没", "有", "空", "格", "abc", "中", "12"]
    assert grouped(["“idiot”"]) == grouped(["idiot"])
    assert tokens.characters_alone(TEXTS[2]) == 9 and tokens.characters_alone("café") == 0


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_random_characters(piece, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", piece)
    rng = random.Random(4)
    letters = [c for t in TEXTS for c in t or ""] + list("  ab,")
    agree(["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(400)])


def test_neighbouring_texts_do_not_join():
    joined = grouped(["ab", "cd", "中", "文x", "y"])
    assert joined == [grouped([t])[0] for t in ("ab", "cd", "中", "文x", "y")]


def test_long_text_without_blanks():
    assert np.diff(tokens.words(pa.array(["中" * 500_000, "ก" * 400_000]))[1]).tolist() == [500_000, 400_000]
