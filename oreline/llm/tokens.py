"""Words of whole Arrow batches at once, as 64-bit hashes.

A word is a run of letters, marks and digits of any script; spaces, punctuation and symbols of all of Unicode part
words. In scripts that are written without blanks (``UNSPACED``) every character, with the marks on it, is a word, and so
is every emoji. All words of a batch are found and hashed by a few numpy passes over its UTF-8 bytes, a bounded piece
at a time; only characters beyond ASCII are decoded.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_BASE = np.uint64(0x100000001B3 * 2654435761 % 2**64 | 1)

_is_word = np.zeros(256, bool)
for _span in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _is_word[slice(*_span)] = True

# Code points of scripts without blanks between words: Thai, Lao, Tibetan, Myanmar, Khmer, Japanese and Chinese.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF),
    (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
)
EMOJI = (0x1F000, 0x1FAFF)
PARTS, LETTER, ALONE, MARK = range(4)  # parts words; belongs to one; is one; belongs to the word before
_TABLE = 0x20000

_powers: list[np.ndarray] = []


@cache
def _kinds() -> np.ndarray:
    """The kind of every code point below ``_TABLE``."""
    kinds = np.zeros(_TABLE, np.uint8)
    for code in range(_TABLE):
        general = unicodedata.category(chr(code))[0]
        kinds[code] = LETTER if general in "LMN" else PARTS
        if general == "M" and any(a <= code <= b for a, b in UNSPACED):
            kinds[code] = MARK
    for first, last in UNSPACED:
        own = kinds[first : last + 1]
        own[own == LETTER] = ALONE
    kinds[EMOJI[0] : EMOJI[1] + 1] = ALONE
    kinds[0xFE00:0xFE10] = MARK  # variation selectors
    kinds[0x200C:0x200E] = LETTER  # joiners
    return kinds


def _kinds_of(codes: np.ndarray) -> np.ndarray:
    kinds = _kinds()[np.minimum(codes, _TABLE - 1)]
    high = codes >= _TABLE
    kinds[high] = np.where(codes[high] <= UNSPACED[-1][1], ALONE, PARTS)
    return kinds


def characters_alone(text: str) -> int:
    """How many characters of a text are words by themselves."""
    return int((_kinds_of(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)) == ALONE).sum())


def _decoded(data: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and lengths of the characters of two to four bytes that begin at ``lead``."""
    head = data[lead].astype(np.uint32)
    sizes = 2 + (head >= 0xE0) + (head >= 0xF0).astype(np.int64)
    codes = head & (np.uint32(0x7F) >> sizes.astype(np.uint32))
    for step in (1, 2, 3):
        longer = sizes > step
        codes[longer] = codes[longer] << np.uint32(6) | data[lead[longer] + step] & np.uint32(0x3F)
    return codes, sizes


def _marked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of whole characters: whether it is in a word, and whether it begins one."""
    inside = _is_word[data]
    lead = np.flatnonzero(data >= 0xC2)
    codes, sizes = _decoded(data, lead)
    kinds = _kinds_of(codes)
    other = kinds != LETTER
    lead, sizes, kinds = lead[other], sizes[other], kinds[other]
    for step in range(4):
        inside[lead[(kinds == PARTS) & (sizes > step)] + step] = False
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if len(lead):
        behind = (lead + sizes)[kinds != PARTS]
        behind = behind[behind < len(data)]
        begins[behind] = inside[behind]
        begins[lead[kinds == ALONE]] = True
        marks = lead[kinds == MARK]
        begins[marks] = (marks == 0) | ~inside[marks - 1]
    return inside, begins


def _power_table(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < length:
        size = max(length, PIECE + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _powers[:] = [
            np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
            for base in (_BASE, inverse)
        ]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    first = int(at[0])
    return np.frombuffer(data, np.uint8)[first : int(at[-1])], at - first


def words(texts: pa.Array, stem: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes of the lower-cased words; where each text's words begin (and the end); stems.

    With ``stem``, the third array has the hash of each word's first ``stem`` bytes.
    """
    data, offsets = utf8(pc.utf8_lower(texts))
    found, places, stems = [], [], []
    first = 0
    edges = offsets[1:-1]
    while first < len(data):
        last = min(len(data), first + PIECE)
        while last < len(data) and _is_word[data[last]] and _is_word[data[last - 1]] and not 0xE4 <= data[last] <= 0xE9:
            last += 1  # a word is never cut; at these bytes Chinese characters begin
        own = data[first:last]
        inside, begins = _marked(own)
        cuts = edges[np.searchsorted(edges, first) : np.searchsorted(edges, last)] - first
        begins[cuts] = inside[cuts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _power_table(len(own) + 1)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * power[: len(own)], out=sums[1:])
        found.append(mixed((sums[end] - sums[start]) * inverse[start]))
        if stem:
            cut = np.minimum(end, start + stem)
            stems.append(mixed((sums[cut] - sums[start]) * inverse[start]))
        places.append(start + first)
        first = last
    none = np.zeros(0, np.uint64)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    hashes = np.concatenate(found) if found else none
    bounds = np.searchsorted(place, offsets)
    return hashes, bounds, (np.concatenate(stems) if stems else none) if stem else None
