"""Runs of words that repeat with a period, found by recompression.

The words of many texts stand in one row of numbers, a number of its own between any two texts. Rounds of block
compression (equal neighbours become one symbol with a count) and pair compression (the symbols are dealt to
two sides, and a symbol of one side takes in its right neighbour of the other) shorten it. What replaces a stretch
depends on its symbols alone but for its edges, so how far two places agree is found by climbing the rounds while
whole symbols agree and coming down again at the first that differ: a few steps a round.

A run of period q is at least 4 q long, so 3 q places in a row agree with the one q further. One of them is a
multiple of 3 q. Each period thus looks at every 3 q-th place of a text only, n log n places in all, of which those
remain whose two words are equal; their agreement to both sides gives the exact stretch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import ship_package

LEAST_LENGTH, LEAST_PERIODS = 6, 4
WORDS_AT_ONCE = 1 << 17  # texts are taken together up to here; a longer one is alone
PLACES_AT_ONCE = 1 << 20
STRETCH = "array<struct<start long, length long, period long>>"


@dataclass
class Round:
    """How a row of symbols became the next shorter one."""

    blocks: bool  # block compression, otherwise pair compression
    parent: np.ndarray  # of each symbol, the place of the one that took it in
    first: np.ndarray  # of each symbol above, the place of its first part; one more entry ends the last


@dataclass
class Grammar:
    """All rows of symbols, the words first, and the rounds between them."""

    rows: list[np.ndarray]
    rounds: list[Round] = field(default_factory=list)

    def agree(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """How many words from places ``i`` and ``j`` on agree, to the right (``way`` 1) or left (-1).

        No two places may agree up to an end of the row.
        """
        a, b = i.copy(), j.copy()
        top = np.zeros(len(a), np.int64)  # the round in which the symbols differ
        live = np.arange(len(a))
        for height, up in enumerate(self.rounds):
            row = self.rows[height]
            x, y = a[live], b[live]
            same = row[x] == row[y]
            top[live[~same]] = height
            live, x, y = live[same], x[same], y[same]
            over, under = up.parent[x], up.parent[y]
            left = (_parts_left(up, over, x, way), _parts_left(up, under, y, way))
            whole = (up.first[over + 1] - up.first[over], up.first[under + 1] - up.first[under])
            inside = (left[0] != whole[0]) | (left[1] != whole[1])
            steps = np.where(inside, np.minimum(*left) if up.blocks else 1, 0) * way
            x, y = x + steps, y + steps
            a[live], b[live] = x, y
            # Unequal remainders of two blocks of one symbol: the next symbols differ.
            ended = inside & (left[0] != left[1]) if up.blocks else np.zeros(len(x), bool)
            top[live[ended]] = height
            live, x, y = live[~ended], x[~ended], y[~ended]
            a[live], b[live] = up.parent[x], up.parent[y]
        row = self.rows[-1]
        top[live] = len(self.rounds)
        while len(live):
            live = live[row[a[live]] == row[b[live]]]
            a[live] += way
            b[live] += way
        for height in range(len(self.rounds), 0, -1):
            live = np.flatnonzero(top >= height)
            if not len(live):
                continue
            down, row = self.rounds[height - 1], self.rows[height - 1]
            over, under = a[live], b[live]
            x, y = ((down.first[k] if way > 0 else down.first[k + 1] - 1) for k in (over, under))
            steps = 1
            if down.blocks:
                steps = np.minimum(*(down.first[k + 1] - down.first[k] for k in (over, under)))
            steps = np.where(row[x] == row[y], steps, 0) * way
            a[live], b[live] = x + steps, y + steps
        return np.abs(a - i)


def _parts_left(up: Round, over: np.ndarray, place: np.ndarray, way: int) -> np.ndarray:
    """Parts of the symbol above from ``place`` on, itself included."""
    return up.first[over + 1] - place if way > 0 else place - up.first[over] + 1


def _side(row: np.ndarray, salt: int) -> np.ndarray:
    x = (row.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(41)) & np.uint64(1) == 1


def _numbered(keys: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """Equal keys get equal numbers from ``first`` on; also the next free number."""
    found, number = np.unique(keys, return_inverse=True)
    return (number + first).astype(np.int32), first + len(found)


def recompress(words: np.ndarray, least: int = 1) -> Grammar:
    """The grammar of a row of numbers, shortened until ``least`` symbols or fewer are left."""
    row = words.astype(np.int32)
    grammar = Grammar([row])
    free = int(row.max()) + 1 if len(row) else 0
    salt = 0

    def shorten(starts: np.ndarray, blocks: bool, new: np.ndarray) -> np.ndarray:
        place = np.flatnonzero(starts).astype(np.int32)
        parent = (np.cumsum(starts) - 1).astype(np.int32)
        grammar.rounds.append(Round(blocks, parent, np.append(place, np.int32(len(starts)))))
        grammar.rows.append(new)
        return new

    while len(row) > max(1, least):
        starts = np.append(True, row[1:] != row[:-1])
        if not starts.all():
            place = np.flatnonzero(starts)
            sizes = np.diff(place, append=len(row))
            new, several = row[place], sizes > 1
            keys = new[several].astype(np.int64) << 32 | sizes[several]
            new[several], free = _numbered(keys, free)
            row = shorten(starts, True, new)
            if len(row) < 2:
                break
        # Neighbours differ now, so some deal puts one pair on different sides.
        while True:
            salt += 1
            side = _side(row, salt)
            pairs, turned = side[:-1] & ~side[1:], ~side[:-1] & side[1:]
            if turned.sum() > pairs.sum():
                pairs = turned
            if pairs.any():
                break
        starts = np.append(True, ~pairs)
        place = np.flatnonzero(starts)
        paired = np.append(pairs, False)[place]
        new, at = row[place], place[paired]
        new[paired], free = _numbered(row[at].astype(np.int64) << 32 | row[at + 1], free)
        row = shorten(starts, False, new)
    return grammar


def _places(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of the grid, in bounded pieces: every 3 q-th place whose partner is in the text."""
    fits = np.where(sizes >= LEAST_LENGTH, sizes // LEAST_PERIODS, 0)
    fits = np.where((sizes >= LEAST_LENGTH) & (fits == 0), 1, fits)
    ends = np.cumsum(fits)
    total = int(ends[-1]) if len(ends) else 0
    for begin in range(0, total, PLACES_AT_ONCE):
        number = np.arange(begin, min(total, begin + PLACES_AT_ONCE))
        text = np.searchsorted(ends, number, side="right")
        period = number - (ends[text] - fits[text]) + 1
        grid = (LEAST_PERIODS - 1) * period
        here = -(-(sizes[text] - period) // grid)
        upto = np.cumsum(here)
        at = 0
        while at < len(number):  # a piece of at most PLACES_AT_ONCE places, or one period of one text
            before = int(upto[at - 1]) if at else 0
            last = max(at + 1, int(np.searchsorted(upto, before + PLACES_AT_ONCE, side="right")))
            some = here[at:last]
            starts = np.repeat(np.cumsum(some) - some, some)
            place = (np.arange(int(some.sum())) - starts) * np.repeat(grid[at:last], some)
            yield np.repeat(text[at:last], some), np.repeat(period[at:last], some), place
            at = last


def stretches(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, as numbers of its words, its runs: rows (start, length, period) by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes + 1) - sizes  # a number of its own stands before each text and at the end
    most = max((int(t.max()) for t in texts if len(t)), default=0)
    row = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    for text, offset in zip(texts, offsets, strict=True):
        row[offset : offset + len(text)] = text
    between = np.append(offsets - 1, len(row) - 1)
    row[between] = most + 1 + np.arange(len(between))
    grammar: Grammar | None = None
    found = [np.zeros((0, 4), np.int64)]
    for text, period, place in _places(sizes):
        at = offsets[text] + place
        equal = row[at] == row[at + period]
        text, period, at = text[equal], period[equal], at[equal]
        if not len(at):
            continue
        grammar = grammar or recompress(row, len(texts))
        after = grammar.agree(at, at + period, 1)
        before = grammar.agree(at - 1, at + period - 1, -1)
        length = before + after + period
        long = length >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period)
        start = at - before - offsets[text]
        found.append(np.stack([text, start, length, period], axis=1)[long])
    # One stretch is found at several places, and under the multiples of its period.
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)) if len(rows) else np.zeros(0, bool)
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[a:b, 1:] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _kept(size: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: all but those that a run repeats."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _judged(rows: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, np.ndarray, bytes]]:
    """(row, words) of several texts -> (row, number of words, runs, text without the repetitions)."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    texts = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for _, words in rows]
    for (at, words), runs in zip(rows, stretches(texts), strict=True):
        if len(runs):
            kept = [words[k] for k in np.flatnonzero(_kept(len(words), runs))]
        else:
            kept = words
        yield at, len(words), runs, b" ".join(kept)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n_words, runs, collapsed)."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            part = batch.slice(begin, 1024)
            data = part.column(1).cast(pa.large_binary())
            held, size = [], 0
            out: list = []
            for at in range(part.num_rows):
                words = (data[at].as_py() or b"").split()
                if held and size + len(words) > WORDS_AT_ONCE:
                    out += _judged(held)
                    held, size = [], 0
                held.append((at, words))
                size += len(words)
            out += _judged(held)
            sizes = np.array([len(runs) for _, _, runs, _ in out])
            cells = np.concatenate([runs for _, _, runs, _ in out])
            stretch = pa.StructArray.from_arrays(
                [pa.array(cells[:, k]) for k in range(3)], names=["start", "length", "period"]
            )
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([n for _, n, _, _ in out], pa.int64()),
                    pa.ListArray.from_arrays(offsets, stretch),
                    pa.array([text for *_, text in out], pa.large_binary()).cast(pa.large_string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs, collapsed.

    ``docs`` has doc_id and text; other columns, whatever their names, are not read. Words are what blanks and the
    controls from tab to carriage return separate, numbered from 0; they are compared byte by byte. ``runs`` holds
    every (start, length, period): a stretch of consecutive words of smallest period q, at least 6 words and 4 q
    long, that no word beside it continues; ordered by start, then period. ``collapsed`` is the text without the
    words that some run holds after its first q ones, joined by single blanks.

    Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows and null ids are kept
    as they are; the result has a row for each. A text is handled whole by one task, in memory that grows with it,
    however long it is, in time of n log n; nothing is shuffled.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _find, f"doc_id {kind}, n_words long, runs {STRETCH}, collapsed string"
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with periodic words written into a tenth of the texts.

    With h the crc32 of the id's decimal digits, g = h div 10 and n words: where h % 10 is 0 and n above 0, each word
    i from a on becomes word a + (i - a) % p, with a = g % n and p = 1 + (n - a) div (3 + g % 8). Other texts, and
    those of null ids, stay.
    """
    text = F.translate("text", "\t\n\x0b\f\r", "     ")
    # The words are bound to a name, so that the lambda does not split the text for each of them.
    write = (
        "transform(array(split(spaced, ' +')), w -> array_join(transform(sequence(0, size(w) - 1), i -> "
        "w[int(if(i < g % size(w), i, g % size(w) + (i - g % size(w))"
        " % (1 + (size(w) - g % size(w)) div (3 + g % 8))))]), ' '))[0]"
    )
    marked = docs.select("doc_id", "text").withColumns(
        {"h": F.crc32(F.col("doc_id").cast("string").cast("binary")), "spaced": F.trim(text)}
    )
    marked = marked.withColumn("g", F.expr("h div 10"))
    chosen = (F.col("h") % 10 == 0) & (F.col("spaced") != "")
    return marked.select("doc_id", F.when(chosen, F.expr(write)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The result of :func:`find_runs` as numbers: doc_id, n_runs, the longest run, hashes of runs and collapsed text.

    The longest run is that of greatest length, then smallest start, then smallest period; without one its columns
    are null.
    """
    order = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start as s, -r.period as p)))")
    lines: Column = F.array_join(
        F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"
    )
    some = F.size("runs") > 0
    longest = found.withColumn("longest", order)
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.expr("1000 * longest.length div -longest.p").alias("exponent_milli"),
        F.sha2(F.when(some, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
