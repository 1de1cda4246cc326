"""Benchmark decontamination by latent semantic retrieval.

1. Passages of ``PASSAGE`` words over all texts give document frequencies of hashed words.
2. A distributed randomised SVD finds the main directions of the TF-IDF matrix of all passages: every task
   adds its passages, with random signs, to the rows of a sketch of ``SKETCH`` x ``VOCABULARY`` (a sparse random
   test matrix of one sign a passage), sketches are added up over two levels, and the driver factors
   the sum. The first ``COMMON`` directions, which hold languages and very frequent words, are left out
   as far as ``RANK - COMMON`` others remain.
3. Every text slides windows over its words; windows and benchmark passages with a cosine of ``CANDIDATE`` or
   more in the latent space are candidates. Short passages are compared with short windows.
4. A candidate's longest common subsequence with the passage decides: ``COPY`` of its words or more is a copy;
   from ``PARAPHRASE`` on it is a paraphrase if the answer occurs too: the rarest words of the passage's
   last sentence, or of the whole passage where that sentence is short. In passages of scripts without blanks
   the words are characters, many of which any text shares, so only copies count.
5. In addition, passages of up to ``SHORT_WORDS`` words are searched word by word, as they are too small a part of
   their windows for a cosine to tell: wherever their words stand one after another is a copy.

Windows never leave their task; only partial sums are shuffled. What is broadcast is the projection (a fixed
size) and the benchmark's words, whose bytes are counted first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import ship_package
from oreline.llm.tokens import characters_alone, mixed, words

VOCABULARY = 1 << 13  # hashed words of the latent space
SKETCH, RANK, COMMON = 256, 96, 16
BLOCK = 16
PASSAGE = 4 * BLOCK
SHORT, LONG = 2, 4  # blocks of a window for passages of up to SHORT_WORDS words, and for others
SHORT_WORDS = 24
PIECE_WORDS = 56  # longer benchmark items are several passages
LEAST_WORDS = 4  # shorter passages say nothing and are not searched
LEAST_CHARACTERS = 8  # the same for passages of scripts without blanks, whose words are characters
CANDIDATE = 0.3
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
ANSWER_WORDS = 5
MOST_BENCHMARK_BYTES = 40_000_000
BLOCKS_AT_ONCE = 4096
PASSAGES_AT_ONCE = 256
CHUNK = 32  # rows of the sketch that are added up together


def _ids(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(VOCABULARY)).astype(np.uint16)


def _blocks(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the blocks of ``size`` words of all texts, and where each text's blocks begin."""
    lengths = np.diff(bounds)
    counts = -(-lengths // size)
    begins = np.r_[0, np.cumsum(counts)]
    inside = np.arange(begins[-1]) - np.repeat(begins[:-1], counts)
    return np.repeat(bounds[:-1], counts) + inside * size, begins


def _sums(ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over the words of each block; blocks follow one another."""
    out = np.empty((table.shape[1], len(starts)), np.float32)
    columns, at = np.ascontiguousarray(table.T), ids.astype(np.intp)
    ends = np.r_[starts[1:], len(ids)]
    for first in range(0, len(starts), BLOCKS_AT_ONCE):
        own = starts[first : first + BLOCKS_AT_ONCE]
        some = at[own[0] : ends[first + len(own) - 1]]
        for column, line in zip(columns, out, strict=True):  # a column stays in the processor's cache
            np.add.reduceat(np.take(column, some, mode="clip"), own - own[0], out=line[first : first + len(own)])
    return np.ascontiguousarray(out.T)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (word, passages); the row of word -1 counts all passages."""
    counts, total = np.zeros(VOCABULARY, np.int64), 0
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            hashes, bounds, _ = words(batch.column(0).slice(first, 512))
            starts, _ = _blocks(bounds, PASSAGE)
            ids, ends = _ids(hashes).astype(np.int64), np.r_[starts, len(hashes)]
            for at in range(0, len(starts), 1024):  # a word counts once a passage
                own = ends[at : at + 1025]
                holds = np.zeros((len(own) - 1) * VOCABULARY, bool)
                holds[np.repeat(np.arange(len(own) - 1) * VOCABULARY, np.diff(own)) + ids[own[0] : own[-1]]] = True
                counts += holds.reshape(-1, VOCABULARY).sum(axis=0)
            total += len(starts)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[-1, found].astype(np.int32)), pa.array(np.r_[total, counts[found]])],
        names=["word", "passages"],
    )


def _sketch(weights: np.ndarray):
    """(task, text) -> (task, chunk, sums): signed sums of the task's passages in ``SKETCH`` rows.

    A passage's row is its TF-IDF vector at about unit length. The row and the sign that it gets follow
    from the task and the passage's number there.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task, seen = np.zeros(SKETCH * VOCABULARY), 0, 0
        squares = weights**2
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                task = part.column(0)[0].as_py()
                hashes, bounds, _ = words(part.column(1))
                ids = _ids(hashes)
                starts, _ = _blocks(bounds, PASSAGE)
                if not len(starts):
                    continue
                scale = 1 / np.sqrt(np.maximum(np.add.reduceat(squares[ids], starts), 1e-12))
                drawn = mixed(np.uint64(task << 40) + np.arange(seen, seen + len(starts), dtype=np.uint64))
                seen += len(starts)
                scale[(drawn >> np.uint64(32)) % np.uint64(2) == 0] *= -1
                lengths = np.diff(np.r_[starts, len(ids)])
                row = np.repeat((drawn % np.uint64(SKETCH)).astype(np.int64) * VOCABULARY, lengths)
                total += np.bincount(row + ids, np.repeat(scale, lengths), len(total))
        chunks = total.astype(np.float32).reshape(-1, CHUNK * VOCABULARY)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(chunks), task, np.int64)),
                pa.array(np.arange(len(chunks), dtype=np.int32)),
                pa.array([c.tobytes() for c in chunks], pa.binary()),
            ],
            names=["task", "chunk", "sums"],
        )

    return add


def _added(table: pa.Table) -> pa.Table:
    """The sum of the rows of a group, in the order of the tasks, so that runs agree."""
    table = table.sort_by("task")
    total = sum(np.frombuffer(x.as_py(), np.float32) for x in table["sums"])
    return pa.table(
        {
            "task": pa.array([table["task"][0].as_py()], pa.int64()),
            "chunk": pa.array([table["chunk"][0].as_py()], pa.int32()),
            "sums": pa.array([total.tobytes()], pa.binary()),
        }
    )


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The projection, one row for each hashed word, and the words' weights, from all texts of ``docs``.

    Two passes over the texts run when this is called. Without words it projects all to zero.
    """
    ship_package(docs.sparkSession)
    texts = docs.select("text").filter(F.col("text").isNotNull())
    counted = texts.mapInArrow(_frequencies, "word int, passages long").groupBy("word").sum("passages")
    found = dict(map(tuple, counted.collect()))  # VOCABULARY + 1 rows at most
    total = found.pop(-1, 0)
    weights = np.zeros(VOCABULARY)
    for word, passages in found.items():
        weights[word] = np.log(1 + total / passages)
    shape = "task long, chunk int, sums binary"
    parts = texts.select(F.spark_partition_id().cast("long").alias("task"), "text")
    parts = parts.mapInArrow(_sketch(weights), shape)
    some = F.pmod("task", F.lit(max(1, int(texts.rdd.getNumPartitions() ** 0.5))))
    parts = parts.groupBy("chunk", some.alias("part")).applyInArrow(_added, shape)
    parts = parts.groupBy("chunk").applyInArrow(_added, shape)
    sketch = np.zeros((SKETCH, VOCABULARY), np.float32)
    for row in parts.collect():  # SKETCH x VOCABULARY numbers
        sketch[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["sums"], np.float32).reshape(
            CHUNK, VOCABULARY
        )
    # The right singular vectors from the small side: B B' = U S^2 U', V' = S^-1 U' B.
    sketch = sketch * weights.astype(np.float32)
    values, vectors = np.linalg.eigh((sketch @ sketch.T).astype(np.float64))
    values, vectors = values[::-1][:RANK], vectors[:, ::-1][:, :RANK]
    alive = values > 1e-9 * max(float(values[0]), 1e-300)
    right = (sketch.T @ vectors) * np.where(alive, 1 / np.sqrt(np.maximum(values, 1e-300)), 0)
    left_out = max(0, min(COMMON, int(alive.sum()) - (RANK - COMMON)))
    return (right[:, left_out:] * weights[:, None]).astype(np.float32), weights


@dataclass
class Benchmark:
    """Passages of the items as hashes of words, and the words that their answers are chosen from."""

    items: list
    hashes: list[np.ndarray]
    answers: list[np.ndarray]
    unspaced: list[bool]  # most words are characters

    def __post_init__(self) -> None:
        self.sizes = np.array([len(h) for h in self.hashes], np.int64)
        self.least = np.where(self.unspaced, COPY, PARAPHRASE)  # share of words from which answers are looked at

    def latent(self, projection: np.ndarray) -> np.ndarray:
        out = np.stack([projection[_ids(h)].sum(axis=0) for h in self.hashes])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def choose_answers(self, weights: np.ndarray) -> None:
        rarest = [np.argsort(-weights[_ids(a)], kind="stable")[:ANSWER_WORDS] for a in self.answers]
        self.answers = [a[r] for a, r in zip(self.answers, rarest, strict=True)]


def read_benchmark(benchmark: DataFrame) -> Benchmark:
    """The items of ``benchmark`` (item_id, text), cut into passages; their bytes are counted first.

    Items of more than ``PIECE_WORDS`` words are cut into pieces of about equal length; null texts and
    pieces of fewer than ``LEAST_WORDS`` words, or ``LEAST_CHARACTERS`` characters of scripts without blanks,
    are left out.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; search it in parts")
    items, pieces, answers, unspaced = [], [], [], []
    for item, text in sorted(map(tuple, benchmark.select("item_id", "text").collect()), key=repr):
        hashes = words(pa.array([text or ""]))[0]
        sentences = [s for s in re.split(r"(?<=[.?!])\s+|\n", text or "") if s.strip()]
        answer = words(pa.array(sentences[-1:], pa.string()))[0]
        alone = 2 * characters_alone(text or "") > len(hashes)
        count = max(1, -(-len(hashes) // PIECE_WORDS))
        for piece in np.array_split(hashes, count):
            if len(piece) >= (LEAST_CHARACTERS if alone else LEAST_WORDS):
                items.append(item)
                unspaced.append(alone)
                pieces.append(piece)
                answers.append(np.unique(answer if len(np.unique(answer)) >= ANSWER_WORDS else piece))
    return Benchmark(items, pieces, answers, unspaced)


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        step = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


def _subsequences(regions: np.ndarray, passage: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Longest common subsequences of many regions with passages, a bit for each word of a passage.

    ``regions`` has hashed words (VOCABULARY: none), ``places`` where in each passage each word stands.
    """
    state = np.full(len(regions), 2**64 - 1, np.uint64)
    for step in range(regions.shape[1]):
        hit = state & places[passage, regions[:, step]]
        state = (state + hit) | (state - hit)
    return np.bitwise_count(~state)


def _starts(hashes: np.ndarray) -> np.ndarray:
    """A hash of the ``LEAST_WORDS`` words from each word on."""
    count = max(0, len(hashes) - LEAST_WORDS + 1)
    out = np.zeros(count, np.uint64)
    for step in range(LEAST_WORDS):
        out = mixed(out + hashes[step : step + count])
    return out


class Verbatim:
    """Passages of up to ``SHORT_WORDS`` words, by the hash of their first words, for exact search."""

    def __init__(self, bench: Benchmark) -> None:
        short = np.flatnonzero(bench.sizes <= SHORT_WORDS)
        first = np.array([_starts(bench.hashes[p][:LEAST_WORDS])[0] for p in short], np.uint64)
        order = np.argsort(first, kind="stable")
        self.bench, self.passages, self.first = bench, short[order], first[order]

    def find(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, passage, first word) of every passage whose words stand in a text one after another."""
        starts = _starts(hashes)
        for at in np.flatnonzero(np.isin(starts, self.first)):
            row = int(np.searchsorted(bounds, at, side="right")) - 1
            same = slice(*(int(np.searchsorted(self.first, starts[at], side=s)) for s in ("left", "right")))
            for passage in self.passages[same]:
                last = at + self.bench.sizes[passage]
                if last <= bounds[row + 1] and np.array_equal(hashes[at:last], self.bench.hashes[passage]):
                    yield row, int(passage), int(at)


def _search(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, bench = shared.value
        latent = bench.latent(projection)
        verbatim = Verbatim(bench)
        short = bench.sizes <= SHORT_WORDS
        groups = []
        for blocks, chosen in ((SHORT, np.flatnonzero(short)), (LONG, np.flatnonzero(~short))):
            for first in range(0, len(chosen), PASSAGES_AT_ONCE):
                groups.append((blocks, chosen[first : first + PASSAGES_AT_ONCE]))

        def masks_of(own: np.ndarray) -> np.ndarray:
            masks = np.zeros((len(own), VOCABULARY + 1), np.uint64)
            for i, p in enumerate(own):
                places = np.uint64(1) << np.arange(bench.sizes[p], dtype=np.uint64)
                np.bitwise_or.at(masks[i], _ids(bench.hashes[p]), places)
            return masks

        kept = {i: masks_of(own) for i, (_, own) in enumerate(groups[:8])}
        for batch in batches:
            out: list[tuple] = []
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                hashes, bounds, _ = words(part.column(1))
                ids = _ids(hashes)
                starts, begins = _blocks(bounds, BLOCK)
                if not len(starts):
                    continue
                sums = _sums(ids, starts, projection)
                doc = np.repeat(np.arange(part.num_rows), np.diff(begins))
                pairs = []
                for number, (blocks, own) in enumerate(groups):
                    masks = kept[number] if number in kept else masks_of(own)
                    pairs.append(_candidates(ids, bounds, starts, doc, sums, blocks, latent, bench, own, masks))
                best = {}
                for row, passage, at, similarity in zip(*map(np.concatenate, zip(*pairs, strict=True)), strict=True):
                    size = bench.sizes[passage]
                    region = hashes[max(bounds[row], at - BLOCK) : min(bounds[row + 1], at + LONG * BLOCK + BLOCK)]
                    share = common_words(bench.hashes[passage], region) / size
                    answer = float(np.isin(bench.answers[passage], region).mean())
                    if share >= COPY or (share >= bench.least[passage] and answer >= ANSWER):
                        key = (row, bench.items[passage])
                        found = (share, answer, float(similarity), -int(at - bounds[row]))
                        best[key] = max(best.get(key, found), found)
                for row, passage, at in verbatim.find(hashes, bounds):
                    key = (row, bench.items[passage])
                    if key not in best or best[key][0] < 1:
                        around = projection[ids[at : at + bench.sizes[passage]]].sum(axis=0)
                        cosine = float(latent[passage] @ around / max(float(np.linalg.norm(around)), 1e-12))
                        best[key] = (1.0, 1.0, cosine, -int(at - bounds[row]))
                ids_of = part.column(0)
                out += [(ids_of[int(r)].as_py(), i, *v) for (r, i), v in sorted(best.items(), key=lambda x: (x[0][0], repr(x[0][1])))]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], batch.schema.field(0).type),
                    pa.array(columns[1], pa.int64()),
                    *[pa.array(c, pa.float64()) for c in columns[2:5]],
                    pa.array([-x for x in columns[5]], pa.int64()),
                ],
                names=["doc_id", "item_id", "lcs_share", "answer_share", "similarity", "first_word"],
            )

    return find


def _candidates(ids, bounds, starts, doc, sums, blocks, latent, bench, own, masks):
    """Windows of ``blocks`` blocks that are close to passages and share enough words in their order.

    Returns (text, passage, first word, cosine) as arrays. The order is checked on hashed words,
    whose subsequences are never shorter than the real ones.
    """
    window = sums.copy()
    for step in range(1, blocks):
        inside = doc[step:] == doc[:-step]
        window[:-step][inside] += sums[step:][inside]
    stride = blocks // 2  # windows overlap by half; the last ones of a text are shorter
    index = np.arange(len(doc)) - np.searchsorted(doc, doc)
    window_at = np.flatnonzero(index % stride == 0)
    window = window[window_at]
    window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-12)
    # Each text's words stand apart from the next text's by a gap of no word, so that a region is a slice.
    reach = (blocks + 2) * BLOCK
    padded = np.full(len(ids) + reach * len(bounds), VOCABULARY, np.uint16)
    gaps = reach * np.arange(1, len(bounds))
    padded[np.arange(len(ids)) + np.repeat(gaps, np.diff(bounds))] = ids
    regions = np.lib.stride_tricks.sliding_window_view(padded, reach)
    region_at = starts[window_at] + reach * (doc[window_at] + 1) - BLOCK
    known = masks != 0
    found = []
    for first in range(0, len(window), BLOCKS_AT_ONCE):
        close = latent[own] @ window[first : first + BLOCKS_AT_ONCE].T
        some: list[tuple[np.ndarray, np.ndarray]] = []
        for p, line in enumerate(close):
            near = np.flatnonzero(line >= CANDIDATE)
            hits = known[p][regions[region_at[first + near]]].sum(axis=1)
            near = near[hits >= bench.least[own[p]] * bench.sizes[own[p]]]
            some.append((np.full(len(near), p), near))
        p, near = (np.concatenate(x) for x in zip(*some, strict=True))
        for at in range(0, len(p), 1 << 15):
            q, n = p[at : at + (1 << 15)], near[at : at + (1 << 15)]
            length = _subsequences(regions[region_at[first + n]], q, masks)
            enough = length >= bench.least[own[q]] * bench.sizes[own[q]]
            q, n = q[enough], n[enough]
            block = window_at[first + n]
            found.append((doc[block], own[q], starts[block], close[q, n]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _prepared(docs: DataFrame, benchmark: DataFrame):
    """What the tasks search with, as a broadcast; None if the benchmark has no passage."""
    bench = read_benchmark(benchmark)
    if not bench.items:
        return None
    projection, weights = fit(docs)
    bench.choose_answers(weights)
    return docs.sparkSession.sparkContext.broadcast((projection, bench))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per text and benchmark item found in it: doc_id, item_id, lcs_share (of a passage's words that
    the text has in order), answer_share, similarity (latent cosine) and first_word of the best window.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are not read. Null and empty
    texts hold nothing. Repeated rows and null ids are kept as they are. Without texts or items there
    are no rows. Texts are searched whole, however long, block by block.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, item_id long, lcs_share double, answer_share double, similarity double, first_word long"
    shared = _prepared(docs, benchmark)
    if shared is None:
        return spark.createDataFrame([], shape)
    return docs.select("doc_id", "text").mapInArrow(_search(shared), shape)


def without_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, all columns unchanged."""
    shared = _prepared(docs, benchmark)
    if shared is None:
        return docs
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["doc_id", "text"]
            )
            clean = np.ones(batch.num_rows, bool)
            for found in _search(shared)(iter([rows])):
                clean[found.column(0).to_numpy()] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
