"""Language-model scores by online logistic mixing of bit predictors.

A token is coded letter by letter in binary decisions: letters have a Huffman code of the training texts, a mark ends each
word, and a word of one blank stands for the end of a text. Once only one known word continues what has
been coded so far, a single decision says whether it is that word; a word that is not goes on bit by bit. Each
decision is predicted from several contexts: the last one to five letters, hashed into counts (``order_tables``), and the whole
word so far, from exact counts of all training words in a binary trie (``paths``). The predictions are added up as log-odds, with
weights that a gate selects by the kind of decision and the trie's certainty; a last table maps mixed odds to observed
frequencies. Counts, weights and table come from all training documents. For learning, every word is predicted from what
would be left of the counts without one of its documents (``left_of``), so no word vouches for itself. Blocks of words, by hash, are
fitted one by one and their curvatures added up (``fit_block``, ``merged_weights``).

Within a document the price of a token is refined adaptively (``refine``): five voices, that is the word's count, the mixed bits,
the bits of the letters alone, the document so far and what followed the same words before, are weighed by a gate that
knows how well such repetitions went, and the weights follow the document after every ``BLOCK`` tokens. The first weights are the
likeliest ones for the tokens of all training documents, which are tallied by how far each voice is behind the best
(``tallied``, ``first_voices``). What is predicted
depends on the corpus and on earlier tokens only, so the sum over a text is the logarithm of a probability.

At scale: the documents are read once, into chunks of ``CHUNK`` tokens with a vocabulary each. A chunk sends its words with their
counts to buckets by hash, packed, and gets their prices back the same way. The words with their counts are a Spark table that
grows with the corpus; they reach their trie cells by shuffle, cells that hold too many words being cut
further. Only letter contexts and weights are broadcast, in tables of a fixed size; what is learned reaches the driver as sums
of a fixed size.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from oreline.llm.common import Scratch, ship_package

CHUNK = 1 << 22  # tokens of documents that share a vocabulary; a longer document is alone
SCORED_AT_ONCE = 1 << 18  # tokens of a chunk
CLASS_BITS, BUCKET_WORDS = 16, 1 << 19  # words are hashed into classes; a bucket takes so many of all chunks' words
END = b" "  # the token after the last word of a text
STOP, SYMBOLS = 256, 257  # the mark after a word's last letter
ORDERS, SLOT_BITS = 5, 18
CELL_WORDS, CELL_BITS = 100_000, 6
FIT_WORDS = 1 << 13  # words that are fitted together
BLOCK = 32  # tokens between two updates
LANES = 256  # documents scored side by side
PREDICTORS = 1 + ORDERS
# Gates: whether it is the one known word left, by its count; letters alone, early and late in the word; the bits of the
# trie, by the tokens under the node, where known words go both ways and where they go one way.
LEAF_COUNTS, NODE_COUNTS = (2, 4, 16), (4, 16, 64, 1024)
LETTERS_ONLY, INSIDE = 4, 6
GATES = INSIDE + 2 * (len(NODE_COUNTS) + 1)
WORDS_AT_ONCE = 2048
ROWS_AT_ONCE = 1 << 14  # words, or slots, that leave a task together
FIT_AT_ONCE = 1 << 12  # decisions that are looked at together
VOICES, STATES = 5, 6
SCALE = 0.1  # log-odds are kept as whole numbers of tenths
SMALL = 0.3  # added to counts
BUCKETS = 24  # of the mixed log-odds in the last table
PRIOR = 20.0  # decisions, or tokens, that the weights given at first count as
LEVELS, STEP = 8, 0.8  # how far a voice is behind the best one, in steps of natural logarithms; the last level is far off


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


@dataclass
class Code:
    """A prefix code of the symbols: the length of each, its bits, and the tree nodes at which they are decided."""

    lengths: np.ndarray
    bits: np.ndarray
    nodes: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    heap = [(int(n) + 1, s, (s,)) for s, n in enumerate(counts)]
    heapq.heapify(heap)
    codes = [""] * len(counts)
    number = count(len(counts))
    while len(heap) > 1:
        (few, _, left), (many, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in (("0", left), ("1", right)):
            for symbol in side:
                codes[symbol] = bit + codes[symbol]
        heapq.heappush(heap, (few + many, next(number), left + right))
    longest = max(map(len, codes))
    bits, nodes = np.zeros((2, len(codes), longest), np.int64)
    for symbol, code in enumerate(codes):
        bits[symbol, : len(code)] = [int(b) for b in code]
    names: dict[str, int] = {}
    for symbol, code in enumerate(codes):
        for i in range(len(code)):
            nodes[symbol, i] = names.setdefault(code[:i], len(names))
    return Code(np.array([len(c) for c in codes]), bits.astype(np.uint8), nodes)


@dataclass
class Letters:
    """The bits of several words, one after the other, with what they are decided at."""

    sizes: np.ndarray  # bits of each word
    bits: np.ndarray
    slots: np.ndarray | None  # (ORDERS, bits): hashed letter contexts


def spelled(words: list[bytes], code: Code, contexts: bool = True) -> Letters:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols = np.full(int(sizes.sum()) + len(words), STOP, np.int64)
    letters = np.frombuffer(b"".join(words), np.uint8)
    symbols[np.arange(len(letters)) + np.repeat(np.arange(len(words)), sizes)] = letters
    lengths = code.lengths[symbols]
    place = _within(lengths)
    symbol = np.repeat(symbols, lengths)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    out = Letters(np.add.reduceat(lengths, starts) if len(words) else sizes, code.bits[symbol, place], None)
    if contexts:
        last, context = symbols, np.zeros(len(symbols), np.uint64)
        node = code.nodes[symbol, place].astype(np.uint64)
        out.slots = np.empty((ORDERS, len(symbol)), np.int64)
        for order in range(ORDERS):
            last = np.append(STOP, last[:-1])
            last[starts] = STOP
            context = context * np.uint64(SYMBOLS) + last.astype(np.uint64)
            key = np.repeat(mixed(context + np.uint64(order + 1 << 56)), lengths) + node
            out.slots[order] = (mixed(key) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
    return out


def _tenths(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(odds / SCALE), -127, 127).astype(np.int8)


def _odds(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.log((one + SMALL) / (other + SMALL))


# Chunks: documents as numbers of their words.


def _packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers byte by byte, all first bytes first, compressed."""
    width = np.dtype(kind).itemsize
    return zlib.compress(numbers.astype(kind, copy=False).view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _unpacked(data: bytes | pa.Buffer, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _listed(data: bytes) -> list[bytes]:
    return zlib.decompress(data).split(b"\n")


def _join(words: list[bytes]) -> bytes:
    """No word holds a line break."""
    return zlib.compress(b"\n".join(words), 1)


def _chunks(kind: pa.DataType, size: int):
    """(doc_id, held_out, text) -> chunks of about ``size`` tokens. Of each word they have ``n``, its tokens in training
    documents, and ``d``, the training documents that hold it."""

    def pack(docs: list, table: dict[bytes, int], number: int) -> pa.RecordBatch:
        ids, held, widths, texts = zip(*docs, strict=True)
        tokens, words = np.concatenate(texts), list(table)
        sizes = np.array([len(t) for t in texts])
        n, every = np.zeros((2, len(words)), np.int64)
        for some, at in _slices(sizes):
            own = np.repeat(~np.array(held[some]), sizes[some])
            n += np.bincount(tokens[at][own], minlength=len(words))
            every += np.bincount(tokens[at], minlength=len(words))
        d, last, spots = np.zeros(len(words), np.int64), np.empty(len(words), np.int32), np.arange(sizes.max(), dtype=np.int32)
        for own, out in zip(texts, held, strict=True):
            if not out:
                at = spots[: len(own)]
                last[own] = at
                d[own[last[own] == at]] += 1  # each word once
        letters = np.zeros(SYMBOLS, np.int64)
        for first in range(0, len(words), ROWS_AT_ONCE):
            some = words[first : first + ROWS_AT_ONCE]
            times = np.repeat(n[first : first + len(some)], list(map(len, some)))
            letters += np.bincount(np.frombuffer(b"".join(some), np.uint8), times, SYMBOLS).astype(np.int64)
        letters[STOP] = n.sum()
        # Frequent words get small numbers, which pack well; the vocabulary is listed by classes.
        by_count = np.argsort(-every, kind="stable")
        number_of = np.empty(len(words), np.uint32)
        number_of[by_count] = np.arange(len(words))
        tokens = number_of[tokens]
        classes = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) >> (32 - CLASS_BITS)
        order = np.argsort(classes, kind="stable")
        cells = {
            "chunk": pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
            "docs": pa.array([list(ids)], pa.list_(kind)),
            "held": pa.array([list(held)], pa.list_(pa.bool_())),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "bytes": pa.array([list(widths)], pa.list_(pa.int64())),
            "tokens": pa.array([_packed(tokens)], pa.binary()),
            "numbers": pa.array([_packed(number_of[order])], pa.binary()),
            "classes": pa.array([_packed(classes[order])], pa.binary()),
            "words": pa.array([_join([words[i] for i in order])], pa.binary()),
            "different": pa.array([len(words)], pa.int64()),
            "n": pa.array([_packed(n[order], "<i8")], pa.binary()),
            "d": pa.array([_packed(d[order], "<i8")], pa.binary()),
            "letters": pa.array([letters], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_pydict(cells)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list = []
        table: defaultdict[bytes, int] = defaultdict(count().__next__)
        held, number = 0, 0
        for batch in batches:
            ids, flags = (batch.column(k).to_pylist() for k in range(2))
            texts = batch.column(2).cast(pa.large_binary())
            for at in range(batch.num_rows):
                text = texts[at].as_py() or b""
                words = _tokens(text)
                if docs and held + len(words) > size:
                    yield pack(docs, table, number)
                    number, held, docs, table = number + 1, 0, [], defaultdict(count().__next__)
                tokens = np.fromiter(map(table.__getitem__, words), np.int32, len(words))
                docs.append((ids[at], flags[at], len(text), tokens))
                held += len(words)
        if docs:
            yield pack(docs, table, number)

    return gather


def _tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def _chunked(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    shape = (
        f"chunk long, docs array<{kind.simpleString()}>, held array<boolean>, sizes array<long>, bytes array<long>, "
        "tokens binary, numbers binary, classes binary, words binary, different long, n binary, d binary, letters array<long>"
    )
    return docs.mapInArrow(_chunks(to_arrow_type(kind), CHUNK), shape)


def _sent(buckets: int):
    """Chunks -> (bucket, chunk, words, n, d): what each bucket gets of a chunk's vocabulary."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, classes = _listed(row["words"]), _unpacked(row["classes"]).astype(np.int64)
                n, d = (_unpacked(row[c], "<i8") for c in ("n", "d"))
                edges = np.searchsorted(classes * buckets >> CLASS_BITS, np.arange(buckets + 1))
                parts = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
                cells = [
                    pa.array([k for k, _ in parts], pa.int64()),
                    pa.array([row["chunk"]] * len(parts), pa.int64()),
                    pa.array([_join(words[own]) for _, own in parts], pa.binary()),
                    *(pa.array([_packed(x[own], "<i8") for _, own in parts], pa.binary()) for x in (n, d)),
                ]
                yield pa.RecordBatch.from_arrays(cells, names=["bucket", "chunk", "words", "n", "d"])

    return send


def _merged(code: Code):
    """All that a bucket got -> (bucket, word, n, d, bits), a row a word; bits are a text of zeros and ones."""

    def merge(key: tuple, sent: pa.Table) -> pa.Table:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        at = [np.zeros(0, np.int64)]
        for data in sent["words"]:
            words = _listed(data.as_py())
            at.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        place, words = np.concatenate(at), list(number)
        sums = np.zeros((2, len(words)), np.int64)
        for own, column in zip(sums, ("n", "d"), strict=True):
            np.add.at(own, place, np.concatenate([_unpacked(x.as_py(), "<i8") for x in sent[column]]))
        return pa.concat_tables(
            pa.table({
                "bucket": np.full(len(some), key[0].as_py()), "word": pa.array(some, pa.binary()),
                "n": sums[0, first : first + len(some)], "d": sums[1, first : first + len(some)], "bits": bit_texts(some, code),
            })
            for first in range(0, max(1, len(words)), ROWS_AT_ONCE)
            for some in [words[first : first + ROWS_AT_ONCE]]
        )

    return merge


def bit_texts(words: list[bytes], code: Code) -> pa.Array:
    """The bits of each word, as a text of zeros and ones."""
    parts = []
    for first in range(0, max(1, len(words)), WORDS_AT_ONCE):
        own = spelled(words[first : first + WORDS_AT_ONCE], code, contexts=False)
        ends = np.append(0, np.cumsum(own.sizes)).astype(np.int32)
        parts.append(pa.StringArray.from_buffers(len(own.sizes), pa.py_buffer(ends), pa.py_buffer(own.bits + np.uint8(48))))
    return pa.concat_arrays(parts)


def _in_parts(rows: pa.Table) -> pa.Table:
    """The same rows in batches of a bounded size, as they are sent one by one."""
    return pa.Table.from_batches(rows.to_batches(max_chunksize=ROWS_AT_ONCE), rows.schema)


# The trie of all training words.


def _order_counts(code: Code):
    """(word, n) -> (slot, ones, both): ones, and all bits, in each hashed context of a task's words."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ORDERS << SLOT_BITS + 1, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(first, WORDS_AT_ONCE)
                own = spelled(part.column(0).to_pylist(), code)
                weight = np.repeat(part.column(1).to_numpy(), own.sizes)
                for order in range(ORDERS):
                    np.add.at(sums, (own.slots[order] + (order << SLOT_BITS)) * 2 + own.bits, weight)
        ones = sums[1::2]
        both = sums[::2] + ones
        for first in range(0, len(both), ROWS_AT_ONCE):
            at = np.flatnonzero(both[first : first + ROWS_AT_ONCE]) + first
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(ones[at]), pa.array(both[at])], names=["slot", "ones", "both"]
            )

    return add


def order_counts(words: DataFrame, number: int, code: Code) -> np.ndarray:
    """(ORDERS, slots, 2): zeros and ones in each hashed context of one to ``ORDERS`` letters, in tables of a fixed size.

    ``number`` words are added up in tasks of many words each, as every task may fill the tables.
    """
    some = words.filter("n > 0").select("word", "n").coalesce(max(1, number // (2 * CELL_WORDS)))
    parts = some.mapInArrow(_order_counts(code), "slot long, ones long, both long")
    ones, both = F.sum("ones"), F.sum("both")
    sums = parts.groupBy("slot").agg((both - ones).cast("float").alias("zeros"), ones.cast("float").alias("ones"))
    sums = sums.select(F.col("slot").cast("int"), "zeros", "ones").toArrow()
    out = np.zeros((ORDERS << SLOT_BITS, 2), np.float32)
    out[sums["slot"].to_numpy()] = np.stack([sums["zeros"].to_numpy(), sums["ones"].to_numpy()], axis=1)
    return out.reshape(ORDERS, -1, 2)


def order_tables(counts: np.ndarray) -> np.ndarray:
    """Log-odds of a one in each context, in tenths."""
    return _tenths(_odds(counts[:, :, 1], counts[:, :, 0]))


@dataclass
class Cells:
    """Parts of the trie: where words with these first bits are cut further, and what lies under every node above."""

    cuts: dict[str, int] = field(default_factory=dict)
    above: dict[str, tuple[int, int]] = field(default_factory=dict)  # tokens, known words


def fit_cells(words: DataFrame) -> Cells:
    """Cut the trie until no cell holds more than ``CELL_WORDS`` words. A crowded cell is cut behind the first bits that all
    its words share, so every round parts its words."""
    cells = Cells()
    done: dict[str, tuple[int, int]] = {}
    sums = [
        F.count("*").alias("words"), F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("known"),
        F.min("bits").alias("least"), F.max("bits").alias("most"),
    ]
    found = [("", words.agg(*sums).first())]
    while True:
        crowded = {}
        for cell, row in found:
            if row["words"] <= CELL_WORDS:
                done[cell] = (row["tokens"] or 0, row["known"])
                continue
            least, most = row["least"], row["most"]
            shared = next(i for i in range(len(least)) if least[i] != most[i])
            crowded[cell] = shared + CELL_BITS
        if not crowded:
            break
        cells.cuts.update(crowded)
        # One row a cell; there are no more cells than CELL_WORDS goes into the words, times 2 ** CELL_BITS.
        rows = words.select("n", "bits", _cut(crowded).alias("cut")).filter("cut is not null")
        rows = rows.groupBy(F.expr("substring(bits, 1, cut)").alias("cell")).agg(*sums)
        found = [(r["cell"], r) for r in rows.collect()]
    for cell, (tokens, known) in done.items():
        for depth in range(len(cell) + 1):
            a, b = cells.above.get(cell[:depth], (0, 0))
            cells.above[cell[:depth]] = (a + tokens, b + known)
    return cells


def _cut(crowded: dict[str, int]) -> Column:
    """Where words of crowded cells, none of which holds another, are cut; null for other words."""
    alike = defaultdict(list)
    for cell, cut in sorted(crowded.items()):
        alike[len(cell), cut].append(cell)
    return F.coalesce(
        *(F.when(F.substring("bits", 1, length).isin(own), F.lit(cut)) for (length, cut), own in alike.items())
    )


def _placed(words: DataFrame, cells: Cells) -> DataFrame:
    """Words with their cell."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for bits in batch.column(4).to_pylist():
                cell = ""
                while cell in cells.cuts:
                    cell = bits[: cells.cuts[cell]]
                own.append(cell)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.string()), *batch.columns[:4]], names=["cell", *batch.schema.names[:4]]
            )

    shape = "cell string, bucket long, word binary, n long, d long"
    return words.select("bucket", "word", "n", "d", "bits").mapInArrow(place, shape)


KNOWN, REFUSED, OFF = 0, 1, 2  # how a word leaves the trie: as the only one left, not as it, or where none is left


def left_of(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What is left of words' tokens without one of the documents that hold them, on average; nothing if there is but one."""
    return n - n / np.maximum(d, 1)


class _Ways:
    """Paths in the making, of words whose bits are one after the other."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.starts = np.cumsum(sizes) - sizes
        self.odds, self.gate = np.zeros((2, int(sizes.sum())), np.int8)
        self.depth, self.way = np.zeros(len(sizes), np.int64), np.full(len(sizes), OFF)
        self.last, self.last_gate = np.zeros((2, len(sizes)), np.int8)

    def leave(self, out: np.ndarray, depth: int, one: np.ndarray, known: np.ndarray, tokens: np.ndarray) -> None:
        """Words ``out`` leave: where there is ``one`` word left of so many tokens; whether they are ``known``."""
        self.depth[out] = depth
        self.way[out] = np.where(one, np.where(known, KNOWN, REFUSED), OFF)
        certain = _odds(tokens, 0)
        self.last[out] = _tenths(np.where(known, certain, -certain))
        self.last_gate[out] = np.digitize(tokens, LEAF_COUNTS)

    def go(self, words: np.ndarray, depth: int, own: np.ndarray, here: np.ndarray) -> None:
        """Words go on to a side with ``own`` of the tokens that are ``here``."""
        at = self.starts[words] + depth
        self.odds[at] = _tenths(_odds(own, here - own))
        one_way = (own == 0) | (own == here)
        self.gate[at] = INSIDE + np.digitize(here, NODE_COUNTS) + one_way * (len(NODE_COUNTS) + 1)

    def paths(self) -> list[bytes]:
        odds, gates, last, last_gates = (x.tobytes() for x in (self.odds, self.gate, self.last, self.last_gate))
        cells = zip(self.starts.tolist(), (self.starts + self.depth).tolist(), self.way.tolist(), strict=True)
        return [
            bytes([w]) + odds[a:b] + last[i : i + (w != OFF)] + gates[a:b] + last_gates[i : i + (w != OFF)]
            for i, (a, b, w) in enumerate(cells)
        ]


def walk(
    bits: list[str], m: np.ndarray, above: list[tuple[int, int]], left: np.ndarray | None = None
) -> list[bytes] | tuple[list[bytes], list[bytes]]:
    """The path of every word of a cell; ``bits`` ascend, ``above`` is what lies under the nodes down to the cell's own.

    A path is how the word leaves the trie, the log-odds (in tenths) of its own bits down to there and, unless
    no known word is left, of its being the one that is; then as many gates. With ``left`` there are also the paths that
    words would have if so much were left of their own ``m`` tokens, the other words' being as they are.
    """
    sizes = np.fromiter(map(len, bits), np.int64, len(bits))
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer("".join(bits).encode(), np.uint8) - 48
    ways, lone = _Ways(sizes), None if left is None else _Ways(sizes)
    if lone is not None:
        less, gone = m - left, np.zeros(len(bits), bool)
        lost = (m > 0) & (left == 0)
    live, new = np.arange(len(bits)), np.zeros(len(bits), bool)
    new[:1] = True
    depth = 0
    while len(live):
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        if depth < len(above):  # all words share these bits
            tokens, known = (np.array([x]) for x in above[depth])
        else:
            tokens = np.add.reduceat(m[live], first)
            known = np.add.reduceat((m[live] > 0).astype(np.int64), first)
        if lone is not None:
            others = known[group] - lost[live]
            ends = (others <= 1) & ~gone[live]
            out = live[ends]
            lone.leave(out, depth, others[ends] == 1, left[out] > 0, tokens[group[ends]] - less[out])
            gone[out] = True
        leaves = known[group] <= 1
        out = live[leaves]
        ways.leave(out, depth, known[group[leaves]] == 1, m[out] > 0, tokens[group[leaves]])
        live, group = live[~leaves], group[~leaves]
        if not len(live):
            break
        bit = flat[starts[live] + depth]
        new = np.append(True, (group[1:] != group[:-1]) | (bit[1:] != bit[:-1]))
        if depth + 1 < len(above):
            own = np.full(len(live), above[depth + 1][0])
        else:
            own = np.add.reduceat(m[live], np.flatnonzero(new))[np.cumsum(new) - 1]
        here = tokens[group]
        ways.go(live, depth, own, here)
        if lone is not None:
            on = ~gone[live]
            lone.go(live[on], depth, own[on] - less[live[on]], here[on] - less[live[on]])
        depth += 1
    return ways.paths() if lone is None else (ways.paths(), lone.paths())


def in_cells(words: DataFrame, cells: Cells, code: Code) -> DataFrame:
    """(bucket, word, n, d, path, lone): the words with their paths, and those they have without one of their documents."""

    def own(key: tuple, rows: pa.Table) -> pa.Table:
        bits = bit_texts(rows["word"].to_pylist(), code)
        order = pc.sort_indices(bits)
        rows, bits = rows.take(order), bits.take(order)
        cell = key[0].as_py()
        above = [cells.above[cell[:depth]] for depth in range(len(cell) + 1)]
        n, d = rows["n"].to_numpy(), rows["d"].to_numpy()
        paths, lone = walk(bits.to_pylist(), n, above, left_of(n, d))
        lone = pa.array(lone, pa.binary(), mask=n == 0)  # nothing is learned from these
        out = rows.drop_columns(["cell"]).append_column("path", pa.array(paths, pa.binary())).append_column("lone", lone)
        return _in_parts(out)

    return _placed(words, cells).groupBy("cell").applyInArrow(own, "bucket long, word binary, n long, d long, path binary, lone binary")


# Prices of words.


@dataclass
class Decisions:
    """What is decided for each of some words, one word after the other."""

    starts: np.ndarray
    sizes: np.ndarray
    inputs: np.ndarray  # log-odds of what is so, by trie and letters, in tenths
    gate: np.ndarray


def decisions(
    words: list[bytes], ways: list[bytes], code: Code, tables: np.ndarray, less: np.ndarray | None = None
) -> tuple[Decisions, Decisions]:
    """The decisions of each word as the trie has it, and those of all its bits by letters alone. With ``less`` the tables are
    counts (``order_counts``), from which so many of each word's own tokens are taken."""
    letters = spelled(words, code)
    bit_starts = np.cumsum(letters.sizes) - letters.sizes
    sign = letters.bits.astype(np.int8) * 2 - 1
    plain = np.zeros((len(sign), PREDICTORS), np.int8)
    for order in range(ORDERS):
        if less is None:
            plain[:, order + 1] = tables[order][letters.slots[order]] * sign
        else:
            counts, at = tables[order].ravel(), letters.slots[order] * 2
            own = np.maximum(counts[at + letters.bits] - np.repeat(less, letters.sizes).astype(np.float32), 0)
            plain[:, order + 1] = _tenths(_odds(own, counts[at + 1 - letters.bits]))
    bit = _within(letters.sizes)
    far = (LETTERS_ONLY + (bit >= 8)).astype(np.uint8)
    alone = Decisions(bit_starts, letters.sizes, plain, far)

    way = np.fromiter((p[0] for p in ways), np.int64, len(ways))
    lengths = (np.fromiter(map(len, ways), np.int64, len(ways)) - 1) // 2
    asks = way != OFF
    depth = lengths - asks
    sizes = np.where(way == KNOWN, depth + 1, letters.sizes + asks)
    starts = np.cumsum(sizes) - sizes
    place = _within(sizes)
    depths, asked = np.repeat(depth, sizes), np.repeat(asks, sizes)
    leaves, inside = (place == depths) & asked, place < depths
    bit = np.minimum(place - ((place > depths) & asked), np.repeat(letters.sizes - 1, sizes))
    at = np.repeat(bit_starts, sizes) + bit
    inputs = plain[at]
    inputs[leaves] = 0
    given = inside | leaves
    trie = np.frombuffer(b"".join(ways), np.int8)
    path_starts = np.cumsum(2 * lengths + 1) - 2 * lengths  # behind the first byte
    source = (np.repeat(path_starts, sizes) + place)[given]
    inputs[given, 0] = trie[source]
    gate = far[at]
    gate[given] = trie[source + np.repeat(lengths, sizes)[given]]
    return Decisions(starts, sizes, inputs, gate), alone


@dataclass
class Weights:
    """What is learned from the training documents."""

    mix: np.ndarray  # of each gate's predictors
    right: np.ndarray  # of each gate and bucket of mixed odds: how often the likelier side was right
    voices: np.ndarray  # of each state, the logarithms of the voices' first weights


def fresh_weights() -> Weights:
    mix = np.full((GATES, PREDICTORS), 0.05, np.float32)
    mix[:, 0] = 0.9
    mix[LETTERS_ONLY : LETTERS_ONLY + 2] = [0.0, *[0.3] * ORDERS]
    right = np.tile(1 / (1 + np.exp(-(np.arange(BUCKETS) + 0.5) / 3)), GATES)
    voices = np.log(np.array([[0.6, 0.3, 0.05, 0.05, 0.001]] + [[0.55, 0.28, 0.05, 0.05, 0.07]] * (STATES - 1)))
    return Weights(mix, right, voices)


def _mixed_odds(inputs: np.ndarray, gate: np.ndarray, mix: np.ndarray) -> np.ndarray:
    odds = np.einsum("nk,nk->n", inputs.astype(np.float32), mix[gate]) * np.float32(SCALE)
    return np.clip(odds, -12, 12)


def _bucket(odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return np.minimum(np.abs(odds) * 3, BUCKETS - 1).astype(np.int64) + gate.astype(np.int64) * BUCKETS


def _chances(plan: Decisions, weights: Weights) -> np.ndarray:
    """Of each decision, the probability of what is so."""
    odds = _mixed_odds(plan.inputs, plan.gate, weights.mix)
    return _agreed(odds, weights.right[_bucket(odds, plan.gate)])


def _agreed(odds: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The probabilities by odds and by how often the likelier side is right, half each."""
    # Even odds have no likelier side; both have one half.
    rate = np.where(odds > 0, rate, np.where(odds < 0, 1 - rate, 0.5))
    return 0.5 / (1 + np.exp(-odds)) + 0.5 * rate


def _fit(inputs: np.ndarray, tokens: np.ndarray, start: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The likeliest weights of a gate's predictors, for decisions of so many tokens each, by Newton's method; and the curvature
    and what it is to be solved for there, without the prior."""
    x = np.ascontiguousarray(inputs.T, np.float32) * np.float32(SCALE)
    held = PRIOR * np.eye(PREDICTORS)

    def seen(mix: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The loss with these weights, the curvature and the slope."""
        own, loss = mix.astype(np.float32), PRIOR / 2 * float(((mix - start) ** 2).sum())
        curve, pull = np.zeros((PREDICTORS, PREDICTORS)), np.zeros(PREDICTORS)
        for first in range(0, len(tokens), FIT_AT_ONCE):
            part, times = x[:, first : first + FIT_AT_ONCE], tokens[first : first + FIT_AT_ONCE]
            against = np.exp(-np.clip(own @ part, -15, 15))
            wrong = against / (1 + against)
            pulls = times * wrong
            loss += float(times @ np.log(1 + against))
            curve += (part * (pulls * (1 - wrong))) @ part.T
            pull += part @ pulls
        return loss, (curve + curve.T) / 2, pull

    mix = start.astype(np.float64)
    least, curve, pull = seen(mix)
    for _ in range(rounds):
        step = np.linalg.solve(curve + held, pull - held @ (mix - start))
        for _ in range(4):
            loss, *bent = seen(mix + step)
            if loss <= least:
                break
            step /= 2
        else:
            break
        gain, mix, least, (curve, pull) = least - loss, mix + step, loss, bent
        if gain <= 1e-3 * least:
            break
    return mix, curve, curve @ mix + pull


def fit_block(
    words: list[bytes], n: np.ndarray, d: np.ndarray, ways: list[bytes], code: Code, counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Learn from all training tokens of a block's words, each predicted without one of its documents, whose paths are ``ways``:
    what ``merged_weights`` adds up, and the words' prices (as from ``prices``) by the block's own weights."""
    start = fresh_weights()
    less = n - left_of(n, d)
    plans: list[tuple[int, int, Decisions]] = []
    for first in range(0, len(words), WORDS_AT_ONCE):
        some = slice(first, first + WORDS_AT_ONCE)
        both = decisions(words[some], ways[some], code, counts, less[some])
        plans += [(row, first, plan) for row, plan in enumerate(both)]
    inputs = np.concatenate([plan.inputs for *_, plan in plans])
    gate = np.concatenate([plan.gate for *_, plan in plans])
    tokens = np.concatenate([np.repeat(n[first : first + len(plan.sizes)], plan.sizes) for _, first, plan in plans]).astype(np.float32)
    curves, pulls = np.zeros((GATES, PREDICTORS, PREDICTORS)), np.zeros((GATES, PREDICTORS))
    mix = start.mix.copy()
    order = np.argsort(gate, kind="stable")
    edges = np.searchsorted(gate[order], np.arange(GATES + 1))
    for g, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            own = order[a:b]
            found, curves[g], pulls[g] = _fit(inputs[own], tokens[own], start.mix[g].astype(np.float64))
            mix[g] = np.round(found, 4)
    odds = _mixed_odds(inputs, gate, mix)
    bucket = _bucket(odds, gate)
    right, seen = (np.bincount(bucket, tokens * own, GATES * BUCKETS) for own in (odds > 0, 1.0))
    chances = np.log(_agreed(odds, _frequencies(right, seen, start)[bucket]).astype(np.float64))
    out, begin = np.zeros((2, len(words))), 0
    for row, first, plan in plans:
        out[row, first : first + len(plan.sizes)] = np.add.reduceat(chances[begin : begin + len(plan.gate)], plan.starts)
        begin += len(plan.gate)
    return np.concatenate([curves.ravel(), pulls.ravel(), right, seen]), out


def _frequencies(right: np.ndarray, seen: np.ndarray, start: Weights) -> np.ndarray:
    return np.clip((right + PRIOR * start.right) / (seen + PRIOR), 0.5, 1 - 1e-5)


FIT_SUMS = GATES * (PREDICTORS * PREDICTORS + PREDICTORS + 2 * BUCKETS)


def merged_weights(sums: np.ndarray) -> Weights:
    """The weights of all blocks, from the sums of what ``fit_block`` found: where the sum of the blocks' parabolas is best."""
    start = fresh_weights()
    sizes = [GATES * PREDICTORS * PREDICTORS, GATES * PREDICTORS, GATES * BUCKETS]
    curves, pulls, right, seen = np.split(sums, np.cumsum(sizes))
    held = PRIOR * np.eye(PREDICTORS)
    curves, pulls = curves.reshape(GATES, PREDICTORS, PREDICTORS) + held, pulls.reshape(GATES, PREDICTORS) + PRIOR * start.mix
    # Rounded, so that the order of the sums shows in no decision.
    mix = np.round(np.linalg.solve(curves, pulls[:, :, None])[:, :, 0], 4).astype(np.float32)
    return Weights(mix, _frequencies(right, seen, start), start.voices)


def prices(words: list[bytes], ways: list[bytes], code: Code, tables: np.ndarray, weights: Weights) -> np.ndarray:
    """(2, words): the natural logarithms of each word's probability by all predictors, and by letters alone."""
    out = np.zeros((2, len(words)))
    for first in range(0, len(words), WORDS_AT_ONCE):
        some = slice(first, first + WORDS_AT_ONCE)
        for row, plan in enumerate(decisions(words[some], ways[some], code, tables)):
            out[row, some] = np.add.reduceat(np.log(_chances(plan, weights).astype(np.float64)), plan.starts)
    return out


# Documents.


def _earlier(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place before each one that has the same key, -1 for the first; and how many there are before.

    Keys are below 2 ** 63 / their number.
    """
    n = len(key)
    ordered = np.sort(key * n + np.arange(n))
    order = ordered % max(1, n)
    new = np.append(True, (ordered[1:] // n) != (ordered[:-1] // n))[:n]
    before = np.where(new, -1, np.append(-1, order[:-1])[:n])
    first = np.flatnonzero(new)
    rank = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    out, count_before = np.empty((2, n), np.int64)
    out[order], count_before[order] = before, rank
    return out, count_before


def _expected(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its share of the document before it, whether what is expected here comes, and the state of
    expectations: none, after one word, after two, and how many came true in a row."""
    before, hit, state = _expected_counts(tokens, sizes)
    return before / np.maximum(_within(sizes), 1), hit, state


def _expected_counts(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_expected``, with how often the token is in the document before it."""
    document = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
    place = _within(sizes)
    keep = np.uint64((2**63 - 1) // max(1, len(tokens)))
    word = mixed(document << np.uint64(32) | tokens.astype(np.uint64))
    last, before = _earlier((word % keep).astype(np.int64))
    # What followed the word before where it stood last; better, what followed the two words before.
    single = np.append(-1, np.where(last >= 0, last + 1, -1)[:-1])
    single[place == 0] = -1
    pair = np.append(np.uint64(0), mixed(np.append(np.uint64(0), word[:-1]) + mixed(word))[:-1])
    double, _ = _earlier((pair % keep).astype(np.int64))
    double[(place < 2) | (double < np.arange(len(tokens)) - place + 2)] = -1
    source = np.where(double >= 0, double, single)
    hit = (source >= 0) & (tokens[source] == tokens)
    number = np.cumsum(hit)
    missed = np.maximum.accumulate(np.where(hit, 0, number))
    row = np.append(0, (number - missed)[:-1])
    row[place == 0] = 0
    state = np.where(source < 0, 0, np.where(row > 0, 3 + (row >= 4) + (row >= 16), 1 + (double >= 0)))
    return before, hit, state


def refine(
    voices: np.ndarray, state: np.ndarray, sizes: np.ndarray, start: np.ndarray, rate: float = 0.6, learn: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """The natural logarithm of each document's probability, and the first weights.

    ``voices`` are logarithms of the tokens' probabilities (tokens, VOICES). Weights are the softmax of the state's own and
    the document's drift, which follows the gradient after every ``BLOCK`` tokens; with ``learn`` the first weights do
    so as well.
    """
    out = np.zeros(len(sizes))
    begins = np.cumsum(sizes) - sizes
    start = start.copy()
    most = voices.max(axis=1)
    said = np.exp(voices - most[:, None])
    order = np.argsort(-sizes, kind="stable")
    for first in range(0, len(order), LANES):
        lanes = order[first : first + LANES]
        drift = np.zeros((len(lanes), VOICES))
        for step in range(0, int(sizes[lanes[0]]), BLOCK):
            n = int(np.searchsorted(-sizes[lanes], -step, side="left"))  # documents that go on
            taken = np.minimum(BLOCK, sizes[lanes[:n]] - step)
            edge = np.cumsum(taken) - taken
            at = np.repeat(begins[lanes[:n]] + step - edge, taken) + np.arange(int(taken.sum()))
            weights = start[None] + drift[:n, None]
            weights[:, 0, VOICES - 1] = -50.0  # nothing is expected
            weights = np.exp(weights - weights.max(axis=2, keepdims=True))
            weights /= weights.sum(axis=2, keepdims=True)
            gate = state[at]
            weight = weights.reshape(-1, VOICES)[np.repeat(np.arange(n) * STATES, taken) + gate]
            part = weight * said[at]
            total = part.sum(axis=1)
            out[lanes[:n]] += np.add.reduceat(most[at] + np.log(total), edge)
            pull = part / total[:, None] - weight
            drift[:n] += rate * np.add.reduceat(pull, edge, axis=0) / np.sqrt(taken)[:, None]
            if learn:
                many = np.maximum(1, np.bincount(gate, minlength=STATES))
                for k in range(VOICES):
                    start[:, k] += learn * np.bincount(gate, pull[:, k], STATES) / np.sqrt(many)
    return out, start


def log_known(counts: np.ndarray) -> np.ndarray:
    """Logarithms of words' counts as the first voice has them; what is not there it does not say."""
    with np.errstate(divide="ignore"):
        return np.log(np.where(counts > 0, counts + 0.1, 0.0))


def _voices(tokens: np.ndarray, share: np.ndarray, hit: np.ndarray, known: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The voices of each token, as logarithms. ``known`` are the logarithms of the words' shares in training, ``logs`` their
    prices; ``share`` and ``hit`` are as from ``_expected``."""
    out = np.empty((len(tokens), VOICES))
    with np.errstate(divide="ignore"):
        out[:, 0], out[:, 1], out[:, 2] = known[tokens], logs[0][tokens], logs[1][tokens]
        out[:, 3], out[:, 4] = np.log(share), np.where(hit, 0.0, -np.inf)
    return out


@dataclass
class Model:
    """What every task needs besides the prices of its words."""

    code: Code
    tables: np.ndarray
    weights: Weights
    tokens: int  # in training
    different: int


def tallied(voices: np.ndarray, state: np.ndarray) -> np.ndarray:
    """How many tokens there are of each state and each distance of the voices from the best one, in ``LEVELS``."""
    columns = np.ascontiguousarray(voices.T, np.float32)
    best = columns[0]
    for column in columns[1:]:
        best = np.maximum(best, column)
    key = state.astype(np.int32)
    for column in columns:
        key = key * LEVELS + np.minimum((best - column) * np.float32(1 / STEP) + np.float32(0.5), LEVELS - 1).astype(np.int32)
    return np.bincount(key, minlength=STATES * LEVELS**VOICES)


def first_voices(keys: np.ndarray, tokens: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Of each state, the logarithms of the voices' likeliest weights for the tallied tokens, by expectation and maximisation."""
    start = np.exp(fresh_weights().voices)
    start /= start.sum(axis=1, keepdims=True)
    levels = np.stack(np.unravel_index(keys, (STATES, *[LEVELS] * VOICES)))
    state, said = levels[0], np.where(levels[1:].T == LEVELS - 1, 0.0, np.exp(-STEP * levels[1:].T))
    weights = start.copy()
    for _ in range(rounds):
        part = weights[state] * said
        part *= (tokens / part.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(state, part[:, k], STATES) for k in range(VOICES)], axis=1)
        weights = sums + PRIOR * start
        weights /= weights.sum(axis=1, keepdims=True)
    return np.log(weights)


# Prices of words, and what weights are learned from: logarithms of what is left of their counts, of which a few digits do.
PRICES = {"mixed": "<f4", "letters": "<f4", "left": "<f2", "lone_mixed": "<f2", "lone_letters": "<f2"}


def _answer(priced: pa.Table, sent: pa.Table) -> pa.Table:
    """A bucket's prices, and what the chunks asked it for -> (chunk, bucket, n and the ``PRICES``), packed."""
    place = {word: i for i, word in enumerate(priced["word"].to_pylist())}
    n, found = priced["n"].to_numpy(), []
    for data in sent["words"]:
        words = _listed(data.as_py())
        found.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
    columns = {c: priced[c].to_numpy().clip(-60_000).astype(kind) for c, kind in PRICES.items()}
    return pa.table({
        "chunk": sent["chunk"], "bucket": sent["bucket"],
        "n": pa.array([_packed(n[at], "<i8") for at in found], pa.binary()),
        **{c: pa.array([x[at].tobytes() for at in found], pa.binary()) for c, x in columns.items()},
    })


def _slices(sizes: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Documents that are looked at together, and their tokens."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, before + SCORED_AT_ONCE, side="right")))
        yield slice(first, last), slice(before, int(ends[last - 1]))
        first = last


def _hear(total: float):
    """A chunk with the prices of its words -> what scoring needs of it, and the tallies of its training documents' tokens."""

    def hear(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        numbers = _unpacked(chunk["numbers"][0].as_buffer())
        n, logs = np.empty(len(numbers), np.int64), np.empty((len(PRICES), len(numbers)), np.float32)
        n[numbers] = np.concatenate([_unpacked(x.as_py(), "<i8") for x in answers["n"]])
        for row, (column, kind) in zip(logs, PRICES.items(), strict=True):
            row[numbers] = np.frombuffer(b"".join(answers[column].to_pylist()), kind)
        tokens, sizes = _unpacked(chunk["tokens"][0].as_buffer()), np.array(chunk["sizes"][0].as_py())
        held = np.array(chunk["held"][0].as_py())
        before, state = np.empty(len(tokens), np.uint32), np.empty(len(tokens), np.uint8)
        tally = np.zeros(STATES * LEVELS**VOICES, np.int64)
        for some, at in _slices(sizes):
            part, own = tokens[at].astype(np.int64), sizes[some]
            before[at], hit, states = _expected_counts(part, own)
            state[at] = states * 2 + hit
            learned = np.repeat(~held[some], own)
            if learned.any():
                share = before[at] / np.maximum(_within(own), 1)
                part, share, hit, states = (x[learned] for x in (part, share, hit, states))
                tally += tallied(_voices(part, share, hit, logs[2] - np.log(max(total, 0.1)), logs[3:]), states)
        keys = np.flatnonzero(tally)
        return pa.table({
            **{c: chunk[c] for c in ("docs", "held", "sizes", "bytes", "tokens")},
            "n": pa.array([_packed(n, "<i8")], pa.binary()),
            "logs": pa.array([logs[:2].tobytes()], pa.binary()),
            "before": pa.array([_packed(before)], pa.binary()),
            "state": pa.array([_packed(state, "u1")], pa.binary()),
            "tally": pa.array([[{"at": a, "tokens": t} for a, t in zip(keys.tolist(), tally[keys].tolist(), strict=True)]],
                              pa.list_(pa.struct([("at", pa.int64()), ("tokens", pa.int64())]))),
        })

    return hear


def _judge(shared, kind: pa.DataType):
    """Chunks as ``_hear`` leaves them -> their documents' scores."""

    def judged(batch: pa.RecordBatch, row: int) -> pa.RecordBatch:
        model: Model = shared.value
        packed = {c: batch[c][row].as_buffer() for c in ("tokens", "n", "logs", "before", "state")}  # where they lie
        n, logs = _unpacked(packed["n"], "<i8"), np.frombuffer(packed["logs"], "<f4").reshape(2, -1)
        before, state = _unpacked(packed["before"]), _unpacked(packed["state"], "u1")
        docs, held, sizes, width = (batch[c][row].values for c in ("docs", "held", "sizes", "bytes"))
        tokens, sizes = _unpacked(packed["tokens"]), sizes.to_numpy()
        total = model.tokens + 0.1 * model.different
        price = np.log10((n + 0.1) / (total + 0.1))
        known_share = log_known(n) - np.log(max(total, 0.1))
        score, base, known = np.empty(len(sizes)), np.empty(len(sizes)), np.empty(len(sizes), np.int64)
        for some, at in _slices(sizes):
            part, own = tokens[at].astype(np.int64), sizes[some]
            share, states = before[at] / np.maximum(_within(own), 1), state[at].astype(np.int64)
            voices = _voices(part, share, (states & 1) == 1, known_share, logs)
            score[some], _ = refine(voices, states >> 1, own, model.weights.voices)
            begins = np.cumsum(own) - own
            base[some] = np.add.reduceat(price[part], begins)
            known[some] = np.add.reduceat((n > 0)[part].astype(np.int64), begins)
        width = width.to_numpy().astype(np.float64)
        bits = pa.array(-score / np.log(2) / np.maximum(width, 1), mask=width == 0)
        return pa.RecordBatch.from_pydict({
            "doc_id": docs.cast(kind),
            "held_out": held,
            "n_tokens": sizes,
            "n_known": known,
            "train_tokens": np.full(len(sizes), model.tokens),
            "base_score": base,
            "score": score / np.log(10),
            "bits_per_byte": bits,
        })

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield judged(batch, at)

    return judge


def score(docs: DataFrame, held: Column) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``docs`` has doc_id and text; other columns, whatever their names, are not read. The model learns from the documents for
    which ``held`` is false; where it is null (as for null ids) a document is held out. A-Z are lower-cased; tokens are the
    words between blanks and the controls from tab to carriage return, then one end. ``n_known`` tokens occur in training, which has
    ``train_tokens``. ``base_score`` is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens, with c the token's count, N
    all and V the different ones in training. ``score`` is the model's log10 probability of the tokens, ``bits_per_byte`` the same
    as total bits over the text's bytes (null for texts without bytes).

    Null texts are empty: one token, the end. Repeated rows and null ids are kept, a row each. Without training documents
    every token is unknown and base scores are 0. An empty table gives no rows. A document's score depends on the documents
    learned from and on itself, not on those scored beside it. Jobs run when this is called; chunks, words and paths are
    written to the shared folder.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "mixing-model")
    marked = docs.select("doc_id", F.coalesce(held, F.lit(True)).alias("held"), "text")
    chunks = scratch.keep(_chunked(marked), "chunks")
    letters = np.zeros(SYMBOLS)
    of_letters = chunks.select(F.posexplode("letters").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    for row in of_letters.collect():  # SYMBOLS rows at most
        letters[row["at"]] = row["n"]
    code = huffman(letters)
    number, listed = chunks.agg(F.count("*"), F.coalesce(F.sum("different"), F.lit(0))).first()
    buckets = min(1 << CLASS_BITS, max(spark.sparkContext.defaultParallelism, -(-listed // BUCKET_WORDS)))
    asked = chunks.select("chunk", "words", "classes", "n", "d")
    sent = asked.mapInArrow(_sent(buckets), "bucket long, chunk long, words binary, n binary, d binary")
    shape = "bucket long, word binary, n long, d long, bits string"
    words = scratch.keep(sent.groupBy("bucket").applyInArrow(_merged(code), shape), "words")
    tokens, different, listed = (x or 0 for x in words.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.count("*")).first())
    counts = order_counts(words, listed, code)
    shared_counts = spark.sparkContext.broadcast(counts)  # of fixed size

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["block"]).sort_by("word")
        n, d = rows["n"].to_numpy(), rows["d"].to_numpy()
        learned = n > 0
        prices_, sums = np.zeros((2, len(n))), None
        if learned.any():
            own = rows.filter(pa.array(learned))
            ways = own["lone"].to_pylist()
            sums, prices_[:, learned] = fit_block(own["word"].to_pylist(), n[learned], d[learned], ways, code, shared_counts.value)
        out = rows.drop_columns(["d", "lone"]).append_column("left", pa.array(log_known(left_of(n, d)).astype("f4")))
        for name, column in zip(("lone_mixed", "lone_letters"), prices_.astype("f4"), strict=True):
            out = out.append_column(name, pa.array(column))
        sums = [sums, *[None] * (len(n) - 1)]
        return _in_parts(out.append_column("sums", pa.array(sums, pa.list_(pa.float64()))))

    blocks = max(1, listed // FIT_WORDS)
    paths = in_cells(words, fit_cells(words), code).withColumn("block", F.shiftright(F.crc32("word") * blocks, 32))
    shape = "bucket long, word binary, n long, path binary, left float, lone_mixed float, lone_letters float, sums array<double>"
    ways = scratch.keep(paths.groupBy("block").applyInArrow(fit, shape), "paths")
    scratch.drop("words")
    sums = np.zeros(FIT_SUMS)
    of_blocks = ways.filter("sums is not null").select(F.posexplode("sums").alias("at", "x"))
    for row in of_blocks.groupBy("at").agg(F.sum("x").alias("x")).collect():  # FIT_SUMS rows at most
        sums[row["at"]] = row["x"]
    model = Model(code, order_tables(counts), merged_weights(sums), tokens, different)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            logs = prices(batch.column(1).to_pylist(), batch.column(6).to_pylist(), own.code, own.tables, own.weights)
            columns = [*batch.columns[:3], *map(pa.array, logs.astype("f4")), *batch.columns[3:6]]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "word", "n", *PRICES])

    priced = ways.select("bucket", "word", "n", "left", "lone_mixed", "lone_letters", "path").mapInArrow(
        price, f"bucket long, word binary, n long, {', '.join(f'{c} float' for c in PRICES)}"
    )
    asked = sent.select("bucket", "chunk", "words").groupBy("bucket")
    shape = f"chunk long, bucket long, n binary, {', '.join(f'{c} binary' for c in PRICES)}"
    answers = priced.groupBy("bucket").cogroup(asked).applyInArrow(_answer, shape)
    kind = docs.schema["doc_id"].dataType
    tasks = max(1, number)
    whole = chunks.select(F.col("chunk").alias("of"), "docs", "held", "sizes", "bytes", "tokens", "numbers")
    whole = whole.repartition(tasks, "of").groupBy("of")
    shape = (
        f"docs array<{kind.simpleString()}>, held array<boolean>, sizes array<long>, bytes array<long>, tokens binary, "
        "n binary, logs binary, before binary, state binary, tally array<struct<at: long, tokens: long>>"
    )
    hear = _hear(tokens + 0.1 * different)
    heard = whole.cogroup(answers.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(hear, shape)
    heard = scratch.keep(heard, "heard", maxRecordsPerFile=1)  # large rows, which else would be read together
    scratch.drop("chunks", "paths")
    tally = heard.select(F.explode("tally").alias("x")).groupBy("x.at").agg(F.sum("x.tokens").alias("tokens"))
    tally = tally.toArrow()  # a row for each state and levels of the voices, at most
    model.weights.voices = first_voices(tally["at"].to_numpy(), tally["tokens"].to_numpy())
    shared = spark.sparkContext.broadcast(model)
    shape = (
        f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, bits_per_byte double"
    )
    return heard.drop("tally").mapInArrow(_judge(shared, to_arrow_type(kind)), shape)
