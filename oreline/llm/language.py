"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and everything but letters becomes a blank. Its features are all runs of 1 to 4
characters that hold a letter, blanks marking where words begin and end, hashed to ``BUCKETS``
buckets. The text's vector is the average of its buckets' embeddings, the languages' scores
are linear in it. Embeddings and weights are trained together by stochastic gradient descent in
numpy on the driver, from the bucket counts of a bounded sample of labelled rows; a temperature is fitted on a
part of the sample not trained on.

The softmax only says which of its languages a text is most like. Whether it is like it at all says its typicality: the mean
log-frequency of its buckets in the language. Texts in a language stand close together; those of others, and of
scripts never seen, far below. Each language's level lies between its own rows and those of all others, each of which is unknown to it
as if it had been left out; short texts, whose mean is uncertain, have to fall further below.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreline.llm.common import among_first, drawn, held_out, ship_package

UNKNOWN = "und"
BUCKETS = 1 << 14
DIMENSIONS = 16
GRAMS = (1, 2, 3, 4)
PIECE = 1 << 18
SAMPLE_A_LANGUAGE = 500  # labelled rows of a language used in training, the first by hash of the id
SAMPLE = 20_000  # and of all languages
LETTER_CODES = sys.maxunicode + 1
RARE = 0.001  # part of a language's buckets that is spread over all of them
LEAST_CHECKED = 5  # rows of a language not trained on, below which it has no level
BENEFIT = 0.15  # how far a level lies from other languages' rows on the way to its own
SPREAD = 6.0  # standard errors of a text's typicality that count in its favour

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(LETTER_CODES)), bool, LETTER_CODES))
    return _letters[0]


def bucket_counts(text: str | None) -> tuple[np.ndarray, int]:
    """How often each bucket occurs in a text, and how many letters the text has."""
    counts = np.zeros(BUCKETS, np.int64)
    letters = 0
    table = _letter_table()
    text = text or ""
    first = 0
    while first < len(text):
        last = first + PIECE
        if last < len(text):  # a piece ends at a blank, if it has one
            last = text.rfind(" ", first, last) + 1 or last
        # Surrogates cannot be encoded as such; they are no letters either.
        own = text[first:last].lower()
        first = last
        codes = np.frombuffer(own.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        known = table[codes]
        letters += int(known.sum())
        codes = np.where(known, codes, 0)
        keep = known.copy()  # of a run of blanks one is enough
        keep[1:] |= known[:-1]
        codes = codes[keep]
        codes = np.r_[np.zeros(1, np.uint64), codes, np.zeros(1, np.uint64)]
        filled = codes > 0
        hashed = np.zeros(len(codes), np.uint64)
        alive = np.zeros(len(codes), bool)
        for n in GRAMS:
            ends = len(codes) - n + 1
            if ends <= 0:
                break
            hashed = hashed[:ends] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            alive = alive[:ends] | filled[n - 1 :]
            mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            at = (mixed >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
            counts += np.bincount(at[alive], minlength=BUCKETS)
    return counts, letters


@dataclass
class Model:
    """The languages, each bucket's contribution to their scores, and the calibration."""

    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times weights
    bias: np.ndarray
    logs: np.ndarray  # buckets x languages: log-frequencies
    spread: np.ndarray  # of each language's log-frequencies
    temperature: float = 1.0
    reject_below: float = 0.0
    levels: np.ndarray | None = None  # of each language, the least typicality

    def judge(self, text: str | None) -> tuple[int, float, bool]:
        """The most probable language (-1 for a text without letters), its probability, and whether it is rejected."""
        counts, letters = bucket_counts(text)
        if not letters or not self.languages:
            return -1, 0.0, True
        used = np.flatnonzero(counts)
        total = counts[used].sum()
        share = counts[used] / total
        chances = softmax((share @ self.table[used] + self.bias) / self.temperature)
        best = int(chances.argmax())
        rejected = chances[best] < self.reject_below
        if self.levels is not None:
            rejected |= (self.typicality(used, share, total) < self.levels).all()
        return best, float(chances[best]), bool(rejected)

    def typicality(self, used: np.ndarray, share: np.ndarray, total: float) -> np.ndarray:
        """Of a text in each language, with what its length leaves uncertain counted in its favour."""
        return share @ self.logs[used] + SPREAD * self.spread / np.sqrt(total)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, order, text) -> (lang, place, order, buckets, shares); no letters, no row."""
    for batch in batches:
        kept, buckets, shares = [], [], []
        for text in batch.column(3):
            counts, letters = bucket_counts(text.as_py())
            kept.append(letters > 0)
            if letters:
                used = np.flatnonzero(counts)
                buckets.append(used.astype(np.int32).tobytes())
                shares.append((counts[used] / counts[used].sum()).astype(np.float32).tobytes())
        left = batch.filter(pa.array(kept, pa.bool_()))
        yield pa.RecordBatch.from_arrays(
            [*left.columns[:3], pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
            names=["lang", "place", "order", "buckets", "shares"],
        )


def training_rows(docs: DataFrame) -> DataFrame:
    """The sample, as features: rows with text and language outside the held-out fold."""
    usable = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("lang", drawn("doc_id").alias("order"), "text")
    sizes = dict(map(tuple, usable.groupBy("lang").count().collect()))  # a row a language
    bounds = F.create_map(
        *[F.lit(x) for lang, n in sizes.items() for x in (lang, among_first(SAMPLE_A_LANGUAGE, n))]
    )
    if sizes:
        usable = usable.filter(F.col("order") <= bounds[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("order")
    some = usable.withColumn("place", F.row_number().over(first)).filter(
        F.col("place") <= SAMPLE_A_LANGUAGE
    )
    return (
        some.select("lang", "place", "order", "text")
        .mapInArrow(_features, "lang string, place int, order long, buckets binary, shares binary")
        .orderBy("place", "order")
        .limit(SAMPLE)
        .select("lang", "buckets", "shares")
    )


def train(docs: DataFrame, epochs: int = 12, rate: float = 4.0, seed: int = 0) -> Model:
    """Fit a model to the labelled rows of ``docs`` (doc_id, text, lang); runs when called.

    At most ``SAMPLE_A_LANGUAGE`` rows a language and ``SAMPLE`` in all, as ``BUCKETS`` shares at most
    each, come to the driver. Without such rows the model knows no language.
    """
    ship_package(docs.sparkSession)
    rows = sorted(map(tuple, training_rows(docs).collect()))
    languages = sorted({r[0] for r in rows})
    number = {name: i for i, name in enumerate(languages)}
    data = [
        (np.frombuffer(b, np.int32), np.frombuffer(s, np.float32), number[lang]) for lang, b, s in rows
    ]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    check, fit = order[: len(data) // 4], order[len(data) // 4 :]
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    frequency = np.bincount([data[i][2] for i in fit], minlength=max(1, len(languages)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            used, share, label = data[i]
            hidden = share @ embedding[used]
            error = softmax(hidden @ weights + bias)
            error[label] -= 1
            error *= min(1.0, len(fit) / (len(languages) * max(1, frequency[label])))
            back = weights @ error
            weights -= step * 0.1 * np.outer(hidden, error)
            bias -= step * 0.01 * error
            embedding[used] -= step * np.outer(share, back)
    frequencies = np.zeros((BUCKETS, len(languages)))
    for i in fit:
        used, share, label = data[i]
        frequencies[used, label] += share
    frequencies /= np.maximum(frequencies.sum(axis=0), 1e-12)
    logs = np.log((1 - RARE) * frequencies + RARE / BUCKETS)
    means = (frequencies * logs).sum(axis=0)
    spread = np.sqrt(np.maximum(0, (frequencies * logs**2).sum(axis=0) - means**2))
    model = Model(languages, (embedding @ weights).astype(np.float64), bias.astype(np.float64), logs, spread)
    calibrate(model, [data[i] for i in check])
    return model


def calibrate(model: Model, data: list, lost: float = 0.001) -> None:
    """Set the temperature by likelihood, and the levels below which at most ``lost`` of the rows fall.

    The level of the probability is at most 1.5 times a guess among the languages, so that a text of few words in a
    known language is not taken for an unknown one. A language's level of typicality lies between its own rows and those of the
    other languages, close to the latter, so that texts partly in another language stay, and never above its own.
    """
    if not data:
        return
    labels = np.array([label for *_, label in data])
    # The least share of a bucket is that of one occurrence.
    typical = np.stack([model.typicality(used, share, 1 / share.min()) for used, share, _ in data])
    model.levels = np.full(len(model.languages), -np.inf)
    for number in range(len(model.languages)):
        own, others = typical[labels == number, number], typical[labels != number, number]
        if len(own) >= LEAST_CHECKED:
            low = np.quantile(own, lost)
            high = np.quantile(others, 0.99) if len(others) else low - 2
            model.levels[number] = min(low - 2 * own.std() / np.sqrt(len(own)), high + BENEFIT * (low - high))
    if len(model.languages) < 2:
        return
    logits = np.stack([share @ model.table[used] + model.bias for used, share, _ in data])
    temperatures = np.geomspace(0.05, 20, 121)

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()

    model.temperature = float(min(temperatures, key=loss))
    best = softmax(logits / model.temperature).max(axis=1)
    guess = 1 / len(model.languages)
    model.reject_below = float(min(np.quantile(best, lost), 1.5 * guess))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    ``docs`` has doc_id and text; only the text decides. ``score`` is the calibrated
    probability of the predicted language. A text that is null or has no letter is ``und`` with
    score 0, and rejected; so is every text if the model knows no language. Other texts have a language
    of the model and are rejected if the score lies below ``model.reject_below`` or the text is typical of no language. Equal scores go to the
    language first by name. Repeated rows and null ids are kept as they are (a null id counts as held
    out). Texts are read in pieces of ``PIECE`` characters, to the end.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages doubles

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names, scores, rejected = [], [], []
            for text in batch.column(2):
                best, score, refused = known.judge(text.as_py())
                names.append(UNKNOWN if best < 0 else known.languages[best])
                scores.append(score)
                rejected.append(refused)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rejected rows, all columns unchanged."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            kept = [not known.judge(text.as_py())[2] for text in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
