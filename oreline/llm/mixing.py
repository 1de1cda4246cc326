"""Mixing sources to target weights with a low-discrepancy schedule.

The documents of a source, shuffled by a seed, are one stream of words cut into blocks of ``BLOCK``
words. The schedule is a row of slots; slot ``s`` asks for the source at the golden-ratio point
``frac(s * PHI)`` of the cumulative weights, so that every stretch of the schedule holds the sources
close to their weights. The r-th slot of a source takes block ``r`` of its stream, starting over
at the end (a further epoch), and the last one is cut so that the source gives its target exactly.
A source that the schedule gives too few slots (by its discrepancy, a few blocks) gets the rest in
closing slots.

Places in a stream and ranks of slots are offsets of cells plus places within a cell, so no
source needs one task. The shuffle cells of a source are at most ``CELLS``, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreline.llm.common import Scratch, prefix_sums, word_count

BLOCK = 256
MOST_EPOCHS = 3
CELL_DIGITS = 4
CELLS = 16**CELL_DIGITS
SLOTS_PER_STRETCH = 65536
PHI = 0.6180339887498949


def targets(sizes: DataFrame) -> DataFrame:
    """Of each source (source, source_size): its weight, target (double) and words taken (long).

    Weights 1, 2, 3 repeat over the sources by code point, null last. A target is the source's share
    of all sizes, at most ``MOST_EPOCHS`` times its size; what that cuts off goes to the others by
    weight. One row per source: the windows without a partition hold no more than that.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn(
        "weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")
    ).withColumn("most", (F.col("source_size") * MOST_EPOCHS).cast("double"))
    # Sources fill up in the order of most / weight; one is capped if the level that would serve
    # it and all later ones lies above its own. The first that isn't sets the level of the rest.
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    capped = F.col("level") * F.col("weight") > F.col("most")
    final = levelled.withColumn(
        "line", F.max(F.when(~capped, F.col("level"))).over(everything)
    ).withColumn("target", F.when(capped, F.col("most")).otherwise(F.col("line") * F.col("weight")))
    words = F.least(F.round("target").cast("long"), F.col("source_size") * MOST_EPOCHS)
    return final.select("source", "source_size", "target", words.alias("words"))


def streams(docs: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """Every document with its size and the place of its first word in its source's stream."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")
    ).withColumn("cell", F.conv(F.substring("key", 1, CELL_DIGITS), 16, 10).cast("int"))
    sized = scratch.keep(sized, "sized")
    cells = prefix_sums(
        sized.groupBy("source", "cell").agg(F.sum("size").alias("words")),
        ["source"], ["cell"], "words", "before",
    )
    order = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    return scratch.keep(
        placed.alias("d")
        .join(
            cells.alias("c"),
            F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.cell") == F.col("c.cell")),
        )
        .select(
            "doc_id",
            F.col("d.source").alias("source"),
            "size",
            (F.col("before") + F.col("within")).alias("start"),
        ),
        "streams",
    )


def schedule(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """The slots: slot, source, block, epoch and words (how much of the block is taken).

    ``sources`` is what ``targets`` returns; it is collected, one row per source.
    """
    spark = sources.sparkSession
    rows = [r for r in sources.orderBy(F.col("source").asc_nulls_last()).collect() if r["words"]]
    shape = "slot long, source string, block long, epoch long, words long"
    if not rows:
        return spark.createDataFrame([], shape)
    total = sum(r["words"] for r in rows)
    plan, sum_so_far = [], 0
    for i, r in enumerate(rows):
        sum_so_far += r["words"]
        size, words = r["source_size"], r["words"]
        a_round = -(-size // BLOCK)
        slots = words // size * a_round + -(-(words % size) // BLOCK)
        plan.append((i, r["source"], size, words, a_round, slots, sum_so_far / total))
    facts = F.broadcast(  # one row per source
        spark.createDataFrame(
            plan,
            "number int, source string, size long, most long, a_round long, slots long, edge double",
        )
    )
    count = sum(p[5] for p in plan)
    point = F.col("slot") * PHI - F.floor(F.col("slot") * PHI)
    edges = F.array(*[F.lit(p[6]) for p in plan[:-1]]) if plan[1:] else F.array().cast("array<double>")
    drawn = spark.range(count).select(
        F.col("id").alias("slot"),
        (F.col("id") / SLOTS_PER_STRETCH).cast("long").alias("stretch"),
    )
    number = F.size(F.filter(edges, lambda edge: edge <= F.col("point")))
    drawn = drawn.withColumn("point", point).withColumn("number", number)
    lengths = prefix_sums(
        drawn.groupBy("number", "stretch").agg(F.count("*").alias("n")),
        ["number"], ["stretch"], "n", "before",
    )
    place = F.row_number().over(Window.partitionBy("number", "stretch").orderBy("slot")) - 1
    ranked = (
        drawn.withColumn("place", place)
        .join(lengths, ["number", "stretch"])
        .select("number", "slot", (F.col("before") + F.col("place")).alias("rank"))
    )
    given = drawn.groupBy("number").agg(F.count("*").alias("given"))
    closing = (
        facts.join(given, "number", "left")
        .select("number", "slots", F.coalesce("given", F.lit(0)).alias("given"))
        .filter("given < slots")
        .select("number", F.explode(F.sequence("given", F.col("slots") - 1)).alias("rank"))
        .select("number", (F.lit(count) + F.col("rank")).alias("slot"), "rank")
    )
    epoch, block = F.expr("rank div a_round"), F.col("rank") % F.col("a_round")
    length = F.least(F.lit(BLOCK), F.col("size") - F.col("block") * BLOCK)
    left = F.col("most") - F.col("epoch") * F.col("size") - F.col("block") * BLOCK
    taken = (
        ranked.unionByName(closing)
        .join(facts, "number")
        .filter("rank < slots")
        .withColumn("epoch", epoch)
        .withColumn("block", block)
        .select("slot", "source", "block", "epoch", F.least(length, left).alias("words"))
    )
    return scratch.keep(taken, "schedule")


def mix(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixture: spans, and one row per document.

    ``docs`` has doc_id, source and text; other columns are not read.

    Spans (doc_id, start, slot, epoch, first, words): slot ``slot`` of the schedule takes ``words``
    words of the document from word ``first`` (0 is its first word). Read in the order of slot and start they
    are the mixed stream.

    Documents: doc_id, source, start, size, source_size, target, taken. ``start`` is the place in the
    source's stream, ``taken`` the sum of the document's spans. A source's taken words are its
    target, rounded; none of its documents is taken more than ``MOST_EPOCHS`` times.

    Null and empty texts have size 0 and are never taken. Null sources are one source, sorted last.
    Null ids sort first within a cell, rows alike are taken as often as their places in the stream say. Empty
    tables, and tables without words, give targets of 0. The seed and the rows decide the result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    placed = streams(docs, seed, scratch)
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = scratch.keep(targets(sizes), "sources")
    slots = schedule(sources, scratch)
    block = F.explode(
        F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}"))
    )
    pieces = placed.filter("size > 0").withColumn("block", block)
    offset = F.col("p.block") * BLOCK
    first = F.greatest(F.col("start"), offset)
    last = F.least(F.col("start") + F.col("size"), offset + F.col("s.words"))
    spans = (
        pieces.alias("p")
        .join(
            slots.alias("s"),
            (F.col("p.block") == F.col("s.block"))
            & F.col("p.source").eqNullSafe(F.col("s.source"))
            & (F.col("start") < offset + F.col("s.words")),
        )
        .select(
            "doc_id",
            F.col("p.source").alias("source"),
            "start",
            "slot",
            "epoch",
            (first - F.col("start")).alias("first"),
            (last - first).alias("words"),
        )
    )
    sums = spans.groupBy("source", "start").agg(F.sum("words").alias("taken"))
    # Documents without words share their start with the next one, and take nothing.
    documents = (
        placed.alias("d")
        .join(
            sums.alias("t"),
            F.col("d.source").eqNullSafe(F.col("t.source"))
            & (F.col("d.start") == F.col("t.start"))
            & (F.col("size") > 0),
            "left",
        )
        .join(F.broadcast(sources.alias("w")), F.col("d.source").eqNullSafe(F.col("w.source")))
        .select(
            "doc_id",
            F.col("d.source").alias("source"),
            F.col("d.start").alias("start"),
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )
    return spans, documents


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixture as rows of ``docs``: a document taken more than once is repeated, one taken in part
    has the taken words, joined by blanks, and one not taken is missing. Other columns are unchanged, but
    for n_chars, which is the length of the text where there is such a column.

    What an epoch takes of a document are its first words, for a stream is cut at its end only.
    """
    _, documents = mix(docs, seed)
    columns = docs.columns
    keys = ["doc_id", "source", "size"]

    def numbered(df: DataFrame, order: str) -> DataFrame:
        same = Window.partitionBy(*keys).orderBy(order)
        return df.withColumn("number", F.row_number().over(same))

    # A row travels as one struct, so no column of it can clash with those made here. Rows alike in id,
    # source and size are told apart by a number; their places in the stream are equal in kind.
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("order"),
    )
    marked = numbered(marked.filter("size > 0"), "order")
    plan = numbered(documents.filter("taken > 0"), "start").select(
        *[F.col(c).alias(f"p_{c}") for c in keys], F.col("number").alias("p_number"), "taken"
    )
    match = F.col("number") == F.col("p_number")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"p_{key}"))
    joined = marked.join(plan, match)
    spaced = F.trim(F.translate("row.text", "\t\n\x0b\f\r", "     "))
    rest = (F.col("taken") % F.col("size")).cast("int")
    part = F.array_join(F.slice(F.split(spaced, " +"), F.lit(1), rest), " ")
    whole = F.array_repeat("row.text", F.expr("taken div size").cast("int"))
    texts = F.when(rest > 0, F.concat(whole, F.array(part))).otherwise(whole)
    cut = joined.select("row", F.explode(texts).alias("text"))
    kinds = dict(docs.dtypes)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast(kinds.get("n_chars", "long"))}
    return cut.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, md5('0' || coalesce('|' || CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
p AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
w AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS most,
         (sum(source_size) OVER () - coalesce(sum(CAST(3 * source_size AS DOUBLE)) OVER (o
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
t AS (
  SELECT source, source_size, CASE WHEN level * weight > most THEN most ELSE
         max(level) FILTER (level * weight <= most) OVER () * weight END AS target
  FROM l),
g AS (
  SELECT *, least(CAST(round(target) AS BIGINT), 3 * source_size) AS words FROM t)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE
         size * (words // source_size)
         + greatest(0, least(size, words % source_size - start)) END AS BIGINT) AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""
