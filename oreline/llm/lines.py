"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are sequences of words. Two lines are near duplicates if one word changed, added or removed turns
one into the other. A line's deletion neighbourhood is the line itself and all variants with one
word left out, as hashed keys:

* lines that share a variant with the word left out at the same place differ in that word;
* a line equal to a variant of another lacks that word.

So every edit shows as an equal key, and equal keys of these two kinds prove the edit distance:
a group of many lines never has to be compared pair by pair; its earliest line is an aggregate.

Only lines that can have a neighbour emit their variants: an edit leaves the first or the second half of a line as
it is, so it must share a half with another line. A half is as long for a line as for one with
one word less, of which a line emits both lengths.

A line goes if an earlier one, by doc_id and line number, lies within the bound (or equals it). Keys of 64 bits
select; lines are told apart by 128 bits.

That is the query ``op3_line_dedup``, whose rows a statement for DuckDB fixes. ``classes`` and ``without_duplicates``
take a bound that grows with the line (``bound``) and lose no link:

* lines within one edit come from the same keys: those that share a key with the word left out at the same place, and the
  line equal to the key, are all within one edit of each other, so a key's lines are a clique and never pairs;
* lines of ``LONG_WORDS`` words and more, whose bound is larger, share ``RUN`` words in a row if they are within it, and so
  the smallest hash of ``GRAM`` words there; pairs that share one are compared by their edit distance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import Scratch
from oreline.llm.simhash import components

LEAST_WORDS = 4  # shorter lines are near duplicates of equal ones only
WORDS_AN_EDIT = 20
LONG_WORDS = 2 * WORDS_AN_EDIT  # lines of two edits and more
GRAM, RUN = 6, 12  # a line of 40 words keeps 13 in a row through 2 edits, longer ones no fewer through theirs


def bound(n: Column) -> Column:
    """Edits within which a line is a near duplicate of one of ``n`` words and no fewer."""
    return F.when(n < LEAST_WORDS, 0).otherwise(F.greatest(F.floor(n / WORDS_AN_EDIT), F.lit(1))).cast("int")


def _even(line: Column) -> Column:
    """The line's words with one blank between them."""
    flat = F.translate(line, "\t\x0b\f\r", "    ")
    return F.trim(F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " +", " ")).otherwise(flat))


def _size(line: Column) -> Column:
    """Number of words of an even line that is not empty."""
    return (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("int")


def _hashed(line: Column, size: Column, salt: int) -> Column:
    """64 bits of an even line of ``size`` words; salts give independent ones."""
    return F.xxhash64(F.lit(salt), size, line)


def _first(line: str, n: Column) -> Column:
    return F.call_function("substring_index", F.col(line), F.lit(" "), n)


def _halves(line: str) -> Column:
    """Keys of the beginnings and ends that a near duplicate shares one of.

    For lines of n and n or n - 1 words, the words before and behind the edited one make up n - 1 at least,
    so one side has (n - 1) // 2 of them and more, counted from its end of the line.
    """

    def sides(length: Column) -> list[Column]:
        return [
            F.xxhash64(F.lit(1), length, _first(line, length)),
            F.xxhash64(F.lit(2), length, _first(line, -length)),
        ]

    own = F.floor((F.col("n") - 1) / 2).cast("int")
    shorter = F.greatest(F.floor((F.col("n") - 2) / 2), F.lit(0)).cast("int")
    return F.array_distinct(F.array(*sides(own), *sides(shorter)))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 1, line, n) of the lines that have words."""
    split = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw")
    )
    even = split.select("doc_id", (F.col("at") + 1).alias("line_no"), _even(F.col("raw")).alias("line"))
    return even.filter("line <> ''").withColumn("n", _size(F.col("line")))


def _meeting(docs: DataFrame, scratch: Scratch, least: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines by hash, the different ones, and the variants of lines of ``least`` words that meet others.

    With ``least``, the different lines have their last place too.
    """
    line, n = F.col("line"), F.col("n")
    halves = F.when(n >= least, _halves("line")).otherwise(F.array().cast("array<long>")) if least else _halves("line")
    keyed = scratch.keep(
        _lines(docs).select(
            "doc_id", "line_no", _hashed(line, n, 0).alias("h"), _hashed(line, n, 3).alias("g"),
            halves.alias("halves"),
        ),
        "keyed",
    )
    place = F.struct("doc_id", "line_no")
    last = [F.max(place).alias("last")] if least else []
    distinct = scratch.keep(
        keyed.groupBy("h", "g").agg(F.min(place).alias("first"), F.min("halves").alias("halves"), *last),
        "distinct",
    )
    halves = distinct.select("first", "h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    some = halves.join(shared, "half", "left_semi").select("first", "h").distinct()
    by_doc = some.groupBy(F.col("first.doc_id").alias("_doc")).agg(
        F.collect_set(F.struct("first.line_no", "h")).alias("_lines")
    )
    texts = docs.select("doc_id", "text").join(by_doc, F.col("doc_id") == F.col("_doc"))
    # The second pass over the texts picks these lines by number.
    picked = F.transform(
        F.array(F.split("text", "\n")),
        lambda all_lines: F.transform(
            "_lines",
            lambda x: F.struct(x["line_no"].alias("line_no"), x["h"].alias("h"), F.get(all_lines, x["line_no"] - 1).alias("raw")),
        ),
    )
    wanted = texts.select("doc_id", F.explode(F.flatten(picked)).alias("x"))
    wanted = wanted.select("doc_id", "x.line_no", "x.h", _even(F.col("x.raw")).alias("line"))
    wanted = wanted.filter("line <> ''").withColumn("n", _size(line))
    wanted = wanted.filter(_hashed(line, n, 0) == F.col("h")).withColumn("g", _hashed(line, n, 3))
    # 0 leaves nothing out
    variants = wanted.select("doc_id", "line_no", "h", "g", "line", "n", F.explode(F.sequence(F.lit(0), n)).alias("out"))
    out = F.col("out")
    rest = F.trim(F.concat_ws(" ", _first("line", out - 1), _first("line", out - n)))
    variants = variants.withColumn("rest", F.when(out == 0, line).otherwise(rest)).withColumn(
        "size", F.when(out == 0, n).otherwise(n - 1)
    )
    rest, size = F.col("rest"), F.col("size")
    around = scratch.keep(
        variants.select(
            F.struct("doc_id", "line_no").alias("first"), "h", "g", "out",
            _hashed(rest, size, 0).alias("key"), _hashed(rest, size, 3).alias("proof"),
        ),
        "around",
    )
    crowded = around.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return keyed, distinct, scratch.keep(around.join(crowded, "key", "left_semi"), "meeting")


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per line that goes: doc_id, line_no, first_doc_id, first_line_no, edits (0 or 1).

    ``docs`` has doc_id and text; other columns are not read. Lines end at newlines and are compared as words
    between blanks, so blanks don't matter; lines without words, null and empty texts have no duplicates.
    The first line named is the earliest within the bound, which may itself go for a still earlier
    one. Rows that share an id are one document; lines of theirs equal in number and words are one
    line. Rows without an id are left out. Long
    lines are compared whole. Writes narrow tables to the shared folder when called.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    keyed, distinct, meeting = _meeting(docs, scratch)
    # Equal keys of 64 bits select; only variants equal in 128 bits, at the same place, count as one edit.
    by_place = meeting.groupBy("key", "proof", "out").agg(F.min("first").alias("earliest"))
    whole, lacking = F.col("out") == 0, F.col("out") > 0
    by_key = by_place.groupBy("key", "proof").agg(
        F.min(F.when(whole, F.col("earliest"))).alias("equal"),
        F.min(F.when(lacking, F.col("earliest"))).alias("longer"),
    )
    # A variant's line may lie behind the line equal to the variant, or behind one that differs at the same
    # place; a whole line behind one that is longer by a word.
    near = F.when(whole, F.col("longer")).otherwise(F.least("earliest", "equal"))
    seen = (
        meeting.join(by_place.join(by_key, ["key", "proof"]), ["key", "proof", "out"])
        .select("h", "g", near.alias("near"))
        .filter("near is not null")
        .groupBy("h", "g")
        .agg(F.min("near").alias("near"))
    )
    firsts = distinct.join(seen, ["h", "g"], "left").select(
        "h", "g", "first", F.least("first", F.coalesce("near", "first")).alias("earliest")
    )
    here = F.struct("doc_id", "line_no")
    return (
        keyed.join(firsts, ["h", "g"])
        .filter(here != F.col("earliest"))
        .select(
            "doc_id",
            "line_no",
            F.col("earliest.doc_id").alias("first_doc_id"),
            F.col("earliest.line_no").alias("first_line_no"),
            F.when(F.col("earliest") == F.col("first"), 0).otherwise(1).alias("edits"),
        )
    )


def _characters(codes: Column) -> Column:
    """A string of one character for each number of 20 bits."""
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c + 0x10000), 8, "0")), "")), "UTF-32")


def _letters(codes: Column) -> Column:
    """A string of one ASCII character for the low 7 bits of each number."""
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c.bitwiseAND(127)), 2, "0")), "")), "UTF-8")


def _far(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of different lines that are two edits and more apart, but within the bound of the shorter."""
    line, n = F.col("line"), F.col("n")
    long = _lines(docs).filter(n >= LONG_WORDS)
    long = long.groupBy(_hashed(line, n, 0).alias("h"), _hashed(line, n, 3).alias("g")).agg(
        F.min(F.struct("doc_id", "line_no")).alias("first"), F.first("n").alias("n"), F.first("line").alias("line")
    )
    code = lambda w: F.shiftrightunsigned(F.xxhash64(w), 44)
    words = F.split("line", " ")
    long = scratch.keep(long.select("h", "g", "first", "n", "line", _letters(F.transform(words, code)).alias("letters")), "long")
    grams = F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.xxhash64(F.slice("words", i, GRAM)))
    least = F.transform(
        F.sequence(F.lit(1), n - (RUN - 1)), lambda i: F.array_min(F.slice("grams", i, RUN - GRAM + 1))
    )
    anchors = long.select("h", "n", words.alias("words")).withColumn("grams", grams)
    anchors = anchors.select("h", "n", F.explode(F.array_distinct(least)).alias("gram"))
    several = anchors.groupBy("gram").agg(F.count("*").alias("many")).filter("many > 1").select("gram")
    anchors = scratch.keep(anchors.join(several, "gram", "left_semi"), "anchors")
    a, b = anchors.alias("a"), anchors.alias("b")
    apart = F.abs(F.col("a.n") - F.col("b.n")) <= bound(F.least("a.n", "b.n"))
    pairs = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.h") < F.col("b.h")) & apart)
    pairs = pairs.select(F.col("a.h").alias("u"), F.col("b.h").alias("v")).distinct()

    def with_both(pairs: DataFrame, *columns: str) -> DataFrame:
        for side in "uv":
            own = [F.col(c).alias(f"{c}_{side}") for c in ("n", *columns)]
            pairs = pairs.join(long.select(F.col("h").alias(side), *own), side)
        return pairs.withColumn("most", bound(F.least("n_u", "n_v"))).drop("n_u", "n_v")

    # Words that share a character can only make lines look closer; of pairs that are close by letters, whole words are
    # compared, and where such words share a character of 20 bits as well each word gets its own.
    near = with_both(pairs, "letters")
    near = near.filter(F.call_function("levenshtein", F.col("letters_u"), F.col("letters_v"), F.col("most")) >= 0)
    near = scratch.keep(near.select("u", "v").distinct(), "close")
    near = with_both(near, "line", "first", "g")
    near = near.withColumn("x", F.split("line_u", " ")).withColumn("y", F.split("line_v", " "))
    near = near.withColumn("all", F.array_distinct(F.concat("x", "y")))

    def edits_by(number: Callable[[Column], Column]) -> Column:
        sides = [_characters(F.transform(side, number)) for side in ("x", "y")]
        return F.call_function("levenshtein", *sides, F.col("most"))

    alone = F.size("all") == F.size(F.array_distinct(F.transform("all", code)))
    edits = F.when(alone, edits_by(code)).otherwise(edits_by(lambda w: F.array_position("all", w) - 1))
    near = near.filter(edits.between(F.lit(2), F.col("most")))
    ids = [F.struct(F.col(f"first_{s}").alias("first"), F.col(s).alias("h"), F.col(f"g_{s}").alias("g")).alias(s) for s in "uv"]
    return scratch.keep(near.select(*ids), "far")


def _going(cliques: DataFrame, scratch: Scratch) -> DataFrame:
    """The lines (id) of ``cliques`` (clique, id) that go, because a line that stays is in a clique of theirs.

    By their places, a line stays if no line linked to it does that is earlier. Each round decides on the lines without
    undecided earlier ones and on their neighbours.
    """
    now, step, out = cliques, 0, None
    while not now.isEmpty():
        earliest = now.groupBy("clique").agg(F.min("id").alias("least"))
        both = scratch.keep(now.join(earliest, "clique"), f"both{step}")
        stays = both.groupBy("id").agg(F.min("least").alias("least")).filter("least = id").select("id")
        stays = scratch.keep(stays, f"stays{step}")
        goes = both.filter("least <> id").join(stays.select(F.col("id").alias("least")), "least", "left_semi")
        goes = scratch.keep(goes.select("id").distinct(), f"goes{step}")
        out = goes if out is None else out.union(goes)
        now = scratch.keep(both.select("clique", "id").join(stays.union(goes), "id", "left_anti"), f"now{step}")
        scratch.drop(f"both{step}", f"stays{step}", f"now{step - 1}")
        step += 1
    return cliques.select("id").limit(0) if out is None else out


def classes(docs: DataFrame) -> DataFrame:
    """One row per line that has a copy or a near duplicate: doc_id, line_no, class_doc_id, class_line_no (the earliest
    line that links connect it to), links (how many different lines lie within the bound) and kept.

    Two lines are linked if no more words are changed, added or removed than ``bound`` of the shorter one's number:
    none up to 3 words, one from 4, one in 20 from 40 on. ``kept`` is true for lines that stay: the first one of equal lines,
    unless an earlier line that stays is linked to it. So every line that goes has one that stays within its bound.
    ``docs`` is read as by ``duplicates``.
    """
    scratch = Scratch(docs.sparkSession, "line-classes")
    keyed, distinct, meeting = _meeting(docs, scratch, LEAST_WORDS)
    meeting = meeting.withColumn("id", F.struct("first", "h", "g"))
    whole = meeting.filter("out = 0").select("key", "proof", "id").distinct()
    lacking = meeting.filter("out > 0").select("key", "proof", "out", "id").distinct()
    places = lacking.select("key", "proof", "out").distinct()
    members = lacking.union(whole.join(places, ["key", "proof"]).select("key", "proof", "out", "id"))
    far = _far(docs, scratch)
    pair = [F.col("u.h").alias("key"), F.col("v.h").alias("proof"), F.lit(-1).alias("out")]
    members = members.union(far.select(*pair, "u")).union(far.select(*pair, "v"))
    members = members.select(F.struct("key", "proof", "out").alias("clique"), "id")
    several = members.groupBy("clique").agg(F.count("*").alias("many"), F.min("id").alias("least")).filter("many > 1")
    cliques = scratch.keep(members.join(several.select("clique", "least"), "clique"), "cliques")
    goes = _going(cliques.select("clique", "id"), scratch)
    roots = components(cliques.select(F.col("least").alias("u"), F.col("id").alias("v")), scratch)

    # Two lines that differ in a word share one key with it left out; a line that lacks a word may equal several.
    changed = lacking.groupBy("key", "proof", "out").agg((F.count("*") - 1).alias("links")).filter("links > 0")
    changed = lacking.join(changed, ["key", "proof", "out"]).select("id", "links")
    shorter = lacking.select("key", "proof", "id").distinct().join(
        whole.withColumnRenamed("id", "other"), ["key", "proof"]
    )
    one = F.lit(1).cast("long").alias("links")
    links = changed
    for found, sides in ((shorter, ("id", "other")), (far, ("u", "v"))):
        for side in sides:
            links = links.union(found.select(F.col(side).alias("id"), one))
    links = links.groupBy("id").agg(F.sum("links").alias("links"))

    about = links.join(roots.withColumnRenamed("node", "id"), "id").join(
        goes.withColumn("goes", F.lit(True)), "id", "left"
    )
    about = about.select("id.h", "id.g", "links", F.col("root.first").alias("root"), "goes")
    lines = distinct.select("h", "g", "first", "last").join(about, ["h", "g"], "left")
    lines = lines.filter("links is not null or first <> last").withColumn("class", F.coalesce("root", "first"))
    here = F.struct("doc_id", "line_no")
    return (
        keyed.select("doc_id", "line_no", "h", "g").distinct().join(lines, ["h", "g"])
        .select(
            "doc_id",
            "line_no",
            F.col("class.doc_id").alias("class_doc_id"),
            F.col("class.line_no").alias("class_line_no"),
            F.coalesce("links", F.lit(0)).alias("links"),
            ((here == F.col("first")) & F.col("goes").isNull()).alias("kept"),
        )
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that ``classes`` does not keep taken out of the texts, all other columns unchanged.

    A text that loses all its lines is empty. Rows without an id stay as they are.
    """
    gone = classes(docs).filter("not kept").groupBy(F.col("doc_id").alias("id")).agg(
        F.collect_set("line_no").alias("gone")
    )
    # A row travels as one struct, so no column of it can clash with those made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(gone, F.col("row.doc_id") == F.col("id"), "left")
    none = F.array().cast("array<int>")
    kept = F.filter(
        F.split("row.text", "\n"), lambda line, i: ~F.array_contains(F.coalesce("gone", none), i + 1)
    )
    texts = {"text": F.array_join(kept, "\n")}
    return joined.select(*[texts.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = """
WITH l AS (
  SELECT doc_id, i AS line_no, regexp_extract_all(part, '[^ \\x09\\x0B-\\x0D]+') AS w
  FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS part
        FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents
              WHERE text IS NOT NULL AND doc_id IS NOT NULL))),
o AS (SELECT *, doc_id * 10000000 + line_no AS place FROM l WHERE len(w) > 0),
d AS (SELECT w, min(place) AS first FROM o GROUP BY w),
v AS (
  SELECT w, first, i AS out, CASE WHEN i = 0 THEN w ELSE list_concat(w[:i - 1], w[i + 1:]) END AS key
  FROM (SELECT w, first, unnest(range(0, len(w) + 1)) AS i FROM d)),
b AS (SELECT key, out, min(first) AS earliest FROM v GROUP BY key, out),
k AS (SELECT key, min(earliest) FILTER (out = 0) AS equal, min(earliest) FILTER (out > 0) AS longer
      FROM b GROUP BY key),
n AS (
  SELECT w, min(CASE WHEN out = 0 THEN longer ELSE least(earliest, equal) END) AS near
  FROM v JOIN b USING (key, out) JOIN k USING (key) GROUP BY w),
e AS (SELECT w, first, least(first, near) AS earliest FROM d JOIN n USING (w))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, earliest // 10000000 AS first_doc_id,
       CAST(earliest % 10000000 AS INTEGER) AS first_line_no,
       CASE WHEN earliest = first THEN 0 ELSE 1 END AS edits
FROM o JOIN e USING (w) WHERE place <> earliest
"""
