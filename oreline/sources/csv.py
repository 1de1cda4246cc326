"""CSV extracts, read untyped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreline.operators.lookup import broadcast_if_small

_MALFORMED = "_malformed_line"
_QUOTED = r'"([^"]|"")*"'
_QUOTED_FIELD = r'(?:^|,)"[^"]*+(?:""[^"]*+)*+"'
LINE_BREAK = "a quoted field spans lines"
MOST_RANGE_TASKS = 20_000


def _quotes(text: Column) -> Column:
    """How many quotes a text holds; most hold none, and are only searched."""
    counted = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    return F.when(text.contains('"'), counted).otherwise(0)


def _open_quote(line: Column) -> Column:
    """Whether a line holds an odd number of quotes, as one does where a quoted field goes on."""
    return _quotes(line) % 2 == 1


def files_with_line_breaks(spark: SparkSession, path: str) -> list[str]:
    """The files in which a quoted field may span lines, from a scan of plain text lines."""
    lines = spark.read.text(path).select("value", "_metadata.file_path")
    found = lines.filter(_open_quote(F.col("value"))).select("file_path").distinct()
    return sorted(row[0] for row in found.collect())


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    return bool(files_with_line_breaks(spark, path))


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = (),
    multi_line: bool | None = None,
) -> DataFrame:
    """All columns of a headed CSV file (or folder of files) as text.

    Blanks and fields missing at the end of a row are ``""``, never null; ``NA`` stays text;
    doubled quotes are understood. A row with more fields than the header stops the load, and so does
    a file with another header. A row that repeats the header is taken for one. ``columns`` must all
    be in the header, in any order.

    ``multi_line=False`` reads line by line, in one pass and split among executors, and stops at an open quote
    (``LINE_BREAK``). ``True`` reads every file whole, in one task. ``None`` first looks which files have quotes that
    stay open at the end of a line; they are read by ranges (see :func:`records`), the others line by line. A file with quotes
    inside unquoted fields, which say nothing about where records end, is read whole then.
    """
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path}: columns not in the header: {', '.join(missing)}")
    if multi_line is None:
        broken = files_with_line_breaks(spark, path)
        rows = _by_line(spark, path, names, skip=broken)
        if broken:
            found = records(spark, broken).filter(_stray_quote(F.col("text"))).select("file").distinct()
            whole = sorted(row[0] for row in found.collect())
            if whole:
                rows = rows.unionByName(_by_file(spark, whole, path, names))
            split = [file for file in broken if file not in whole]
            if split:
                rows = rows.unionByName(_by_range(spark, split, path, names))
        return rows
    return _by_file(spark, [path], path, names) if multi_line else _by_line(spark, path, names)


def _schema(names: Sequence[str]) -> str:
    return ", ".join([*[f"`{c}` string" for c in names], f"{_MALFORMED} string"])


def _by_line(
    spark: SparkSession, path: str, names: Sequence[str], skip: Sequence[str] = ()
) -> DataFrame:
    """The rows of the files but those in ``skip``, a row a line."""
    raw = spark.read.text(path)
    if skip:
        raw = raw.select("value", "_metadata.file_path").filter(~F.col("file_path").isin(*skip))
    trouble = F.when(
        _open_quote(F.col("value")),
        F.concat(F.lit(f"{path}: {LINE_BREAK}: "), F.col("value")),
    )
    return _parsed(raw.select("value"), trouble, path, names)


def _parsed(raw: DataFrame, trouble: Column, path: str, names: Sequence[str]) -> DataFrame:
    """The rows of texts that hold a record each, without headers; a row in trouble raises an error.

    Only a text that begins like a header is compared with the header field by field.
    """
    options = {"escape": '"', "columnNameOfCorruptRecord": _MALFORMED}
    value = F.col("value")
    raw = raw.filter(F.trim("value") != "")
    like_header = F.lit(False)
    for name in dict.fromkeys(names):
        quoted = name.replace('"', '""')
        like_header = like_header | value.startswith(name) | value.startswith(f'"{quoted}')
    rows = raw.select("value", F.from_csv("value", _schema(names), options).alias("row"), like_header.alias("like"))
    cells = F.array(*[F.coalesce(F.col("row")[c], F.lit("")) for c in names])
    header = F.array(*[F.lit(c) for c in names])
    rows = rows.filter(~F.when(F.col("like"), cells == header).otherwise(False))
    other_header = F.when(F.col("like"), F.sort_array(cells) == F.sort_array(header)).otherwise(False)
    trouble = F.coalesce(
        trouble, F.when(other_header, F.concat(F.lit(f"{path}: a header does not conform: "), value))
    )
    return _rows(rows.select("row.*", trouble.alias("_trouble")), path, names)


def _stray_quote(record: Column) -> Column:
    """Whether a record holds quotes outside quoted fields, or one that is never closed."""
    rest = F.regexp_replace(record, _QUOTED_FIELD, "")
    return F.when(record.contains('"'), rest.contains('"')).otherwise(False)


def records(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(file, text) of every record of files whose quoted fields may span lines, header included.

    Files are read in the byte ranges that text files are split into. Whether a range begins inside a quoted field follows
    from the quotes of all ranges before it, counted in a first pass that gives a row for each range. Within a range, a
    running count tells which lines begin a record; the lines of a record are joined again. The record that a range ends with
    may go on in the next ones: only that piece of each range, and the lines that a range begins with before
    its first record, meet by file.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(list(files))
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("range"),
            F.monotonically_increasing_id().alias("at"),
        )
        .withColumn("quotes", _quotes(F.col("value")))
    )
    by_range = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.groupBy("file", "range").agg(F.sum("quotes").alias("n"))
    before = F.coalesce(F.sum("n").over(by_range), F.lit(0))
    states = counted.select("file", "range", (before % 2).alias("open"))
    tasks = max(1, min(MOST_RANGE_TASKS, states.count()))

    own = Window.partitionBy("file", "range")
    earlier = own.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = own.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = (F.col("open") + F.coalesce(F.sum("quotes").over(earlier), F.lit(0))) % 2 == 0
    pieces = (
        lines.join(broadcast_if_small(states)[0], ["file", "range"])
        .repartition(tasks, "file", "range")
        .withColumn("begins", begins.cast("int"))
        .withColumn("record", F.sum("begins").over(upto))
        .withColumn("last", F.max("record").over(own))
        .groupBy("file", "range", "record", "last")
        .agg(_joined(F.struct("at", F.col("value").alias("text"))))
    )
    whole = pieces.filter("record > 0 and record < last").select("file", "text")
    # At most two pieces of each range are left.
    edge = Window.partitionBy("file").orderBy("range", "record")
    owner = F.last(F.when(F.col("record") > 0, F.col("range")), ignorenulls=True).over(edge)
    loose = pieces.filter("record = 0 or record = last").withColumn("owner", owner)
    glued = loose.groupBy("file", "owner").agg(_joined(F.struct("range", "record", "text")))
    return whole.unionByName(glued.select("file", "text"))


def _joined(piece: Column) -> Column:
    """The texts of pieces in order, with the line breaks between them."""
    texts = F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"])
    return F.array_join(texts, "\n").alias("text")


def _by_range(spark: SparkSession, files: Sequence[str], path: str, names: Sequence[str]) -> DataFrame:
    """The rows of ``files``, each read by many tasks."""
    # Where lines end with a carriage return and a line feed, the former counts nowhere.
    plain = F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    texts = records(spark, files).select(F.when(F.col("text").endswith("\r"), plain).otherwise(F.col("text")).alias("value"))
    stray = F.when(
        _stray_quote(F.col("value")), F.concat(F.lit(f"{path}: a quote inside an unquoted field: "), F.col("value"))
    )
    return _parsed(texts, stray, path, names)


def _by_file(
    spark: SparkSession, files: Sequence[str], path: str, names: Sequence[str]
) -> DataFrame:
    """The rows of ``files``, each read by one task."""
    rows = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", _MALFORMED)
        .schema(_schema(names))
        .csv(list(files))
    )
    return _rows(rows.withColumn("_trouble", F.lit(None).cast("string")), path, names)


def _rows(parsed: DataFrame, path: str, names: Sequence[str]) -> DataFrame:
    """Cells without nulls; rows in trouble, or with more fields than the header, raise an error."""
    # Only rows whose field count differs from the header carry their line; short ones are fine.
    unquoted = F.regexp_replace(_MALFORMED, _QUOTED, "")
    commas = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit("")))
    too_long = F.coalesce(commas >= len(names), F.lit(False))
    message = F.concat(F.lit(f"{path}: more fields than the header: "), F.col(_MALFORMED))
    trouble = F.coalesce("_trouble", F.when(too_long, message))
    guarded = F.when(trouble.isNotNull(), F.raise_error(trouble)).otherwise(
        F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))
    )
    return parsed.select(
        guarded.alias(names[0]),
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names[1:]],
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Write text columns so that :func:`read_csv` returns them unchanged."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
