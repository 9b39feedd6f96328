"""JSON-lines logs and artifacts with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def parsed(lines: DataFrame, schema: T.StructType, *kept: str) -> DataFrame:
    """``value``, ``__row`` and the ``kept`` columns of every line of ``value`` that is not blank.

    ``__row`` has the schema's fields and ``_corrupt``: the line itself where it is not one
    object of the schema.  A line that holds an array of objects is not.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "allowNonNumericNumbers": "false",
    }
    row = F.from_json("value", with_corrupt, options)
    line = F.regexp_replace("value", r"^\s+", "")
    bad = ~line.startswith("{") | row[CORRUPT].isNotNull() | row.isNull()
    return lines.filter(line != "").select(
        *kept,
        "value",
        F.struct(
            *[F.when(~bad, row[f.name]).alias(f.name) for f in schema.fields],
            F.when(bad, F.col("value")).alias(CORRUPT),
        ).alias("__row"),
    )


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return parsed(spark.read.text(path), schema)


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the job, which names file and text.

    :func:`check_lines` tells its number before a job is started.
    """
    parsed = _parsed(spark, path, schema)
    message = F.concat(
        F.lit("Malformed line in "),
        F.col("_metadata.file_path"),
        F.lit(": "),
        F.substring("value", 1, 200),
    )
    good = F.when(F.col(f"__row.{CORRUPT}").isNull(), True).otherwise(
        F.raise_error(message).cast("boolean")
    )
    return parsed.filter(good).select(*[F.col(f"__row.{f.name}").alias(f.name) for f in schema.fields])


def read_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All lines that are not blank; ``_corrupt`` holds the text of the malformed ones."""
    return _parsed(spark, path, schema).select("__row.*")


def well_formed(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def malformed_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed_lines"))


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line_number, line) of the lines that :func:`read_lenient` marks, numbered from 1 with blank ones."""
    block = ["__file", "__block"]
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        # Consecutive within the blocks that a task reads.
        F.monotonically_increasing_id().alias("__id"),
    )
    counts = lines.groupBy(*block).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    bad = parsed(lines, schema, *block, "__id").filter(F.col(f"__row.{CORRUPT}").isNotNull())
    return bad.join(starts, block).select(
        F.col("__file").alias("file"),
        (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("line_number"),
        F.col("value").alias("line"),
    )


def first_malformed(spark: SparkSession, path: str, schema: T.StructType) -> str | None:
    """What :func:`read_strict` fails on, with the line's number: "line 3 of <file>: <text>"; None if all is well."""
    found = malformed_lines(spark, path, schema).orderBy("file", "line_number").first()
    return found and f"line {found['line_number']} of {found['file']}: {found['line'][:200]}"


def check_lines(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Raises ValueError with file and number of the first malformed line; costs a reading of its own."""
    found = first_malformed(spark, path, schema)
    if found:
        raise ValueError(f"Malformed {found}")


def with_line_order(lines: DataFrame) -> DataFrame:
    """Sortable position of each line in an append-only set of files.

    File names must sort in the order of writing, as the writers' do.  Use it
    directly on a file scan.
    """
    return lines.withColumn(
        "line_order",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def append(df: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_artifact(df: DataFrame, path: str) -> None:
    """Replace an artifact; the output committer makes it appear at once."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
