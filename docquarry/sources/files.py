"""Binary files with digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fingerprints(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """(path, size_bytes, fingerprint, sha256) of the files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select(
        "path",
        F.col("length").alias("size_bytes"),
        F.md5("content").alias("fingerprint"),
        F.sha2("content", 256).alias("sha256"),
    )
