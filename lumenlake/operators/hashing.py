"""Content hashes and files with equal content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALGORITHMS = ("sha256", "sha1", "md5")


def algorithm(name: str) -> str:
    """Normalised name; ValueError if it is not supported."""
    bare = name.strip().lower().replace("-", "")
    if bare not in ALGORITHMS:
        raise ValueError(f"unsupported hash algorithm: {name}")
    return bare


def digest(content: Column, name: str) -> Column:
    return {"sha256": lambda c: F.sha2(c, 256), "sha1": F.sha1, "md5": F.md5}[algorithm(name)](content)


def hashes(df: DataFrame, keys: list[str], content: str, names: tuple[str, ...] = ALGORITHMS) -> DataFrame:
    """One column per algorithm, each named once, from one read of the content."""
    return df.select(*keys, *[digest(F.col(content), n).alias(n) for n in dict.fromkeys(map(algorithm, names))])


def duplicates(df: DataFrame, key: str, content: str, name: str = "sha256") -> DataFrame:
    """digest, first key and number of files of contents that occur more than once; counted before the shuffle."""
    each = df.select(F.col(key).alias("k"), digest(F.col(content), name).alias("digest"))
    return each.groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("files")).where("files > 1")


def same_content(a: DataFrame, b: DataFrame, on: list[str], content: str, name: str = "sha256") -> DataFrame:
    """Pairs by ``on``: both digests and whether they are equal."""
    side = lambda df, n: df.select(*on, digest(F.col(content), name).alias(n))
    return side(a, "first").join(side(b, "second"), on).withColumn("equal", F.col("first") == F.col("second"))
