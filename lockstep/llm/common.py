"""Helpers the operators share: word splitting, hashing, tables in the shared folder, components."""
from __future__ import annotations

import re
import string
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = string.ascii_uppercase
LOWER = string.ascii_lowercase

#: Odd multipliers of the polynomial over word hashes (fixed values).
ROLL = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir.

    Only a local session without that setting (tests, a laptop) gets one of its own; a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if root is None:
        root = spark.conf.get("lockstep.checkpoint.dir", None)
        if root is None:
            root = tempfile.mkdtemp(prefix="lockstep-llm-")
            spark.conf.set("lockstep.checkpoint.dir", root)
    return f"{root}/lockstep-llm/{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text) for Python: ids as strings, for a number column with nulls would turn into floating point there."""
    return docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))


def named_id(df: DataFrame, docs: DataFrame, id_column: str) -> DataFrame:
    """Give the string column id its name and type back."""
    kind = docs.schema[id_column].dataType
    return df.select(F.col("id").cast(kind).alias(id_column), *(F.col(c) for c in df.columns if c != "id"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold_ascii(column):
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def let(value, use):
    """use(value) with value computed once: inside a lambda a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets all words once it holds too many."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8: splitting bytes knows just those six blanks."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash_words(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A finaliser whose every output bit depends on every input bit."""
    values = values ^ (values >> np.uint64(32))
    values = values * MIX
    values = values ^ (values >> np.uint64(29))
    values = values * ROLL
    return values ^ (values >> np.uint64(32))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words; empty when there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = words[:n].copy()
    for k in range(1, size):
        total *= ROLL
        total += words[k:k + n]
    return mixed(total)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: rows (node, component), component = smallest node.

    Alternating star contraction.  A large star hangs every larger neighbour of a node on the
    smallest one, a small star every smaller neighbour; both keep the components.  Each round is a
    keyed aggregation and an equi-join whose hot side Spark can split, and is written to the
    shared folder, so lineage stays short.  Rounds grow with the logarithm of the longest path.
    Nodes without an edge do not occur; self-loops and null ends are ignored.
    """
    def low_high(df):
        return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                .select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct())

    def signature(df):
        # A 128-bit sum over the edges: equal for equal edge sets, whatever their order.
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")),
                      F.sum(F.xxhash64("hi", "lo", F.lit(1)).cast("decimal(38,0)"))).first()

    current = stored(low_high(edges))
    before = signature(current)
    while True:
        # Large star: neighbours above u hang on the smallest of u and its neighbours.
        both = current.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            current.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = (both.join(least, F.col("u") == F.col("w")).where("v > u")
                 .select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct())
        # Small star: u and its neighbours below hang on the smallest of them.
        below = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "w")
        hung = large.join(below, F.col("hi") == F.col("w"))
        small = (hung.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
                 .union(hung.select(F.col("m").alias("lo"), "hi")).where("lo <> hi").distinct())
        current = stored(small)
        now = signature(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
