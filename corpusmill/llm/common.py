"""Helpers that the training-data operators share: shared-folder tables, Arrow buffers, rolling hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.storage import shared_dir

#: Bytes of text that one vectorised step holds; temporaries are a small multiple of it.
CHUNK = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote."""
    spark, path = df.sparkSession, df._shared_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remainder(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's bounds in them; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def spans(offsets: np.ndarray, limit: int = CHUNK):
    """Row ranges (i, j) of about limit bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def flag_table(chars: bytes, value: int = 1) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = value
    return table


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE, _powers = 0x9E3779B97F4A7C15, {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        n = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.ones(1, np.uint64)
            while len(table) < n:
                table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
            _powers[key] = table
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where is_word holds; a run ends with its row (offsets, from 0)."""
    n = len(is_word)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = is_word[1:]
    return np.flatnonzero(is_word & (~before | edge[:-1])), np.flatnonzero(is_word & (~after | edge[1:])) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[starts:ends], by prefix sums of a polynomial."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def long_word_hash(word: np.ndarray) -> np.ndarray:
    """word_hashes() of one word, over a part of it at a time."""
    total, scale = 0, 1
    up, step = _power_tables(CHUNK)[0], pow(_BASE, CHUNK, 1 << 64)
    for a in range(0, len(word), CHUNK):
        part = word[a : a + CHUNK].astype(np.uint64) + np.uint64(1)
        total, scale = (total + int((part * up[: len(part)]).sum()) * scale) % (1 << 64), scale * step % (1 << 64)
    return mix(np.array([total], np.uint64))


def words_in_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """word_hashes() of the words, so many at a time, so that what it holds does not grow with the text."""
    parts = [slice(i, i + step) for i in range(0, len(starts), step)]
    return np.concatenate([np.zeros(0, np.uint64), *(word_hashes(data[starts[p][0] : ends[p][-1]], starts[p] - starts[p][0], ends[p] - starts[p][0]) for p in parts)])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams at each position (len(words) - k + 1 of them)."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + words[j : j + n]
    return mix(out)
