"""Shortest-pack-first packing over the length histogram.

Documents become token ids; those above the sequence length are cut into full pieces and a rest. Only
the histogram of piece lengths (at most ``size`` rows) reaches the driver. There, lengths are placed from
the longest down, each into the open packs with the least in them, and packs of one make are counted
instead of listed. A pattern is its runs (length, how many); patterns are joined back to pieces by the rank
of a piece among those of its length. The rank is counted within hash buckets first, so that one frequent
length does not meet in one task. The number of patterns depends on ``size``, not on the corpus: each
length adds at most two open kinds of packs.

Edge cases: null text is empty and gives the end id alone; null and repeated ids keep their rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize
from corpusmill.llm.word_ids import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of at most size ids."""
    end = np.array([end_id], "<u4")

    def cut(batches):
        words = encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), words.encode_column(batch.column(1))):
                ids = np.append(ids, end)
                n = len(ids)
                rows += [(key, a, min(size, n - a), zlib.crc32(ids[a : a + size]), n) for a in range(0, n, size)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns as (runs of (length, times), packs of this pattern)."""
    kinds: dict[int, list] = {}  # free space to [runs, packs]
    spaces: list[int] = []  # heap of -free space
    done = []

    def put(free: int, runs: tuple, packs: int) -> None:
        if free == 0:
            done.append((list(runs), packs))
            return
        if free not in kinds:
            kinds[free] = []
            heapq.heappush(spaces, -free)
        kinds[free].append((runs, packs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if spaces and -spaces[0] >= length:
                free = -spaces[0]
                runs, packs = kinds[free].pop()
                if not kinds[free]:
                    del kinds[free]
                    heapq.heappop(spaces)
                used = min(packs, left)
                if packs > used:
                    put(free, runs, packs - used)
                last = runs[-1]
                put(free - length, (*runs[:-1], (length, last[1] + 1)) if last[0] == length else (*runs, (length, 1)), used)
            else:
                used = left
                put(size - length, ((length, 1),), used)
            left -= used
    return done + [(list(runs), packs) for group in kinds.values() for runs, packs in group]


def slot_table(patterns, size: int) -> dict[str, np.ndarray]:
    """Ranges of ranks: which pattern, offset and sequence take the pieces of a length from rank lo on."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for runs, packs in patterns:
        offset = 0
        for length, times in runs:
            lo = taken.get(length, 0)
            rows.append((length * (1 << 44) + lo, length, lo, times, first, offset))
            taken[length] = lo + times * packs
            offset += length * times
        first += packs
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return dict(zip(("key", "length", "lo", "times", "first", "offset"), table.T.copy()))


def assign(pieces: DataFrame, size: int, rows_per_bucket: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to a materialized table of pieces."""
    spark = pieces.sparkSession
    histogram = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(slot_table(pack_histogram(histogram, size), size))
    buckets = max(64, sum(histogram.values()) // rows_per_bucket)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    held = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(held, ["length", "_bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("_rank")).cast("long").alias("_rank"))

    def place(batches):
        s = slots.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            at = np.searchsorted(s["key"], length * (1 << 44) + rank, "right") - 1
            pack, turn = np.divmod(rank - s["lo"][at], s["times"][at])
            out = [*batch.columns[:5], pa.array(s["first"][at] + pack), pa.array(s["offset"][at] + turn * length)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return assign(materialize(cut_pieces(docs, tokenizer_path, size, end_id, doc_id, text), "pieces"), size)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusmill.llm.common import read

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
