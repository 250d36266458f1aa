"""Token-ID output: files of range-coded id blocks, and reading them back.

Documents are dealt by ranges of the id, encoded, and cut into frames: runs of whole documents of at least
``frame_ids`` ids. A frame is one row of the file: its place, its documents' ids and lengths, and its blocks. A
block holds ``block_ids`` ids of the frame, is coded on its own (see range_coder) and carries a checksum; the
blocks of a frame are coded in step. Files are Parquet, one binary value per frame, so that Spark writes and finds them
in any store. Reading decodes whole frames, those of a task together, and adds up the starts from the frames' totals.

Edge cases: null text is empty and gives the end id alone; null ids come first; repeated ids stand together, in order of
their texts' hash; an empty table gives an empty file and result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import range_coder
from corpusmill.llm.common import read, shared_dir
from corpusmill.llm.word_ids import encoder

FRAME = "part long, frame long, first long, n_ids long, doc_ids array<long>, lengths array<long>, blocks array<binary>"
NAMES = ["part", "frame", "first", "n_ids", "doc_ids", "lengths", "blocks"]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", frame_ids: int = 1 << 21, block_ids: int = 1 << 11) -> None:
    """Writes the ids of all documents, in order of doc_id, each with the end id behind it."""
    end = np.array([end_id], "<u4")

    def encode(batches):
        from pyspark import TaskContext

        words, part, frame = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        keys, sizes, chunks, held = [], [], [], 0

        def flush():
            ids = np.concatenate(chunks)
            blocks = range_coder.encode([ids[i : i + block_ids] for i in range(0, len(ids), block_ids)])
            row = [[part], [frame], [keys[0]], [len(ids)], [list(keys)], [list(sizes)], [blocks]]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], NAMES)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), words.encode_column(batch.column(1))):
                keys.append(key)
                sizes.append(len(ids) + 1)
                chunks += [ids, end]
                held += sizes[-1]
                if held >= frame_ids:
                    yield flush()
                    keys, sizes, chunks, held, frame = [], [], [], 0, frame + 1
        if keys:
            yield flush()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # the text's hash is in the ranges too, so that a repeated id does not meet in one task
    ordered = chosen.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    ordered.mapInArrow(encode, FRAME).write.parquet(path)


def checked(frames):
    """A batch a frame, with the place, length and checksum of each of its documents. frames: part, frame, doc_ids, lengths, blocks.

    Frames are held until their blocks fill the steps of two groups: a step takes little more time for more blocks."""
    held, blocks = [], 0
    for frame in frames:
        held.append(frame)
        blocks += len(frame[-1])
        if blocks >= 2 * range_coder.TOGETHER:
            yield from checked_at_once(held)
            held, blocks = [], 0
    yield from checked_at_once(held)


def checked_at_once(frames: list):
    decoded = range_coder.decode([block for frame in frames for block in frame[-1]])
    for part, frame, keys, sizes, blocks in frames:
        own, decoded = decoded[: len(blocks)], decoded[len(blocks) :]
        ids = np.concatenate(own).astype("<u4") if own else np.zeros(0, "<u4")
        ends = np.cumsum(sizes)
        if len(ids) != (ends[-1] if len(ends) else 0):
            raise ValueError("a frame's blocks do not hold its documents")
        starts = ends - np.array(sizes)
        checks = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
        n = len(keys)
        columns = [pa.array([part] * n, pa.int64()), pa.array([frame] * n, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(checks, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "frame", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, in any order."""
    frames = spark.read.schema(FRAME).parquet(path)
    sums = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    within = Window.partitionBy("part").orderBy("frame")
    places = frames.select("part", "frame", "n_ids").withColumn("base", F.sum("n_ids").over(within) - F.col("n_ids"))
    places = places.join(parts, "part").select("part", "frame", (F.col("base") + F.col("part_base")).alias("base"))

    def decode(batches):
        yield from checked(row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6))))

    decoded = frames.mapInArrow(decode, "part long, frame long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    joined = decoded.join(places, ["part", "frame"])
    return joined.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, path)
