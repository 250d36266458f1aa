"""Benchmark decontamination by winnowing.

Words are runs of ASCII digits and letters (lower-cased) and of all non-ASCII characters. Both sides
keep, of every ``window - k + 1`` neighbouring k-gram hashes, the smallest (the last of equals). So any span of
``window`` words that two texts share leaves a common fingerprint. Training fingerprints are joined to
the benchmark's, and each hit is extended to all windows around it, which are compared word by word: the
result is exact. Items of fewer words than a window are windows of their own length, found by keeping
every gram of that length.

The benchmark is joined map-side in blocks whose index takes at most ``block_bytes``, one pass over the documents for
each, so what is broadcast and what a worker holds have a bound whatever the benchmark's size. An index is a few flat arrays:
the items' text, their words, the sorted hashes of all windows with the word where each begins, and the fingerprints.
A block is released before the next one is built.

Edge cases: null or word-less texts have no words and no hits; null or word-less items match nothing; items
with a null id mark words but are not listed; repeated ids keep their rows; empty tables give no rows or no
hits; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import LOWER, gram_hashes, materialize, read, spans, utf8, word_bounds, word_hashes

K, WINDOW = 5, 10
WORD = np.ones(256, bool)
WORD[:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False


class Words:
    """The words of a chunk of texts, with their hashes and rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        offsets = offsets - offsets[0]
        self.data = LOWER[data]
        self.starts, self.ends = word_bounds(WORD[self.data], offsets)
        self.first = np.searchsorted(self.starts, offsets)  # of each row, and the end
        self.n = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.hashes = word_hashes(self.data, self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)

    def inside(self, at: np.ndarray, k: int) -> np.ndarray:
        """Of the positions at, those whose k words lie in one row."""
        at = at[(at >= 0) & (at + k <= len(self.row))]
        return at[self.row[at] == self.row[at + k - 1]]

    def text(self, at: int, k: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[at : at + k], self.ends[at : at + k]))


def fingerprints(words: Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions kept by winnowing, and the k-gram hashes of all positions."""
    grams = gram_hashes(words.hashes, k)
    wide = window - k + 1
    starts = words.inside(np.arange(max(0, len(words.row) - window + 1)), window)
    if not len(starts):
        return np.zeros(0, np.int64), grams
    best, at = grams[starts].copy(), np.zeros(len(starts), np.int64)
    for j in range(1, wide):
        h = grams[starts + j]
        smaller = h <= best
        best[smaller], at[smaller] = h[smaller], j
    keep = np.zeros(len(grams), bool)
    keep[starts + at] = True
    return np.flatnonzero(keep), grams


class Index:
    """A block of the benchmark in flat arrays: texts, words, fingerprints, and all windows in order of length and hash."""

    def __init__(self, items: list[tuple[int | None, str]], k: int = K, window: int = WINDOW):
        self.k, self.window = k, window
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        words = Words(data[offsets[0] : offsets[-1]], offsets)
        kept, grams = fingerprints(words, k, window)
        self.prints = np.unique(grams[kept])
        self.data, self.starts, self.ends = words.data, words.starts.astype(np.int32), words.ends.astype(np.int32)
        self.row = words.row.astype(np.int32)
        self.names = np.array([-1 if i is None else i for i, _ in items], np.int64)
        self.unnamed = np.array([i is None for i, _ in items], bool)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # window length: sorted hashes, and the first words
        size = np.minimum(words.n, window)[words.row]
        place = np.arange(len(words.row)) - words.first[words.row]
        starts = place + size <= words.n[words.row]
        for n in np.unique(size):
            at = np.flatnonzero(starts & (size == n))
            hashes = gram_hashes(words.hashes, int(n))[at]
            order = np.argsort(hashes, kind="stable")
            self.sizes[int(n)] = hashes[order], at[order].astype(np.int32)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.prints, self.data, self.starts, self.ends, self.row, self.names, self.unnamed)) + sum(h.nbytes + a.nbytes for h, a in self.sizes.values())

    def text(self, at: int, k: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[at : at + k], self.ends[at : at + k]))

    def windows(self, at: int, size: int, text: bytes, cache: dict) -> tuple[set, bool]:
        """Items whose windows from place ``at`` in order of hash on hold this text, and whether there is any."""
        if text not in cache:
            hashes, first = self.sizes[size]
            found: set = set()
            end = int(np.searchsorted(hashes, hashes[at], "right"))
            same = [int(i) for i in first[at:end] if self.text(int(i), size) == text]
            found.update(int(self.names[r]) for r in {int(self.row[i]) for i in same} if not self.unnamed[r])
            cache[text] = found, bool(same)
        return cache[text]

    def hits(self, words: Words):
        """(position, length in words, items) of every window of the benchmark in these texts."""
        cache: dict = {}
        for size, (hashes, _) in self.sizes.items():
            grams = gram_hashes(words.hashes, size)
            if size == self.window:
                kept, small = fingerprints(words, self.k, self.window)
                kept = kept[member(self.prints, small[kept])]
                at = np.unique((kept[:, None] - np.arange(self.window - self.k + 1)).ravel())
            else:
                at = np.arange(len(grams))
            at = words.inside(at, size)
            at = at[member(hashes, grams[at])]
            for i, spot in zip(at.tolist(), np.searchsorted(hashes, grams[at]).tolist()):
                found, any_ = self.windows(spot, size, words.text(i, size), cache)
                if any_:
                    yield i, size, found


def member(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def scan(index: Index, column: pa.Array):
    """Per row: words, hit spans as (start, end) in words, items."""
    data, offsets = utf8(column)
    for i, j in spans(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1])
        edge = np.zeros(len(words.row) + 1, np.int32)
        items: dict[int, set] = {}
        for at, size, found in index.hits(words):
            edge[at] += 1
            edge[at + size] -= 1
            items.setdefault(int(words.row[at]), set()).update(found)
        hit = np.cumsum(edge[:-1]) > 0
        for row, n in enumerate(words.n.tolist()):
            runs = []
            if row in items:
                first = words.first[row]
                marks = np.diff(np.concatenate([[0], hit[first : first + n].astype(np.int8), [0]]))
                runs = list(zip(np.flatnonzero(marks == 1).tolist(), np.flatnonzero(marks == -1).tolist()))
            yield n, runs, sorted(x for x in items.get(row, ()) if x is not None)


#: Bytes of an index for a byte of text; for words of one letter up to about twice as much.
SPREAD = 12


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """The benchmark's items in lists whose index takes about block_bytes each; a longer item stands alone."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"), F.octet_length(text).alias("n")).where("n > 0").toLocalIterator():
        if held and (size + r.n) * SPREAD > block_bytes:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += r.n
    yield held


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64()))])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 128 << 20) -> DataFrame:
    """doc_id, n_words, spans (start, end in words) and items of every document."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def against(index):
        def run(batches):
            for batch in batches:
                rows = list(scan(index.value, batch.column(1)))
                found = [[{"start": a, "end": b} for a, b in r[1]] for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(found, OUT.field("spans").type), pa.array([r[2] for r in rows], OUT.field("items").type)], schema=OUT)

        return run

    schema = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"
    parts = blocks(benchmark, item_id, item_text, block_bytes)
    one, two = next(parts), next(parts, None)
    if two is None:
        return chosen.mapInArrow(against(spark.sparkContext.broadcast(Index(one))), schema)
    # several blocks: the hits of each are written, the rows numbered once, and put together by row
    numbered = materialize(chosen.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = []
    for part in chain([one, two], parts):
        held = spark.sparkContext.broadcast(Index(part))
        hits = numbered.select(F.col("_row").alias("doc_id"), "text").mapInArrow(against(held), schema)
        found.append(materialize(hits if not found else hits.where(F.size("spans") > 0), "hits"))
        held.destroy()
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    spots = F.flatten(F.transform(F.flatten(F.collect_list("spans")), lambda s: F.sequence(s["start"], s["end"] - 1)))
    merged = whole.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(spots)).alias("_spots"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    opens = F.array_except("_spots", F.transform("_spots", lambda x: x + 1))
    closes = F.array_except("_spots", F.transform("_spots", lambda x: x - 1))
    merged = merged.withColumn("spans", F.zip_with(F.array_sort(opens), F.array_sort(closes), lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end"))))
    merged = merged.withColumnRenamed("doc_id", "_row").drop("_spots")
    return numbered.select("_row", "doc_id").join(merged, "_row").select("doc_id", "n_words", "spans", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = 128 << 20) -> DataFrame:
    """The documents that hold no window of the benchmark, all columns as they are. Null texts stay."""
    spark, at = docs.sparkSession, docs.columns.index(text)

    def without(index):
        def keep(batches):
            for batch in batches:
                yield batch.filter(pa.array([not runs for _, runs, _ in scan(index.value, batch.column(at))], pa.bool_()))

        return keep

    parts, held = blocks(benchmark, "item_id", "text", block_bytes), None
    for part in parts:
        if held is not None:  # what the block before left is written, so that its index can go
            docs = materialize(docs, "clean")
            held.destroy()
        held = spark.sparkContext.broadcast(Index(part))
        docs = docs.mapInArrow(without(held), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    found = find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
spots AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (rid) LEFT JOIN items USING (rid)
"""
