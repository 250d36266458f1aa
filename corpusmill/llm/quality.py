"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of hashed features: its words, the 3- and 4-byte n-grams inside
and across them, and neighbouring word pairs (hashed by the difference of the word hashes, so that any word
said twice in a row is one feature). A softmax over the mean gives the label; vectors and softmax are trained
together by numpy stochastic gradient descent. For scoring, vectors and softmax fold into one number per
feature, so a whole text costs one table lookup per feature.

Training takes at most ``train_docs`` labelled documents (those with the smallest hash of the id, of a repeated id its first
row), in one task; everything is scored. Labels join by id; a doc_id labelled twice takes the larger label.

A text beyond ``PART`` bytes is taken in parts, in training and scoring: an n-gram counts in the part that it begins in, a word across
parts is hashed piece by piece, and a pair across parts is kept, so that the features are those of the whole text while
a part's are held.

Edge cases: null, empty and word-less texts have no features and score by the bias alone, as an average
document; null ids are scored and never trained on; with no label, or only one label, to learn from, scores are
that label's share (0.5 with none); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import flag_table, long_word_hash, mix, read, remainder, spans, utf8, word_bounds, word_hashes

BITS = 16
KINDS = 4  # words, 3-grams, 4-grams, pairs
MASK = np.uint64((1 << BITS) - 1)
PART = 1 << 20
SPACE = flag_table(b" \t\n\r\v\f").astype(bool)


def pair_codes(h: np.ndarray) -> np.ndarray:
    return (mix(h[1:] - h[:-1]) & MASK).astype(np.int64) + (3 << BITS)


def grams(data: np.ndarray):
    """n and the codes of the n-grams at each byte, for 3 and 4."""
    rolled = data.astype(np.uint32)
    for n in (2, 3, 4):
        if len(data) < n:
            break
        rolled = rolled[:-1] * np.uint32(257) + data[n - 1 :]
        if n > 2:
            yield n, ((rolled * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64) + ((n - 2) << BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature codes of a chunk of texts, and the row of each."""
    offsets = offsets - offsets[0]
    codes, rows = [], []
    starts, ends = word_bounds(~SPACE[data], offsets)
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = word_hashes(data, starts, ends)
    codes.append((h & MASK).astype(np.int64))
    rows.append(row)
    same = row[1:] == row[:-1]
    codes.append(pair_codes(h)[same])
    rows.append(row[1:][same])
    byte_row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n, code in grams(data):
        same = byte_row[n - 1 :] == byte_row[: len(code)]
        codes.append(code[same])
        rows.append(byte_row[: len(code)][same])
    return np.concatenate(codes), np.concatenate(rows)


def word_parts(text: np.ndarray, part: int):
    """Hashes of the words of a text in order, those of some part bytes at a time."""
    a, n = 0, len(text)
    while a < n:
        b = min(a + part, n)
        gaps = np.flatnonzero(SPACE[text[a:b]])
        whole = n if b == n else a + (int(gaps[-1]) + 1 if len(gaps) else 0)  # up to here words end in the part
        starts, ends = word_bounds(~SPACE[text[a:whole]], np.array([0, whole - a]))
        h = word_hashes(text[a:whole], starts, ends)
        a = whole
        if whole < b:  # a word that goes on
            while b < n and not SPACE[text[b : b + part]].any():
                b += part
            b = min(b, n)
            b += int(np.argmax(SPACE[text[b : b + part]])) if b < n else 0
            h, a = np.concatenate([h, long_word_hash(text[whole:b])]), b
        yield h


def long_features(text: np.ndarray, part: int = PART):
    """The codes of features() of one text, in pieces."""
    if all(SPACE[text[a : a + part]].all() for a in range(0, len(text), part)):
        return
    last = np.zeros(0, np.uint64)
    for h in word_parts(text, part):
        yield (h & MASK).astype(np.int64)
        h = np.concatenate([last, h])
        yield pair_codes(h)
        last = h[-1:]
    for a in range(0, len(text), part):
        for _, code in grams(text[a : a + part + 3]):
            yield code[:part]


def feature_counts(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's features in order, and how often each is there."""
    if len(text) <= PART:
        return np.unique(features(text, np.array([0, len(text)]))[0], return_counts=True)
    counts = sum((np.bincount(codes, minlength=KINDS << BITS) for codes in long_features(text)), np.zeros(KINDS << BITS, np.int64))
    found = np.flatnonzero(counts)
    return found, counts[found]


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], dims: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """The weight of each feature and the bias of label 1 against label 0, from (label, codes, counts)."""
    rng = np.random.default_rng(seed)
    table = np.zeros(KINDS << BITS, np.float32)
    ones = sum(r[0] for r in rows)
    if not rows or ones in (0, len(rows)):
        share = (ones + 0.5) / (len(rows) + 1)
        return table, float(np.log(share / (1 - share)))
    vectors = rng.normal(0, 1 / dims, (KINDS << BITS, dims)).astype(np.float32)
    out = np.zeros((dims, 2), np.float32)
    bias = np.log(np.array([len(rows) - ones, ones], np.float32) / len(rows))
    rows = [(y, codes, (counts / counts.sum()).astype(np.float32)) for y, codes, counts in rows if len(codes)]
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, codes, share = rows[k]
            lr = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[codes]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            vectors[codes] -= (lr * 40) * np.outer(share, back)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", train_docs: int = 8000) -> tuple[np.ndarray, float]:
    """Learns from the labels (doc_id, label) given; null labels do not count."""
    chosen = labelled_rows(docs, labels, label, doc_id, text, train_docs)

    def extract(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            out = []
            for y, i in zip(batch.column(1).to_pylist(), range(len(offsets) - 1)):
                codes, counts = feature_counts(data[offsets[i] : offsets[i + 1]])
                out.append((y, codes.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["y", "codes", "counts"])

    def learn(batches):
        rows = [(y, np.frombuffer(c, "<u4").astype(np.int32), np.frombuffer(n, "<u4").astype(np.float32)) for b in batches for y, c, n in zip(*(col.to_pylist() for col in b.columns))]
        rows.sort(key=lambda r: (len(r[1]), r[0], r[1].tobytes()))
        table, bias = train(rows)
        yield pa.RecordBatch.from_arrays([pa.array([table.astype("<f4").tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])

    found = chosen.mapInArrow(extract, "y int, codes binary, counts binary").repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    if found is None:  # no labelled text: no task has run
        return train([])
    return np.frombuffer(found.weights, "<f4"), found.bias


def sample_labels(labels: DataFrame, doc_id: str, label: str, bound: int) -> DataFrame:
    """At most bound labelled ids (doc_id, y), by the smallest hash; so small that they can be broadcast."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, bound: int) -> DataFrame:
    """text and y of at most bound rows: of each sampled id, the first row by place (with a text, if it has any)."""
    picked = sample_labels(labels, doc_id, label, bound)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    place = F.min(F.struct(F.col("text").isNull().alias("none"), "_row"))
    one = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(place.alias("at")).select(F.col("at._row").alias("_row"), "y")
    return rows.join(F.broadcast(one), "_row").select("text", "y")


def score(docs: DataFrame, model: tuple[np.ndarray, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = held.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = []
            for i, j in spans(offsets):
                if j == i + 1 and offsets[j] - offsets[i] > PART:
                    parts = [(weights[codes].sum(dtype=float), len(codes)) for codes in long_features(data[offsets[i] : offsets[j]])]
                    total, n = (np.array([sum(x)]) for x in (zip(*parts) if parts else ((0.0,), (0,))))
                else:
                    codes, rows = features(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                    total = np.bincount(rows, weights[codes], j - i)
                    n = np.bincount(rows, minlength=j - i)
                out.append(1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 3) == 1
    scored = score(docs, fit(docs, labels.where(~held_out), "quality"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
