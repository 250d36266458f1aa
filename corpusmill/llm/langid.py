"""Language ID by the nearest of several centroids per language.

A text is a normalised TF-IDF vector of hashed byte 2- and 3-grams (ASCII letters lower-cased, digits and
ASCII signs as one blank). Document frequencies come from all training rows. Per language, spherical k-means
over a sample of about ``per_language`` texts (chosen by hash of the row) gives ``k`` centroids; a text
takes the language of the nearest by cosine. A text further from it than a high quantile of that language's training
distances, plus ``margin`` of the way from there to no likeness at all, is rejected; so is one without a letter. Short texts lie further off by nature, so the limits go by
language and length: each sampled text is measured whole and by its first 8, 16, 32, ... bytes, and a length with too few
of them has no limit, or beyond the longest one that one's.

Edge cases: null text or one with no letter gives ``und``, score 0, rejected; rows with a null lang are not
learned from; repeated ids keep their rows; with nothing to learn from every text is ``und``; ties take
the language first in order; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import read, remainder, spans, utf8

BITS2, BITS3 = 11, 13
DIMS = (1 << BITS2) + (1 << BITS3)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
ROWS = 64
LONG = 1 << 20  # bytes of one text that are counted at once
LENGTHS = 15  # classes of length, by the binary logarithm of how many features a text has


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature counts (rows x DIMS) of a few texts."""
    n, folded = len(offsets) - 1, FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    at = []
    if len(data) > 1:
        pair = folded[:-1] * np.uint32(256) + folded[1:]
        code = (pair * np.uint32(2654435761)) >> np.uint32(32 - BITS2)
        keep = (row[1:] == row[:-1]) & (pair != 0x2020)
        at.append((row[:-1] * DIMS + code)[keep])
        if len(data) > 2:
            three = pair[:-1] * np.uint32(256) + folded[2:]
            code = (three * np.uint32(2654435761)) >> np.uint32(32 - BITS3)
            keep = (row[2:] == row[:-2]) & (pair[:-1] != 0x2020)
            at.append((row[:-2] * DIMS + code + (1 << BITS2))[keep])
    return np.bincount(np.concatenate(at) if at else np.zeros(0, np.int64), minlength=n * DIMS).reshape(n, DIMS)


def chunks(column: pa.Array):
    """(i, j, counts) over a column, at most ROWS texts at once; a long text alone is summed in parts."""
    data, offsets = utf8(column)
    for i, j in spans(offsets, 1 << 18):
        if j == i + 1 and offsets[j] - offsets[i] > LONG:
            yield i, j, sum(part_counts(data[offsets[i] : offsets[j]]))
            continue
        for a in range(i, j, ROWS):
            b = min(j, a + ROWS)
            yield a, b, counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def part_counts(text: np.ndarray):
    """Counts of a long text in parts; a feature belongs to the part that it begins in."""
    whole = lambda x: counts(x, np.array([0, len(x)]))
    for a in range(0, len(text), LONG):
        b = a + LONG
        yield whole(text[a : b + 2]) - (whole(text[b : b + 2]) if b < len(text) else 0)


def weigh(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(found).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def length_class(found: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum((found > 0).sum(axis=1), 1)).astype(np.int64), LENGTHS - 1)


def limits(texts: list[str], idf: np.ndarray, centres: np.ndarray, quantile: float, margin: float) -> np.ndarray:
    """The distance limit of each class of length, never larger for longer texts."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    cut = {t for whole in data for t in [whole, *(whole[: 1 << k] for k in range(3, 13) if len(whole) > 1 << k)]}
    of, far = [], []
    for _, _, found in chunks(pa.array([t.decode("utf-8", "ignore") for t in sorted(cut)], pa.string())):
        has = (found > 0).any(axis=1)
        of.append(length_class(found)[has])
        far.append(1 - (weigh(found, idf) @ centres.T).max(axis=1)[has])
    of, far = np.concatenate(of), np.concatenate(far)
    out, last = np.ones(LENGTHS), 0.0
    for c in reversed(range(LENGTHS)):
        if (of == c).sum() >= 20:  # fewer say nothing of a high quantile
            worst = float(np.quantile(far[of == c], quantile))
            last = max(last, worst + margin * (1 - worst))
            out[c] = last
    seen = np.flatnonzero(out < 1)
    if len(seen):
        out[seen[-1] :] = out[seen[-1]]
    return out


def cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; starts from texts far apart."""
    centres = [x.mean(axis=0)]
    near = np.full(len(x), -1.0)
    for _ in range(min(k, len(x)) - 1):
        near = np.maximum(near, x @ (centres[-1] / max(np.linalg.norm(centres[-1]), 1e-9)))
        centres.append(x[int(np.argmin(near))])
    centres = np.array(centres)
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        own = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)


def sampled(rows: DataFrame, sizes: dict[str, int], per_language: int) -> DataFrame:
    """About per_language rows of each language, by hash of id, text and place: neither equal ids nor equal texts go together."""
    share = F.create_map(*[F.lit(x) for name, size in sizes.items() for x in (name, min(1.0, per_language / size))])
    spot = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(1 << 40)) / float(1 << 40)
    return rows.withColumn("spot", spot).where(F.col("spot") < share[F.col("lang")]).select("lang", "text")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", k: int = 4, per_language: int = 500, quantile: float = 0.995, margin: float = 1 / 3) -> dict:
    """The model, from rows with text and lang."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null and text rlike '\\\\p{L}'")

    def frequencies(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for i, j, found in chunks(batch.column(0)):
                total += (found > 0).sum(axis=0)
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMS), -1)), pa.array(np.append(total, n))], ["code", "n"])

    held = {r.code: r.n for r in rows.select("text").mapInArrow(frequencies, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    n = held.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([held.get(c, 0) for c in range(DIMS)]))).astype(np.float32)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"idf": idf, "centres": np.zeros((0, DIMS), np.float32), "of": np.zeros(0, np.int64), "langs": [], "limits": np.zeros((0, LENGTHS))}
    picked = sampled(rows, sizes, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def centres(frame: pd.DataFrame) -> pd.DataFrame:
        texts = pa.array(frame["text"].sort_values(), pa.string())
        x = np.concatenate([weigh(found, shared.value) for _, _, found in chunks(texts)])
        c = cluster(x, k)
        far = limits(frame["text"].tolist(), shared.value, c, quantile, margin)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centre": [v.astype("<f4").tobytes() for v in c], "limits": [far.tolist()] * len(c)})

    found = sorted(picked.groupBy("lang").applyInPandas(centres, "lang string, centre binary, limits array<double>").collect(), key=lambda r: (r.lang, r.centre))
    langs = sorted({r.lang for r in found})
    return {"idf": idf, "centres": np.array([np.frombuffer(r.centre, "<f4") for r in found], np.float32), "of": np.array([langs.index(r.lang) for r in found]), "langs": langs, "limits": np.array([r.limits for r in found])}


def nearest(column: pa.Array, model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of each text; letters are not looked at."""
    names, cosines, beyond = [], [], []
    for _, _, found in chunks(column):
        if not model["langs"]:
            names += ["und"] * len(found)
            cosines.append(np.zeros(len(found)))
            beyond.append(np.ones(len(found), bool))
            continue
        near = weigh(found, model["idf"]) @ model["centres"].T
        best = near.argmax(axis=1)
        names += [model["langs"][c] for c in model["of"][best]]
        cosines.append(np.clip(near[np.arange(len(near)), best].astype(np.float64), 0, 1))
        beyond.append(1 - cosines[-1] > model["limits"][best, length_class(found)])
    return names, np.concatenate(cosines) if cosines else np.zeros(0), np.concatenate(beyond) if beyond else np.zeros(0, bool)


def predict(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, cosine, beyond = nearest(batch.column(1), held.value)
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names = [x if has else "und" for x, has in zip(names, letter)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(letter, cosine, 0.0), pa.float64()), pa.array(beyond | ~letter)], ["doc_id", "lang_pred", "score", "rejected"])

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), letter.alias("letter")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The documents with a letter within the distance limit, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    lettered = docs.where(F.col(text).rlike(r"\p{L}"))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~nearest(batch.column(at), held.value)[2]))

    return lettered.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    found = predict(docs, fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
