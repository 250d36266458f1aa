"""Toxicity: a string-kernel support vector machine with Nystroem landmarks.

The kernel compares two words by the letter triples they share as subsequences: a triple that spreads over
``s`` letters (at most 5) weighs ``DECAY**s`` on each side, so letters put in between or left out cost a little
instead of all. Letters come from a folded alphabet (lower case, common digit spellings as their letters,
other letters in 37 classes); signs inside a word are skipped and single letters that follow one another are
read as one word. Words are scaled to unit self-weight by their length.

A sentence, and a text, is as toxic as its worst word. Training knows only whole labelled texts: words that
no clean text has are candidates; each toxic text's witness is at first its most telling one, then the one
that the machine scores highest, in rounds. Landmarks are the most telling words and a spread of clean words.
The machine is linear in the Nystroem features, so for scoring it folds into one weight per letter triple.

Training takes at most ``train_docs`` labelled documents (smallest hash of the id), in one task; all rows are
scored, whole. Inside training, candidates are words of 3 to 64 letters, at most 20 for a toxic text (the most telling ones);
negatives are the 2,000 most frequent clean words and 6,000 drawn ones, joined in rounds by those that come out highest among the
400,000 most frequent. These bound the fit's time on long texts; scoring has no such limits.

Edge cases: null, empty and word-less texts score as a text without a telling word; null ids are scored and
never learned from; an id labelled twice takes the larger label; with no label, or one label only, scores are that
label's share; repeated ids keep their rows; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import read, remainder
from corpusmill.llm.quality import labelled_rows

DECAY = 0.6
PART = 4
GAPS = [(a, b) for b in range(2, 5) for a in range(1, b)]
CHUNK_CHARS = 1 << 19


def alphabet() -> np.ndarray:
    """Class of each code point below 65536: 0 white space, 255 skipped, 1-63 letters."""
    table = np.full(65537, 255, np.uint8)
    for c in range(65536):
        ch = chr(c)
        if ch.isspace():
            table[c] = 0
        elif "a" <= ch <= "z":
            table[c] = c - 96
        elif unicodedata.category(ch)[0] in "LN":
            table[c] = 27 + c % 37
    for digit, letter in zip("0134578", "oieastb"):
        table[ord(digit)] = ord(letter) - 96
    table[65536] = 27  # beyond the basic plane
    return table


_CLASSES: list = []


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all texts, a 0 before each word, and the text of each 0."""
    if not _CLASSES:
        _CLASSES.append(alphabet())
    texts = [t.lower() for t in texts]
    raw = np.frombuffer("\n".join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _CLASSES[0][np.minimum(raw, 65536)]
    row = np.zeros(len(cls), np.int32)
    row[np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])] = 1 if texts else 0
    row = np.cumsum(row) - 1
    keep = cls != 255
    cls, row = cls[keep], row[keep]
    if not len(cls):
        return cls, row
    keep = np.append((cls[1:] != 0) | (cls[:-1] != 0), cls[-1] != 0)
    keep[:-1] &= ~((cls[:-1] == 0) & (cls[1:] == 0))
    cls, row = cls[keep], row[keep]
    zero = np.flatnonzero(cls == 0)
    if not len(zero):
        return cls, row[:0]
    single = np.diff(np.append(zero, len(cls))) == 2
    own = row[np.minimum(zero + 1, len(row) - 1)]
    joined = np.zeros(len(zero), bool)
    joined[1:] = single[1:] & single[:-1] & (own[1:] == own[:-1])
    keep = np.ones(len(cls), bool)
    keep[zero[joined]] = False
    return cls[keep], own[~joined]


def triples(cls: np.ndarray):
    """(position, code, weight) of the letter triples, one gap shape at a time."""
    word = np.cumsum(cls == 0)
    c = cls.astype(np.int32)
    for a, b in GAPS:
        if len(c) > b:
            at = np.flatnonzero((word[b:] == word[:-b]) & (cls[:-b] != 0))
            yield at, (c[at] << 12) | (c[at + a] << 6) | c[at + b], DECAY ** (b + 1)


def scale(lengths: np.ndarray) -> np.ndarray:
    """One over the self-weight of words by length."""
    total = sum(np.maximum(lengths - b, 0) * DECAY ** (2 * b + 2) for _, b in GAPS)
    return 1 / np.sqrt(np.maximum(total, 1e-9)) * (total > 0)


def word_scores(cls: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The kernel machine's value (without its bias) of each word."""
    zero = np.flatnonzero(cls == 0)
    value = np.zeros(len(cls), np.float32)
    for at, code, weight in triples(cls):
        value[at] += beta[code] * np.float32(weight)
    return np.add.reduceat(value, zero) * scale(np.diff(np.append(zero, len(cls))) - 1)


def text_scores(texts: list[str], beta: np.ndarray) -> np.ndarray:
    """The largest word value of each text, 0 at least."""
    out, i = np.zeros(len(texts)), 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= CHUNK_CHARS:
            size += len(texts[j])
            j += 1
        cls, row = letters(texts[i:j])
        if len(row):
            np.maximum.at(out, row + i, word_scores(cls, beta))
        i = j
    return out


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Kernel values, words x landmarks."""

    def table(items):
        cls = np.frombuffer(b"".join(b"\0" + w for w in items), np.uint8)
        word = np.cumsum(cls == 0) - 1
        lengths = scale(np.array([len(w) for w in items]))
        parts = [(word[at], code, np.full(len(at), weight, np.float32)) for at, code, weight in triples(cls)]
        rows, codes, weights = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        return rows, codes, weights * lengths[rows].astype(np.float32)

    rows, codes, weights = table(landmarks)
    seen, at = np.unique(codes, return_inverse=True)
    dense = np.zeros((len(seen) + 1, len(landmarks)), np.float32)
    np.add.at(dense, (at, rows), weights)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for i in range(0, len(words), 4096):
        rows, codes, weights = table(words[i : i + 4096])
        at = np.minimum(np.searchsorted(seen, codes), len(seen) - 1) if len(seen) else codes * 0
        hit = seen[at] == codes if len(seen) else np.zeros(len(codes), bool)
        order = np.argsort(rows[hit], kind="stable")
        r, a, w = rows[hit][order], at[hit][order], weights[hit][order]
        for k in range(0, len(r), 1 << 15):
            rr, start = np.unique(r[k : k + (1 << 15)], return_index=True)
            out[i + rr] += np.add.reduceat(dense[a[k : k + (1 << 15)]] * w[k : k + (1 << 15), None], start, axis=0)
    return out


def solve(z: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float = 1e-4, rounds: int = 12) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; classes weigh the same. The last weight is the bias."""
    x = np.hstack([z, np.ones((len(z), 1), z.dtype)]).astype(np.float64)
    weight = share * np.where(y > 0, 0.5 / share[y > 0].sum(), 0.5 / share[y < 0].sum())
    v = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        short = y * (x @ v) < 1
        xs, ws = x[short], weight[short]
        new = np.linalg.solve(xs.T @ (xs * ws[:, None]) + np.diag(ridge), xs.T @ (ws * y[short]))
        if np.allclose(new, v, atol=1e-6):
            break
        v = new
    return v


def train(rows: list[tuple[int, str]], landmarks: int = 160, seed: int = 5) -> tuple[np.ndarray, float, float]:
    """Triple weights and the slope and shift of the score, from (label, text)."""
    beta = np.zeros(1 << 18, np.float32)
    ones = sum(y for y, _ in rows)
    share = (ones + 0.5) / (len(rows) + 1)
    dull = beta, 0.0, float(np.log(share / (1 - share)))
    if ones in (0, len(rows)):
        return dull
    rng = np.random.default_rng(seed)
    bags = []  # of the toxic texts only
    toxic, clean, parts, clean_parts = Counter(), Counter(), Counter(), Counter()
    for y, text in rows:
        words = {w for w in bytes(letters([text])[0]).split(b"\0") if 3 <= len(w) <= 64}
        if y:
            bags.append(words)
        (toxic if y else clean).update(words)
        (parts if y else clean_parts).update({w[i : i + PART] for w in words for i in range(max(1, len(w) - PART + 1))})
    odds = {x: np.log((n + 0.5) / ones) - np.log((clean_parts[x] + 0.5) / (len(rows) - ones)) for x, n in parts.items() if n >= 2}

    whole = {w: np.log((n + 0.5) / ones) - np.log((clean[w] + 0.5) / (len(rows) - ones)) for w, n in toxic.items() if n >= 3}

    def best_part(word):
        return max((word[i : i + PART] for i in range(max(1, len(word) - PART + 1))), key=lambda x: odds.get(x, 0.0))

    def tell(word):
        return max(odds.get(best_part(word), 0.0), whole.get(word, 0.0))

    def rare(word):  # hardly in any clean text; a few wrong labels do not matter
        return clean[word] * ones <= 0.05 * toxic[word] * (len(rows) - ones)

    telling = sorted((w for w in toxic if tell(w) > 1.5 and rare(w)), key=lambda w: (-tell(w), -toxic[w], w))
    if not telling:
        return dull
    common = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))]
    covered: Counter = Counter()
    marks = []
    for w in telling:  # at most three landmarks for one telling part
        best = best_part(w) if whole.get(w, 0.0) < tell(w) else w
        if len(marks) < landmarks // 2 and covered[best] < 3:
            covered[best] += 1
            marks.append(w)
    marks = list(dict.fromkeys(marks + common[: landmarks // 8] + [common[i] for i in rng.permutation(len(common))[: landmarks - landmarks // 2 - landmarks // 8]]))
    values, axes = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    root = axes * (np.maximum(values, 0) > 1e-6) / np.sqrt(np.maximum(values, 1e-6))

    def nystroem(words):
        return kernel(words, marks).astype(np.float64) @ root

    hints = [sorted((w for w in words if rare(w)), key=lambda w: (-tell(w), w))[:20] for words in bags]
    hints = [h for h in hints if h]
    strong = [w for w in telling if toxic[w] >= max(3, ones // 100)]  # in so many toxic texts, in hardly a clean one
    marked = set(strong)
    common = [w for w in common if w not in marked]
    negatives = [common[i] for i in sorted(rng.permutation(len(common))[:6000])] + common[:2000]
    witness = [h[0] for h in hints]
    candidates = sorted({w for h in hints for w in h} | set(strong))
    features = dict(zip(candidates, nystroem(candidates)))
    for turn in range(4):
        positives = witness + strong
        share = np.array([1.0] * len(witness) + [float(toxic[w]) for w in strong] + [1.0] * len(negatives))
        z = np.vstack([np.array([features[w] for w in positives]), nystroem(negatives)])
        v = solve(z, np.array([1.0] * len(positives) + [-1.0] * len(negatives)), share)
        witness = [max(h, key=lambda w: (features[w] @ v[:-1], w)) for h in hints]
        beta = fold(marks, root @ v[:-1])
        if turn < 3:  # clean words that come out highest join the negatives
            rest = common if len(common) < 400_000 else common[:400_000]
            got = word_scores(np.frombuffer(b"".join(b"\0" + w for w in rest), np.uint8), beta)
            negatives = list(dict.fromkeys(negatives + [rest[i] for i in np.argsort(-got)[:1500]]))
    f = text_scores([t for _, t in rows], beta)
    return beta, *calibrate(f, np.array([y for y, _ in rows]))


def fold(marks: list[bytes], alpha: np.ndarray) -> np.ndarray:
    """The landmarks' triples, each weighed with its landmark's share."""
    beta = np.zeros(1 << 18, np.float64)
    for word, a in zip(marks, alpha):
        for at, code, weight in triples(np.frombuffer(b"\0" + word, np.uint8)):
            np.add.at(beta, code, a * weight * scale(np.array([len(word)]))[0])
    return beta.astype(np.float32)


def calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve with its middle where the two labels part best."""
    order = np.argsort(f, kind="stable")
    fs, ys = f[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(ys)]) + np.concatenate([np.cumsum((1 - ys)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    edge = [(fs[max(k - 1, 0)] + fs[min(k, len(fs) - 1)]) / 2 for k in (best[0], best[-1])]
    middle = float(sum(edge) / 2)
    spread = max(1e-3, float(np.median(fs[ys == 1]) - np.median(fs[ys == 0])))
    slope = 8 / spread
    return slope, -slope * middle


def fit(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", train_docs: int = 6000):
    chosen = labelled_rows(docs, labels, label, doc_id, text, train_docs).where("text is not null").select("y", "text")

    def learn(batches):
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        beta, slope, shift = train(sorted(rows))
        yield pa.RecordBatch.from_arrays([pa.array([beta.astype("<f4").tobytes()], pa.binary()), pa.array([slope]), pa.array([shift])], ["beta", "slope", "shift"])

    found = chosen.repartition(1).mapInArrow(learn, "beta binary, slope double, shift double").first()
    if found is None:  # no labelled text: no task has run
        return train([])
    return np.frombuffer(found.beta, "<f4"), found.slope, found.shift


def probabilities(column: pa.Array, model) -> np.ndarray:
    beta, slope, shift = model
    return 1 / (1 + np.exp(-(slope * text_scores([t or "" for t in column.to_pylist()], beta) + shift)))


def score(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probabilities(batch.column(1), held.value), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column(at), held.value) < limit))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    scored = score(docs, fit(docs, labels.where(~held_out), "toxic"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
