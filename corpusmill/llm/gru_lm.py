"""Language-model scoring with a gated recurrent network.

Counts of all training tokens are gathered by Spark. The ``inputs`` most frequent tokens have an input vector each,
and rarer ones share one. The output is factored in classes: the ``head`` most frequent tokens lie in classes of
``SIZE`` neighbours by rank, the other known tokens in ``TAILS`` classes of about equal mass, all tokens beyond the known
table in one last class. P(token) = P(class | state) * P(token | class). Inside a head class the second factor is a
softmax over the state too; in the other classes it is the token's share by the base model's smoothed counts, so any token has
a chance. The network's value is mixed with the base model's (``trust``), token by token.

Training is truncated backpropagation through time in numpy, over all training texts: in each of the ``rounds`` every
task goes on from the common weights over its part of the texts (by hash of the text), and the weights are averaged, by
tokens read. Scoring carries the state over the windows of a text, so a text's log-likelihood is complete.

Counts beyond the ``known`` most frequent tokens are not broadcast: texts send those of their tokens that are not
among them to a join with the table of counts.

Edge cases: null text is empty and has its end token alone; null and repeated ids keep their rows (a null id is not
held out: its remainder is 0 only by convention, and it is scored as held out); with no training text, all tokens
share the one chance of an unknown token; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, read, remainder, spans, utf8

END = b" "  # no word holds white space
HIDDEN, DIMS, WINDOW = 16, 16, 32
SIZE, TAILS = 48, 8  # tokens of a head class, classes of the other known tokens
GROUP = 8 << 20  # bytes of text split in one step
ROWS = 8192  # rows of class chances held at once
LANES = 2048  # texts scored side by side


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; white space is the six ASCII characters."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def split_groups(column: pa.Array):
    """(words numbered within the group, each text's bounds among them) of groups of texts; ends are left out."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets = utf8(column)
    for i, j in spans(offsets, GROUP):
        split = pc.ascii_split_whitespace(pc.ascii_lower(column[i:j]))
        edges = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten()
        sound = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # blanks at either end leave empty words
        if not sound.all():
            edges = np.concatenate([[0], np.cumsum(sound)])[edges - edges[0]]
            words = words.filter(pa.array(sound))
        yield words.dictionary_encode(), edges - edges[0]


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), n over the column text: counts of each group of texts, then by word."""

    def count(batches):
        for batch in batches:
            for words, _ in split_groups(batch.column(0)):
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                for i in range(0, len(n), 50_000):
                    yield pa.RecordBatch.from_arrays([words.dictionary[i : i + 50_000].cast(pa.large_binary()).cast(pa.binary()), pa.array(n[i : i + 50_000])], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["word", "n"])

    return docs.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, bound: int) -> pa.Table:
    """At most bound of the most frequent words, by falling count: those above a count found from a histogram."""
    step = F.floor(F.log2("n") * 16)
    histogram = sorted(((r.step, r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, cut = 0, None
    for s, n in histogram:
        total += n
        if total > bound:
            break
        cut = s
    table = counts.where(step >= cut if cut is not None else F.lit(False)).select("word", "n").toArrow()
    return table.sort_by([("n", "descending"), ("word", "ascending")])


class Vocabulary:
    """Known tokens by falling count, and the classes of all tokens."""

    def __init__(self, counts: np.ndarray, total: int, distinct: int, head: int, inputs: int):
        self.total, self.distinct, self.counts = total, distinct, counts
        self.head, self.inputs = min(head, len(counts)), min(inputs, len(counts))
        self.heads = -(-self.head // SIZE)
        other = counts[self.head :] + 0.1
        self.of = np.append(np.arange(self.head) // SIZE, self.heads + np.minimum(np.cumsum(other) / max(other.sum(), 1) * TAILS, TAILS - 1).astype(np.int64))
        self.classes = self.heads + TAILS + 1
        self.of = np.append(self.of, self.classes - 1)  # the id behind all known ones
        self.mass = np.bincount(self.of[:-1], np.where(np.arange(len(counts)) < self.head, counts, counts + 0.1), self.classes)
        self.mass[-1] = total - int(counts.sum()) + 0.1 * (distinct - len(counts) + 1)
        self.norm = total + 0.1 * (distinct + 1)
        self.base = np.log10((counts + 0.1) / self.norm)
        self.end = 0


def start_weights(v: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape, by):
        return (rng.normal(size=shape) / np.sqrt(by)).astype(np.float32)

    w = {"emb": normal(v.inputs + 1, DIMS, by=DIMS), "wx": normal(DIMS, 3 * HIDDEN, by=DIMS), "wh": normal(HIDDEN, 3 * HIDDEN, by=HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32)}
    w["wc"] = np.zeros((HIDDEN, v.classes), np.float32)
    w["bc"] = np.log(np.maximum(v.mass, 1e-3) / v.norm).astype(np.float32)
    w["wi"] = np.zeros((v.heads, HIDDEN, SIZE), np.float32)
    w["bi"] = np.full((v.heads, SIZE), -1e4, np.float32)  # places without a token have no chance
    w["bi"].reshape(-1)[: v.head] = np.log(v.counts[: v.head] / np.maximum(v.mass[v.of[: v.head]], 1))
    return w


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def run_states(w, pre: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States after each step (steps x batch x HIDDEN) for inputs times weights (steps x batch x 3 HIDDEN), and what the way back needs."""
    states, kept = np.empty((len(pre), *h.shape), np.float32), []
    for t in range(len(pre)):
        gates = h @ w["wh"]
        zr = _sigmoid(pre[t][:, : 2 * HIDDEN] + gates[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(pre[t][:, 2 * HIDDEN :] + r * gates[:, 2 * HIDDEN :])
        if keep:
            kept.append((h, z, r, c, gates[:, 2 * HIDDEN :]))
        h = h + z * (c - h)
        states[t] = h
    return states, kept


_ones = np.ones(1 << 16, np.float32)


def _log_softmax(logits: np.ndarray, pick: np.ndarray, back: bool):
    """Log chances of the picked columns, and chances less one at them."""
    np.minimum(logits, 60, out=logits)  # far above any that training gives; keeps the sum finite
    rows = np.arange(len(pick))
    out = logits[rows, pick]
    np.exp(logits, out=logits)
    sums = logits @ _ones[: logits.shape[1]]
    out -= np.log(sums)
    if back:
        logits /= sums[:, None]
        logits[rows, pick] -= 1
    return out, logits


def class_parts(w, v: Vocabulary, states: np.ndarray, y: np.ndarray, back: bool = False):
    """Natural log chances of the targets y given states (rows), inside other classes than the head's only that of the class; and gradients."""
    cls = v.of[y]
    if back:
        out, p = _log_softmax(states @ w["wc"] + w["bc"], cls, back)
        grads = {"wc": states.T @ p, "bc": p.sum(axis=0), "wi": np.zeros_like(w["wi"]), "bi": np.zeros_like(w["bi"]), "dh": p @ w["wc"].T}
    else:
        out = np.empty(len(y), np.float32)
        for a in range(0, len(y), ROWS):
            out[a : a + ROWS] = _log_softmax(states[a : a + ROWS] @ w["wc"] + w["bc"], cls[a : a + ROWS], back)[0]
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(v.heads + 1)).tolist()
    for c in range(v.heads):
        at = order[bounds[c] : bounds[c + 1]]
        if len(at):
            own = states[at]
            part, q = _log_softmax(own @ w["wi"][c] + w["bi"][c], y[at] - c * SIZE, back)
            out[at] += part
            if back:
                grads["wi"][c], grads["bi"][c] = own.T @ q, q.sum(axis=0)
                grads["dh"][at] += q @ w["wi"][c].T
    return (out, grads) if back else (out, None)


def gradients(w, v: Vocabulary, x: np.ndarray, y: np.ndarray, h: np.ndarray):
    """Loss (natural log, summed) of one window from state h on, its gradients, and the last state.

    x and y are steps x lanes; gradients of "emb" come as rows and values."""
    pre = w["emb"][x] @ w["wx"] + w["b"]
    states, kept = run_states(w, pre, h, keep=True)
    out, g = class_parts(w, v, states.reshape(-1, HIDDEN), y.ravel(), back=True)
    dstates = g.pop("dh").reshape(states.shape)
    dh, dpre, g["wh"] = np.zeros_like(h), np.empty((*x.shape, 3 * HIDDEN), np.float32), np.zeros_like(w["wh"])
    for k in range(len(x) - 1, -1, -1):
        before, z, r, c, gate = kept[k]
        d = dh + dstates[k]
        dc = d * z * (1 - c * c)
        dpre[k, :, :HIDDEN] = d * (c - before) * z * (1 - z)
        dpre[k, :, HIDDEN : 2 * HIDDEN] = dc * gate * r * (1 - r)
        dpre[k, :, 2 * HIDDEN :] = dc
        dg = dpre[k].copy()
        dg[:, 2 * HIDDEN :] *= r
        g["wh"] += before.T @ dg
        dh = d * (1 - z) + dg @ w["wh"].T
    flat = dpre.reshape(-1, 3 * HIDDEN)
    g["wx"], g["b"] = w["emb"][x.ravel()].T @ flat, flat.sum(axis=0)
    order = np.argsort(x.ravel(), kind="stable")
    rows, first = np.unique(x.ravel()[order], return_index=True)
    g["emb"] = rows, np.add.reduceat((flat @ w["wx"].T)[order], first, axis=0)
    return -float(out.sum()), g, states[-1]


def train_stream(w, v: Vocabulary, seen: dict, stream: np.ndarray, rate: float = 0.08, lanes: int = 256) -> int:
    """One pass over token ids, laid in lanes; weights and their squared gradients so far change in place (Adagrad). Returns the tokens read."""
    lanes = max(1, min(lanes, len(stream) // (4 * WINDOW)))
    steps = -(-len(stream) // lanes)
    if steps < 2:
        return 0
    ids = np.resize(stream, lanes * steps).reshape(lanes, steps).T  # the last lane may run into the first again
    h = np.zeros((lanes, HIDDEN), np.float32)

    def step(key, g, at=slice(None)):
        g = np.clip(g / lanes, -1, 1)
        seen[key][at] += g * g
        w[key][at] -= rate * g / np.sqrt(seen[key][at])

    for t in range(0, steps - 1, WINDOW):
        x = np.minimum(ids[t : min(t + WINDOW, steps - 1)], v.inputs)
        _, g, h = gradients(w, v, x, ids[t + 1 : t + 1 + len(x)], h)
        rows, values = g.pop("emb")
        step("emb", values * lanes, rows)
        for key, value in g.items():
            step(key, value)
    return len(stream)


def pack_weights(w) -> bytes:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype("<f4").tobytes()


def unpack_weights(data: bytes, like) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def train(docs: DataFrame, v: Vocabulary, ids, rounds: int = 2) -> dict[str, np.ndarray]:
    """Weights averaged over the tasks, in rounds; docs has the column text, ids is the broadcast table of words."""
    spark = docs.sparkSession
    w = start_weights(v)
    part = F.pmod(F.xxhash64("text"), F.lit(rounds))
    for turn in range(rounds):
        held = spark.sparkContext.broadcast(pack_weights(w))

        def learn(batches, held=held):
            table, mine, n = lookup(ids), unpack_weights(held.value, w), 0
            seen = {k: np.full(x.shape, 1e-3, np.float32) for k, x in mine.items()}
            for batch in batches:
                for words, edges in split_groups(batch.column(0)):
                    n += train_stream(mine, v, seen, with_ends(table, v, words, edges)[0])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([pack_weights(mine)], pa.binary()), pa.array([n], pa.int64())], ["weights", "n"])

        def average(batches):
            total, n = None, 0
            for batch in batches:
                for data, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    part = np.frombuffer(data, "<f4").astype(np.float64) * k
                    total, n = (part if total is None else total + part), n + k
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype("<f4").tobytes()], pa.binary()), pa.array([n], pa.int64())], ["weights", "n"])

        parts = docs.where(part == turn).select("text").mapInArrow(learn, "weights binary, n long")
        mean = parts.repartition(16).mapInArrow(average, parts.schema).repartition(1).mapInArrow(average, parts.schema).first()
        if mean:
            w = unpack_weights(mean.weights, w)
    return w


def with_ends(table: dict, v: Vocabulary, words: pa.DictionaryArray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, each with its end behind it (the id behind all known ones for other tokens), and their bounds."""
    names = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    known = np.fromiter((table.get(x, -1) for x in names), np.int32, len(names))
    flat = np.where(known < 0, np.int32(len(v.counts)), known)[words.indices.to_numpy()]
    bounds = edges + np.arange(len(edges))
    out = np.full(bounds[-1], v.end, np.int32)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[1:] - 1] = False
    out[inner] = flat
    return out, bounds


def unknown_words(words: pa.DictionaryArray, flat: np.ndarray, bounds: np.ndarray, unknown: int) -> list[Counter]:
    """Per text, the tokens that have the unknown id, with their times."""
    at = np.flatnonzero(flat == unknown)
    row = np.searchsorted(bounds, at, "right") - 1
    ends = at == bounds[row + 1] - 1  # so only where the end itself is unknown
    names = words.dictionary.cast(pa.large_binary()).take(pa.array(words.indices.to_numpy()[(at - row)[~ends]])).to_pylist()
    out: list[Counter] = [Counter() for _ in range(len(bounds) - 1)]
    for r, name in zip(row[~ends].tolist(), names):
        out[r][name] += 1
    for r in row[ends].tolist():
        out[r][END] += 1
    return out


_tables: dict = {}


def lookup(ids) -> dict[bytes, int]:
    """This worker's table of the broadcast words."""
    if _tables.get("key") != ids.id:
        _tables.clear()
        words = ids.value.split(b"\n") if ids.value else []
        _tables["table"] = {w: i for i, w in enumerate(words)}
        _tables["key"] = ids.id
    return _tables["table"]


class Shared:
    """A broadcast value with a name of its own, for the workers' caches."""

    def __init__(self, spark, value):
        import uuid

        self.held, self.id = spark.sparkContext.broadcast(value), uuid.uuid4().hex

    @property
    def value(self):
        return self.held.value


def log_likelihoods(w, v: Vocabulary, texts: list[np.ndarray], trust: float) -> np.ndarray:
    """log10 chance of each text; of tokens outside the head without the factor count + 0.1.

    Texts run side by side, longest first, so that those still running are always the first ones; LANES at a time."""
    out = np.zeros(len(texts))
    table = w["emb"] @ w["wx"] + w["b"]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    share = 1 / np.where(np.arange(v.classes) < v.heads, 1, np.maximum(v.mass, 1e-9))
    base = np.ones(len(v.counts) + 1)
    base[: v.head] = v.counts[: v.head] + 0.1
    base *= (1 - trust) / v.norm
    for first in range(0, len(order), LANES):
        lanes = order[first : first + LANES]
        lengths = np.array([len(texts[i]) for i in lanes])
        flat = np.concatenate([texts[i] for i in lanes])
        start = np.cumsum(lengths) - lengths
        h = np.zeros((len(lanes), HIDDEN), np.float32)
        prev = np.full(len(lanes), min(v.end, v.inputs))
        t, n = 0, len(lanes)
        while n := int(np.searchsorted(-lengths, -t, "left")):
            steps = min(WINDOW, int(lengths[n - 1]) - t)
            y = flat[(start[:n] + t)[None, :] + np.arange(steps)[:, None]]
            x = np.vstack([prev[:n][None], np.minimum(y[:-1], v.inputs)])
            states, _ = run_states(w, table[x], h[:n])
            h[:n] = states[-1]
            prev[:n] = np.minimum(y[-1], v.inputs)
            z = y.ravel()
            parts, _ = class_parts(w, v, states.reshape(-1, HIDDEN), z)
            value = trust * np.exp(parts.astype(np.float64)) * share[v.of[z]] + base[z]
            out[lanes[:n]] += np.log10(value).reshape(y.shape).sum(axis=0)
            t += steps
    return out


def score(docs: DataFrame, train_docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: int = 300_000, head: int = 2048, inputs: int = 8192, trust: float = 0.9, rounds: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs, learning from train_docs."""
    spark = docs.sparkSession
    lessons = train_docs.select(F.col(text).alias("text"))
    counts = materialize(count_words(lessons), "counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = frequent(counts, known)
    words = top.column("word").to_pylist()
    v = Vocabulary(top.column("n").to_numpy().astype(np.int64), sums.n, sums.v, head, inputs)
    v.end = words.index(END) if END in words else len(words)
    ids = Shared(spark, b"\n".join(words))
    del top, words
    w = train(lessons, v, ids, rounds)
    model = Shared(spark, pack_weights(w))
    shape = {k: np.empty(x.shape, np.bool_) for k, x in w.items()}
    held = Shared(spark, v)

    def run(batches):
        table, vocab = lookup(ids), held.value
        weights = unpack_weights(model.value, shape)
        log_count = np.append(np.log10(vocab.counts + 0.1), 0)
        log_base = np.append(vocab.base, 0)
        beyond = np.arange(len(vocab.counts) + 1) >= vocab.head
        for batch in batches:
            texts, tails, base, known = [], [], [], []
            for words, edges in split_groups(batch.column(2)):
                flat, bounds = with_ends(table, vocab, words, edges)
                starts = bounds[:-1]  # each text has its end at least
                texts += np.split(flat, bounds[1:-1])
                base.append(np.add.reduceat(log_base[flat], starts))
                known.append(np.add.reduceat((flat < len(vocab.counts)).astype(np.int64), starts))
                tails += unknown_words(words, flat, bounds, len(vocab.counts))
            like = log_likelihoods(weights, vocab, texts, trust) + np.array([(log_count[t] * beyond[t]).sum() for t in texts])
            none = [np.zeros(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.concatenate(known or none).astype(np.int64)), pa.array(np.concatenate(base or none)), pa.array(like), pa.array([list(t) for t in tails], pa.list_(pa.binary())), pa.array([list(t.values()) for t in tails], pa.list_(pa.int64()))],
                ["_row", "doc_id", "n_tokens", "n_head", "base_head", "like", "words", "times"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = materialize(numbered.mapInArrow(run, "_row long, doc_id long, n_tokens long, n_head long, base_head double, like double, words array<binary>, times array<long>"), "scored")
    tail = scored.select("_row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("_row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    tail = tail.join(counts, "word", "left").select("_row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    tail = tail.groupBy("_row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 0.1)).alias("tail"), F.sum("times").alias("n_tail"))
    whole = scored.drop("words", "times").join(tail, "_row", "left").fillna(0, ["more", "tail", "n_tail"])
    below = float(np.log10(v.norm))
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_head") + F.col("more")).alias("n_known"), F.lit(sums.n).cast("long").alias("train_tokens"),
        (F.col("base_head") + F.col("tail") - F.col("n_tail") * below).alias("base_score"), (F.col("like") + F.col("tail")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 10) == 0
    found = score(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
