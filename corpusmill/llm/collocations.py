"""Collocations of two to four words by best-first branch-and-bound growth.

Per language, phrases grow word by word from their prefixes. A phrase occurs no more often than its parts, and its score is at most that of its cut after
the first word when what follows is as rare as the phrase, so a prefix p bounds all that grows from it:
``2000000 f(p) / (f(first word of p) + f(p))``. Prefixes are expanded best bound first, a batch of all those down to a limit in one
pass over the texts; the limit starts at the score that ``ahead`` times the wanted number of candidates reach and is lowered for the languages
where fewer than that number of candidates, ties included, are found to survive at or above it. Where they are found, nothing that was not
expanded can change the first rows, and the language is settled.

A candidate is dropped for a longer one that holds it and is nearly as frequent. As a phrase is no rarer than a longer one around it, it is
enough to look one word to the left and to the right, so the passes also count what ends with a candidate at or above the limit.

Words travel as 64-bit hashes of (language, word); the table of words shows whether two share one, in which case other hashes are
taken. Phrases are tuples of these, so their counts are exact. Sets of phrases reach the tasks as bit maps of at most ``2 ** max_bits`` bits: a phrase that hits by
chance is counted as well, and wholly, so the maps bound memory and change no result. Tasks count before they shuffle.

Edge cases: null text has no words; null language is ``und``. Rows count each by themselves, repeated ones too. Empty tables give
empty results; other columns are ignored. A text of any length is read in parts of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpusmill.functions.storage import cut, discard
from corpusmill.llm.common import LOWER, flag_table, gram_hashes, mix, read, spans, utf8, word_bounds, words_in_parts

APART = flag_table(b".,;:!?\n\x0b\x0c\r").astype(bool)
NO_WORD = APART | flag_table(b" \t").astype(bool)
SCALE = 2_000_000
HELD = 1 << 21  # phrases that a task holds before it counts them


def words_of(langs: list[str], column: pa.Array, seed: int):
    """For spans of rows: hashes of their words with their language, the piece that each lies in, bytes, starts and ends, and rows."""
    salts = {x: np.uint64(xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed)) for x in set(langs)}
    data, offsets = utf8(column)
    for i, j in spans(offsets):
        edges = offsets[i : j + 1] - offsets[i]
        part = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends = word_bounds(~NO_WORD[part], edges)
        if not len(starts):
            continue
        row = np.searchsorted(edges, starts, "right") - 1
        words = mix(words_in_parts(part, starts, ends) ^ np.array([salts[x] for x in langs[i:j]], np.uint64)[row])
        at = np.flatnonzero(APART[part])
        yield words, np.searchsorted(at, starts) + row, part, starts, ends, i + row


def counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns and how often each is there; a row may come in several parts."""
    h = columns[0]
    for c in columns[1:]:
        h = mix(h * np.uint64(0xBF58476D1CE4E5B9) + c)
    order = np.argsort(h)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, id, n of docs (lang, text)."""

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for words, _, part, starts, ends, row in words_of(langs, batch.column(1), seed):
                ids, first, n = np.unique(words, return_index=True, return_counts=True)
                # of two words that share a hash in this span the first is listed; the other is as soon as it is first in another span
                text = [part[starts[k] : ends[k]].tobytes().decode("utf-8", "surrogatepass") for k in first]
                yield pa.RecordBatch.from_arrays([pa.array([langs[row[k]] for k in first], pa.string()), pa.array(text, pa.string()), pa.array(ids.view(np.int64)), pa.array(n)], ["lang", "word", "id", "n"])

    return docs.mapInArrow(count, "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


class Members:
    """A set of phrases as a bit map in a broadcast: no member is missed, others may hit by chance."""

    def __init__(self, phrases: DataFrame, max_bits: int):
        n = phrases.count()
        self.bits = min(max_bits, max(15, (64 * n).bit_length()))
        width, bits = len(phrases.columns), self.bits

        def places(batches):
            for batch in batches:
                at = _place([c.to_numpy().view(np.uint64) for c in batch.columns[:width]], bits)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + 1)], ["at"])

        at = phrases.mapInArrow(places, "at long")
        maps = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        table = np.zeros(1 << (bits - 3), np.uint8)
        for row in maps.collect():  # of bounded size: the buckets of one map
            table[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
        self.table = phrases.sparkSession.sparkContext.broadcast(table)

    def __getstate__(self):
        return {"bits": self.bits, "table": self.table}

    def hold(self, columns: list[np.ndarray]) -> np.ndarray:
        at = _place(columns, self.bits)
        return (self.table.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def drop(self):
        self.table.destroy()


def _place(columns: list[np.ndarray], bits: int) -> np.ndarray:
    h = columns[0]
    for c in columns[1:]:
        h = h * np.uint64(0xBF58476D1CE4E5B9) + c
    return mix(h) >> np.uint64(64 - bits)


def phrase_counts(docs: DataFrame, size: int, least: int, seed: int, words: Members, pairs: Members | None = None, heads: Members | None = None, tails: Members | None = None, whole: Members | None = None) -> DataFrame:
    """w1, ..., n of the phrases of so many words of docs (lang, text) with n >= least, all of whose words and pairs are members, which are in
    whole themselves, and which have all but the last word in heads or all but the first in tails (each where it is given)."""
    names = [f"w{k + 1}" for k in range(size)]

    def count(batches):
        held, rows = [], 0

        def batch_of():
            columns, n = counted([np.concatenate(c) for c in zip(*held)])
            return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(n)], [*names, "n"])

        for batch in batches:
            for ids, piece, *_ in words_of(batch.column(0).to_pylist(), batch.column(1), seed):
                n = len(ids) - size + 1
                if n < 1:
                    continue
                known = words.hold([ids])
                ok = piece[:n] == piece[size - 1 :]
                for k in range(size):
                    ok &= known[k : k + n]
                if pairs is not None:
                    at = np.flatnonzero(known[:-1] & known[1:] & (piece[:-1] == piece[1:]))
                    both = np.zeros(len(ids) - 1, bool)
                    both[at[pairs.hold([ids[at], ids[at + 1]])]] = True
                    for k in range(size - 1):
                        ok &= both[k : k + n]
                at = np.flatnonzero(ok)
                if heads is not None and len(at):
                    inside = [ids[at + k] for k in range(size)]
                    at = at[heads.hold(inside[:-1]) | tails.hold(inside[1:])]
                if whole is not None and len(at):
                    at = at[whole.hold([ids[at + k] for k in range(size)])]
                if len(at):
                    held.append([ids[at + k] for k in range(size)])
                    rows += len(at)
                if rows > HELD:
                    yield batch_of()
                    held, rows = [], 0
        if held:
            yield batch_of()

    parts = docs.mapInArrow(count, ", ".join(f"{n} long" for n in names) + ", n long")
    return parts.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def ratio(a: Column, below: Column) -> Column:
    """floor(SCALE * a / below), exact beyond 64 bits."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), below.cast("decimal(20,0)"))


def part(table: DataFrame, names: list[str], name: str) -> DataFrame:
    """Counts of shorter phrases as a column of the given name, by the words that they have in a longer one."""
    own = [c for c in ("w1", "w2", "w3") if c in table.columns] or ["id"]
    return table.select(*(F.col(c).alias(n) for c, n in zip(own, names)), F.col("n").alias(name))


def with_score(phrases: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """phrases with l, r, score of the cut that scores lowest, the first of equals, and bound."""
    ways = [F.struct(ratio(F.col("n"), F.col(a) + F.col(b)).alias("score"), F.lit(k).alias("k"), F.col(a).alias("l"), F.col(b).alias("r")) for k, (a, b) in enumerate(cuts)]
    lowest = F.least(*ways) if len(ways) > 1 else ways[0]
    out = phrases.withColumn("lowest", lowest).withColumn("bound", ratio(F.col("n"), F.col(cuts[0][0]) + F.col("n")))
    return out.select("*", "lowest.score", "lowest.l", "lowest.r").drop("lowest", *{c for pair in cuts for c in pair})


def limits_of(candidates: DataFrame, most: int) -> DataFrame:
    """lang, limit: the score that so many candidates (lang, score) of a language reach, 0 where there are fewer. From a histogram."""
    scores = candidates.groupBy("lang", "score").agg(F.count("*").alias("c"))
    reached = scores.withColumn("c", F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("score"))))
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("c") >= most, F.col("score"))), F.lit(0).cast("long")).alias("limit"))


def survivors(shorter: DataFrame, longer: DataFrame, nearly: int) -> DataFrame:
    """The phrases of shorter that no phrase of longer, of one word more, holds and is nearly as frequent as."""
    names = [c for c in ("w1", "w2", "w3") if c in shorter.columns]
    ends = [longer.select(*(F.col(f"w{int(c[1]) + k}").alias(c) for c in names), F.col("n").alias("around")) for k in (0, 1)]
    around = ends[0].unionByName(ends[1]).groupBy(*names).agg(F.max("around").alias("around"))
    out = shorter.join(around, names, "left")
    return out.where(F.col("around").isNull() | (F.col("around") * 100 < F.col("n") * nearly)).drop("around")


FOUND = ["lang", "w1", "w2", "w3", "w4", "n", "l", "r", "score"]


def uniform(phrases: DataFrame) -> DataFrame:
    return phrases.select(*(F.col(c) if c in phrases.columns else F.lit(None).cast("long").alias(c) for c in FOUND))


def expanded(docs: DataFrame, limits: DataFrame, known: DataFrame, pairs: DataFrame, words: Members, both: Members, least: int, nearly: int, seed: int, max_bits: int, tables: list) -> DataFrame:
    """The surviving candidates that score limits (lang, limit) or more: all prefixes with such a bound are grown, word by word."""

    def kept(df):
        tables.append(cut(df))
        return tables[-1]

    def grown(table, size):
        names = [f"w{k + 1}" for k in range(size - 1)]
        open_ = table.join(limits, "lang")
        heads = Members(open_.where("bound >= limit").select(*names), max_bits)
        tails = Members(open_.where("score >= limit").select(*names), max_bits)
        out = kept(phrase_counts(docs, size, least, seed, words, both, heads, tails))
        heads.drop()
        tails.drop()
        return out

    word = part(known, ["w1"], "f1").join(known.select(F.col("id").alias("w1"), "lang"), "w1")
    threes = grown(pairs, 3)
    threes = threes.join(word, "w1").join(part(pairs, ["w1", "w2"], "f12"), ["w1", "w2"]).join(part(pairs, ["w2", "w3"], "f23"), ["w2", "w3"]).join(part(known, ["w3"], "f3"), "w3")
    threes = kept(with_score(threes, [("f1", "f23"), ("f12", "f3")]))
    fours = grown(threes, 4)
    grown4 = fours.join(part(threes, ["w1", "w2", "w3"], "f123"), ["w1", "w2", "w3"]).join(word, "w1").join(limits, "lang")
    grown4 = grown4.join(part(pairs, ["w1", "w2"], "f12"), ["w1", "w2"]).join(part(pairs, ["w3", "w4"], "f34"), ["w3", "w4"]).join(part(known, ["w4"], "f4"), "w4")
    for a, b in (("f1", "n"), ("f12", "f34"), ("f123", "f4")):
        grown4 = grown4.where(ratio(F.col("n"), F.col(a) + F.col(b)) >= F.col("limit"))
    grown4 = kept(grown4.drop("limit"))
    last = part(threes, ["w2", "w3", "w4"], "f234")
    wanted = kept(grown4.select("w2", "w3", "w4").distinct().join(last, ["w2", "w3", "w4"], "left_anti"))
    if not wanted.isEmpty():  # their last three words grow from a prefix below the limit
        whole = Members(wanted, max_bits)
        more = kept(phrase_counts(docs, 3, least, seed, words, both, whole=whole))
        whole.drop()
        last = last.unionByName(part(more, ["w2", "w3", "w4"], "f234").join(wanted, ["w2", "w3", "w4"], "left_semi"))
    scored4 = with_score(grown4.join(last, ["w2", "w3", "w4"]), [("f1", "f234"), ("f12", "f34"), ("f123", "f4")])
    out = [survivors(pairs.join(limits, "lang").where("score >= limit"), threes, nearly), survivors(threes.join(limits, "lang").where("score >= limit"), fours, nearly), scored4.join(limits, "lang").where("score >= limit")]
    return kept(uniform(out[0]).unionByName(uniform(out[1])).unionByName(uniform(out[2])))


def first_rows(found: DataFrame, vocabulary: DataFrame, top: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, score of each language's first rows. Ranked in two steps, so that no task sorts a whole language."""
    found = found.join(limits_of(found, top), "lang").where("score >= limit").drop("limit")
    for k in range(1, 5):
        found = found.join(vocabulary.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}")), f"w{k}", "left")
    rows = found.select("lang", F.concat_ws(" ", "t1", "t2", "t3", "t4").alias("phrase"), F.col("n").alias("a"), "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, top: int = 2000, nearly: int = 80, ahead: int = 2, max_bits: int = 27) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    seed, tables, found = 0, [], []
    while True:
        vocabulary = cut(word_counts(docs, seed))
        if vocabulary.groupBy("id").count().where("count > 1").isEmpty():
            break
        discard(vocabulary)
        seed += 1
    tables.append(vocabulary)
    known = vocabulary.where(F.col("n") >= least)
    words = Members(known.select("id"), max_bits)
    pairs = phrase_counts(docs, 2, least, seed, words).join(part(known, ["w1"], "f1"), "w1").join(part(known, ["w2"], "f2"), "w2")
    pairs = pairs.join(known.select(F.col("id").alias("w1"), "lang"), "w1")
    pairs = cut(with_score(pairs, [("f1", "f2")]))
    both = Members(pairs.select("w1", "w2"), max_bits)
    tables.append(pairs)
    open_, most = pairs.select("lang").distinct(), ahead * top
    while True:
        limits = cut(limits_of(pairs.join(open_, "lang", "left_semi"), most))
        tables.append(limits)
        if limits.isEmpty():
            break
        done = expanded(docs.join(limits, "lang", "left_semi"), limits, known, pairs, words, both, least, nearly, seed, max_bits, tables)
        counts = done.groupBy("lang").agg(F.count("*").alias("c"))
        settled = limits.join(counts, "lang", "left").select("lang", ((F.col("limit") == 0) | (F.coalesce("c", F.lit(0)) >= top)).alias("settled"))
        settled = cut(settled)
        tables.append(settled)
        found.append(done.join(settled.where("settled"), "lang", "left_semi"))
        open_, most = settled.where("not settled").select("lang"), most * 4
    total = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = found[0] if found else uniform(pairs)
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = first_rows(rows, vocabulary, top).join(total, "lang")
    out = cut(rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"))
    words.drop()
    both.drop()
    for table in tables:
        discard(table)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?
-]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT lang, phrase, k, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT cuts.*, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * cuts.a) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head AND x.k = j JOIN f y ON y.lang = cuts.lang AND y.phrase = tail AND y.k = cuts.k - j),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, a AS around, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
held AS (SELECT lang, phrase, max(around) AS around FROM inner_ GROUP BY ALL),
left_ AS (SELECT lowest.* FROM lowest LEFT JOIN held USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_ JOIN n USING (lang) QUALIFY rank <= 2000
"""
