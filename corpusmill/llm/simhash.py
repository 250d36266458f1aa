"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint bit is the majority over the XXH64 hashes (seed 42) of a text's word shingles. Equal
fingerprints are one class from the start. Classes whose fingerprints differ in at most ``radius`` bits are
linked: the 64 bits are cut into six blocks, and two fingerprints that differ in four bits share two whole
blocks at least, so each of the 15 pairs of blocks is a key that candidates meet under. Within a key,
64 fingerprints stand upright in one machine word per bit plane; distances of a query to all 64 are added
up plane by plane in carry-save counters, and a word is given up once all its lanes are beyond the radius.

A key with more than ``block`` fingerprints is split by hash, and every two parts meet in a task of their own.
Of the pairs found in a key only a spanning forest is written, which loses no connection; connected
components run as rounds of joins with a written table after each.

``keep_one``, the pipeline's stage, has to find all pairs of Jaccard similarity 0.8, at which fingerprints differ in some ten bits.
Blocks of bits cannot be keys at that radius, and bands of min-hashes lose pairs, so the first shingles of each set in one order
are; under a key, bits that say how many shingles differ at least pick the pairs, and the shingle sets decide on each.

Edge cases: null text has no words and fingerprint zero, as an empty text has; all rows with fingerprint zero
are linked. Null ids keep their rows; a component's id is its smallest non-null id (null if it has none).
Repeated ids keep their rows, each by its own text. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from corpusmill.functions.storage import components
from corpusmill.llm.common import LOWER, discard, flag_table, gram_hashes, materialize, mix, read, spans, utf8, word_bounds, word_hashes

CUTS = [0, 11, 22, 33, 44, 54, 64]
SLICE = 1 << 15
GROUP_BYTES = 16 << 20  # of shingle sets that one part of a group's classes holds
SAMPLE, COMMON, ORDERED = 4096, 3, 1 << 16  # texts that tell common shingles, in how many of them these are, and how many of these are known
BLANK = flag_table(b" \t\n\r\x0b\x0c").astype(bool)


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.array(list(map(xxh64_intdigest, grams, repeat(seed))), "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, text: str, shingle: int, name: str) -> DataFrame:
    """docs with a long column of fingerprints at its end."""
    at = docs.columns.index(text)

    def add(batches):
        for batch in batches:
            prints = [signed(fingerprint(t, shingle)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(name, LongType())]))


def near_lanes(prints: np.ndarray, group: np.ndarray, radius: int):
    """Row pairs (i, j) of equal group within the radius, in slices of bounded size; group is sorted."""
    n = len(prints)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(first, n))
    lane = np.arange(n) - np.repeat(first, sizes)
    words = -(-sizes // 64)
    base = np.cumsum(words) - words
    word = np.repeat(base, sizes) + lane // 64
    lane = (lane % 64).astype(np.uint64)
    head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    planes = np.empty((64, len(head)), np.uint64)
    for b in range(64):
        planes[b] = np.add.reduceat(((prints >> np.uint64(b)) & np.uint64(1)) << lane, head)
    full = np.add.reduceat(np.uint64(1) << lane, head)
    last = np.repeat(base + words, sizes)
    todo = last - word  # each row meets its own word and those behind it in its group
    todo[np.repeat(sizes == 1, sizes)] = 0
    ends = np.cumsum(todo)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, "right")))
        q = np.repeat(np.arange(i, j), todo[i:j])
        if len(q):
            w = word[q] + np.arange(len(q)) - np.repeat(np.cumsum(todo[i:j]) - todo[i:j], todo[i:j])
            lanes = full[w]
            own = w == word[q]
            behind = ~((np.uint64(2) << lane[q]) - np.uint64(1))
            lanes = np.where(own, lanes & behind, lanes)
            yield from _within(prints, planes, head, q, w, lanes, radius)
        i = j


def _within(prints, planes, head, q, w, lanes, radius):
    counters = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(q), np.uint64)
    for b in range(64):
        carry = planes[b, w] ^ (np.uint64(0) - ((prints[q] >> np.uint64(b)) & np.uint64(1)))
        for c in counters:
            carry, c[:] = c & carry, c ^ carry
        over |= carry
        if b % 8 == 7:
            beyond = over | _above(counters, radius)
            alive = (lanes & ~beyond) != 0
            if not alive.all():
                q, w, lanes, over = q[alive], w[alive], lanes[alive], over[alive]
                counters = [c[alive] for c in counters]
            if not len(q):
                return
    left = lanes & ~(over | _above(counters, radius))
    bits = np.unpackbits(left.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    yield q[at], head[w[at]] + bit


def _above(counters, radius):
    """Lanes whose count is over the radius, by comparing bit by bit from the top."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link per row that keep together what the links (a, b) hold together."""
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(rows))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(rows))
    return rows[moved], rows[label[moved]]


def block_keys(fp: str) -> F.Column:
    """The 15 keys of a fingerprint: which two blocks, and their bits."""
    part = [F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(CUTS, CUTS[1:])]
    return F.array(*[F.lit(t << 22).cast("long") + part[i] * 2048 + part[j] for t, (i, j) in enumerate(combinations(range(6), 2))])


def whole_groups(batches, names: tuple):
    """Tables of whole groups of the named columns, from batches sorted by them."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not len(held):
            continue
        cols = [held.column(c).to_numpy() for c in names]
        same = np.logical_and.reduce([c == c[-1] for c in cols])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and len(held):
        yield held.combine_chunks()


def links(prints: DataFrame, radius: int = 4, block: int = 2048) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect all pairs within the radius."""
    if radius > 4:
        raise ValueError("six blocks hold up to four differing bits")
    keyed = prints.select("fp", F.explode(block_keys("fp")).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    met = keyed.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")

    def compare(batches):
        def found(table):
            prints = table.column("fp").to_numpy().view(np.uint64)
            cols = [table.column(c).to_numpy() for c in ("key", "lo", "hi")]
            new = np.zeros(len(prints), bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            for a, b in near_lanes(prints, np.cumsum(new), radius):
                a, b = forest(a, b)
                signs = prints.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signs[a]), pa.array(signs[b])], ["a", "b"])

        for table in whole_groups(batches, ("key", "lo", "hi")):
            yield from found(table)

    dealt = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def classes(prints: DataFrame, radius: int, block: int = 2048) -> DataFrame:
    """fp, root of the distinct fingerprints in prints (a materialized table with column fp)."""
    roots = components(links(prints.select("fp").distinct(), radius, block))
    return prints.select("fp").distinct().join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, block: int = 2048) -> DataFrame:
    """doc_id, fp (signed long), component_id of every row."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(with_fingerprints(chosen, "text", shingle, "fp").select("doc_id", "fp"), "prints")
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = classes(least, radius, block)
    named = least.join(roots, "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def gram_sets(column: pa.Array, shingle: int):
    """The sorted distinct hashes of each row's word shingles; a text of fewer words is one shingle, one without words has none."""
    data, offsets = utf8(column)
    for i, j in spans(offsets):
        part, edges = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends = word_bounds(~BLANK[part], edges)
        words = word_hashes(part, starts, ends)
        rows = np.searchsorted(starts, edges)
        for a, b in zip(rows, rows[1:]):
            yield np.unique(gram_hashes(words[a:b], min(shingle, b - a))) if b > a else words[:0]


def common_grams(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of some SAMPLE texts share, sorted, and in how many. Only the order of the others' keys goes by them, so results do not."""
    every = max(1, -(-texts.count() // SAMPLE))

    def add(batches):
        for batch in batches:
            for grams in gram_sets(batch.column(1), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    some = texts.where(F.pmod(F.xxhash64("_row"), F.lit(every)) == 0).select("_row", "text").mapInArrow(add, "gram long")
    rows = some.groupBy("gram").agg(F.count("*").alias("n")).where(f"n >= {COMMON}").orderBy(F.desc("n"), "gram").limit(ORDERED).collect()
    rows.sort(key=lambda r: r.gram % (1 << 64))
    return np.array([r.gram for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)


def least_shared(n, similarity: float):
    """How many of its n elements a set shares at least with any other one that has the similarity."""
    return np.ceil(np.asarray(n) * similarity - 1e-9).astype(np.int64)


def prefix(grams: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first elements of a set in one order of all (rare ones first, then by hash): so many that any set of the similarity has one of them among its own first ones."""
    n = len(grams)
    keys, many = mix(grams), n - int(least_shared(n, similarity)) + 1
    if many >= n:
        return keys
    known, counts = common
    at = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
    weight = np.where(known[at] == grams, counts[at], 0) if len(known) else np.zeros(n, np.int64)
    return keys[np.lexsort((keys, weight))[:many]] if weight.any() else np.partition(keys, many - 1)[:many]


def parities(grams: np.ndarray) -> bytes:
    """Whether an odd number of a set's elements falls on each of at least twice as many places. Two sets differ in at least as many elements as their parities do
    in places, at any number of places, and half as many places come from the two halves of these."""
    places = 1 << min(max(6, (2 * len(grams) - 1).bit_length()), 15)
    odd = np.bincount((grams >> np.uint64(16) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


SETS = "_row long, doc_id long, cls long, size int, odd binary, keys array<long>"


def with_sets(docs: DataFrame, shingle: int, similarity: float, common) -> DataFrame:
    """_row, doc_id, cls (equal for equal shingle sets), size, odd (parities), keys (prefix) of docs (_row, doc_id, text); common is a broadcast of common_grams()."""

    def add(batches):
        for batch in batches:
            cls, sizes, odd, keys = [], [], [], []
            for grams in gram_sets(batch.column(2), shingle):
                cls.append(signed(xxh64_intdigest(grams.tobytes())))
                sizes.append(len(grams))
                odd.append(parities(grams))
                keys.append(prefix(grams, similarity, common.value).view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(cls, pa.int64()), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "doc_id", "cls", "size", "odd", "keys"])

    return docs.select("_row", "doc_id", "text").mapInArrow(add, SETS)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """key, cls, n of the keys that n > 1 classes have, each class once, from keyed (key, cls), which may hold a pair several times."""

    def count(batches):
        for table in whole_groups(batches, ("key",)):
            key, cls = (table.column(c).to_numpy() for c in ("key", "cls"))
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls = key[once], cls[once]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
            yield pa.RecordBatch.from_arrays([pa.array(x[n > 1]) for x in (key, cls, n)], ["key", "cls", "n"])

    return keyed.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(count, "key long, cls long, n long")


def dealt_texts(pairs: DataFrame, texts: DataFrame, side: str, other: str, block: int) -> DataFrame:
    """pairs with the text of one side; a class in many pairs is dealt over parts, each with a copy of its text."""
    parts = pairs.groupBy(side).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    held = texts.withColumnRenamed("cls", side).join(parts.hint("merge"), side).select(side, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias(f"text_{side}"))
    dealt = pairs.join(parts, side).withColumn("part", F.pmod(F.xxhash64(other), F.col("parts")).cast("int")).drop("parts")
    return dealt.join(held.hint("merge"), [side, "part"]).drop("part")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, block: int = 256) -> DataFrame:
    """Those of the pairs (a, b) of classes whose shingle sets have the Jaccard similarity at least."""

    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(gram_sets(batch.column(2), shingle), gram_sets(batch.column(3), shingle)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = dealt_texts(pairs, texts, "a", "b", block)
    return dealt_texts(one, texts, "b", "a", block).select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def folded(odd: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By numbers of bytes, largest first: rows with parities of so many or more, and theirs folded to so many, as words."""
    sizes, out, rows, words = np.array([len(x) for x in odd]), {}, np.zeros(0, np.int64), np.zeros((0, 0), np.uint64)
    size = int(sizes.max(initial=0))
    while size >= 8:
        if len(rows):
            half = words.shape[1] // 2
            words = words[:, :half] ^ words[:, half:]
        new = np.flatnonzero(sizes == size)
        own = np.frombuffer(b"".join(odd[i] for i in new.tolist()), "<u8").reshape(len(new), size // 8)
        rows, words = np.concatenate([rows, new]), np.concatenate([words.reshape(len(rows), size // 8), own])
        out[size] = rows, words
        size //= 2
    return out


def near_sets(odd: list[bytes], size: np.ndarray, group: np.ndarray, similarity: float, wanted=None):
    """Row pairs (i, j) of equal group (sorted) whose sets may have the similarity, in slices of bounded size; of the pairs wanted(i, j) alone, if given.

    None that has it is left out: the smaller set is not too small, and parities differ in no more places than such sets differ in elements."""
    n = len(size)
    if n < 2:
        return
    own = np.array([len(x) for x in odd])
    places = {}
    for k, (rows, words) in folded(odd).items():
        at = np.zeros(n, np.int64)
        at[rows] = np.arange(len(rows))
        places[k] = at, words
    last = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n)
    end = last[np.searchsorted(last, np.arange(n), "right")]
    size = size.astype(np.int64)
    i, d = np.arange(n), 1
    while len(i := i[i + d < end[i]]):
        j = i + d
        near = np.minimum(size[i], size[j]) >= least_shared(np.maximum(size[i], size[j]), similarity)
        if wanted is not None:
            near[near] = wanted(i[near], j[near])
        a, b = i[near], j[near]
        k = np.minimum(own[a], own[b])
        for width in np.unique(k).tolist():
            at, words = places[width]
            rows = np.flatnonzero(k == width)
            for s in range(0, len(rows), step := max(1, SLICE * 8 // width)):
                x, y = a[rows[s : s + step]], b[rows[s : s + step]]
                differ = np.bitwise_count(words[at[x]] ^ words[at[y]]).sum(axis=1, dtype=np.int64)
                found = differ <= (1 - similarity) / (1 + similarity) * (size[x] + size[y]) + 1e-6
                if found.any():
                    yield x[found], y[found]
        d += 1


def candidates(dealt: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs of classes that may be similar, from dealt (key, lo, hi, own, cls, size, odd): a spanning forest of all such pairs that meet under a key."""

    def found(table):
        cls, size, own, lo, hi = (table.column(c).to_numpy() for c in ("cls", "size", "own", "lo", "hi"))
        group = group_numbers(table, ("key", "lo", "hi"))
        pairs = [*near_sets(table.column("odd").to_pylist(), size, group, similarity, lambda i, j: (lo[i] == hi[i]) | (own[i] != own[j]))]
        if pairs:
            a, b = forest(*(np.concatenate(x) for x in zip(*pairs)))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[a], cls[b])), pa.array(np.maximum(cls[a], cls[b]))], ["a", "b"])

    def compare(batches):
        for table in whole_groups(batches, ("key", "lo", "hi")):
            yield from found(table)

    spread = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return spread.mapInArrow(compare, "a long, b long").distinct()


def group_numbers(table: pa.Table, names: tuple) -> np.ndarray:
    """A number for each row of a sorted table, equal for rows with equal values in the named columns."""
    new = np.zeros(len(table), bool)
    for c in (table.column(c).to_numpy() for c in names):
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def in_parts(rows: DataFrame, key: str) -> DataFrame:
    """rows (with key and parts) with lo, hi, own in place of parts: every two parts of a key's rows meet once."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    return dealt.select(F.col(key).alias("key"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", *[c for c in rows.columns if c not in (key, "parts")])


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted arrays) have the Jaccard similarity at least."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def with_grams(texts: DataFrame, shingle: int) -> DataFrame:
    """cls, grams (sorted hashes of the shingles) of texts (cls, text)."""

    def add(batches):
        for batch in batches:
            cls, rows, held = batch.column(0).to_pylist(), [], 0
            for k, grams in enumerate(gram_sets(batch.column(1), shingle)):
                rows.append((cls[k], grams.view(np.int64)))
                held += grams.nbytes
                if held >= GROUP_BYTES:
                    yield _gram_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _gram_batch(rows)

    return texts.select("cls", "text").mapInArrow(add, "cls long, grams array<long>")


def _gram_batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([g for _, g in rows], pa.list_(pa.int64()))], ["cls", "grams"])


def links_apart(dealt: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between classes of different roots, from dealt (key, lo, hi, own, cls, root, size, odd, grams).

    Sizes and parities have to allow a pair, and then the sets themselves decide. Pairs that links found in the task connect already are left out, so no
    more links are given than there are rows, and no pair ever leaves its task."""

    def found(table):
        cls, root, size, own, lo, hi = (table.column(c).to_numpy() for c in ("cls", "root", "size", "own", "lo", "hi"))
        grams = table.column("grams").combine_chunks() if isinstance(table.column("grams"), pa.ChunkedArray) else table.column("grams")
        ends, values = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
        names, at = np.unique(root, return_inverse=True)
        parent = list(range(len(names)))

        def top(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def wanted(i, j):
            return (root[i] != root[j]) & ((lo[i] == hi[i]) | (own[i] != own[j]))

        out = []
        for a, b in near_sets(table.column("odd").to_pylist(), size, group_numbers(table, ("key", "lo", "hi")), similarity, wanted):
            for i, j in zip(a.tolist(), b.tolist()):
                x, y = top(int(at[i])), top(int(at[j]))
                if x != y and similar(values[ends[i] : ends[i + 1]], values[ends[j] : ends[j + 1]], similarity):
                    parent[x] = y
                    out.append((cls[i], cls[j]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    def compare(batches):
        for table in whole_groups(batches, ("key", "lo", "hi")):
            yield from found(table)

    spread = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return spread.mapInArrow(compare, "a long, b long")


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Tables of materialize() that have one schema, as one scan, so that plans do not grow with the rounds."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._shared_path for t in tables])


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = 1024) -> DataFrame:
    """One row of each near-duplicate group (smallest id, then first by place), all columns as they are.

    Near-duplicates have Jaccard similarity ``similarity`` at least between their sets of word shingles, and every such pair counts. Two
    sets that are so similar share one of their first elements, in one order of all, so each of those is a key. Under a key, sizes and parities tell the pairs that may
    be similar; of these a spanning forest is confirmed by the sets. Classes that the forests hold together but that are not all confirmed
    then meet with their sets, in parts of bounded size, and all pairs of them that are not connected yet are tried, each once. No link goes
    unconfirmed, none is left out, and what is written grows with the classes, not with their pairs."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # so that the numbers hold
    chosen = numbered.select(F.col(row).alias("_row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_grams(chosen, shingle))
    prints = materialize(with_sets(chosen, shingle, similarity, common), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least")
    least = materialize(prints.groupBy("cls").agg(first).select("cls", "least.*"), "classes")
    met = materialize(shared_keys(prints.select(F.explode("keys").alias("key"), "cls")), "met")
    sets = prints.join(least.select("_row"), "_row", "left_semi").select("cls", "size", "odd")
    sets = materialize(sets.join(met.select("cls").distinct(), "cls", "left_semi"), "sets")
    discard(prints)
    common.unpersist()
    dealt = in_parts(met.select("key", "cls", F.ceil(F.col("n") / block).cast("int").alias("parts")), "key").join(sets, "cls")
    maybe = materialize(candidates(dealt, similarity), "maybe")
    discard(met)
    groups = materialize(components(maybe), "groups")
    held = groups.select(F.col("node").alias("cls"), F.col("root").alias("held"))
    named = least.join(held, "cls").select("cls", "_row")
    # joins that carry texts are merge joins at every size, so their cost grows with the texts alone
    texts = materialize(chosen.join(named.hint("merge"), "_row").select("cls", "text"), "texts")
    links = [materialize(confirmed(maybe, texts, shingle, similarity), "links")]
    roots = materialize(components(links[0]), "roots")
    rooted = held.join(roots, F.col("cls") == F.col("node"), "left").select("held", "cls", F.coalesce("root", "cls").alias("root")).join(sets, "cls")
    parts = F.ceil(F.greatest(F.count("*") / block, F.sum("size") * 8 / GROUP_BYTES)).cast("int").alias("parts")
    apart = rooted.groupBy("held").agg(F.min("root").alias("x"), F.max("root").alias("y"), parts).where("x <> y").select("held", "parts")
    rows = materialize(in_parts(rooted.join(apart, "held"), "held"), "apart")
    grams = with_grams(texts.join(rows.select("cls").distinct(), "cls", "left_semi"), shingle)
    links.append(materialize(links_apart(rows.join(grams.hint("merge"), "cls"), similarity), "links"))
    before, roots = roots, materialize(components(union_all(links)), "roots")
    rooted = least.join(roots, F.col("cls") == F.col("node"), "left").select(F.coalesce("root", "cls").alias("root"), F.struct("none", "doc_id", "_row").alias("least"))
    kept = materialize(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least._row").alias(row)), "kept")
    for table in (least, sets, maybe, groups, texts, before, roots, rows, *links):
        discard(table)
    out = numbered.join(kept.hint("merge"), row, "left_semi").drop(row)
    out._shared_tables = [numbered, kept]  # to be discarded once the result is written
    return out


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
