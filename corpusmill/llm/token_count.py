"""Token counts by a map-side two-tier lookup.

Tier 1 is a compact table of the corpus' frequent pre-tokens and their token counts, of at most ``table_size`` entries
of at most ``LONGEST`` bytes, broadcast to the workers. Tier 2 is a bounded cache in each worker, filled by the tokenizer
itself. No pre-token is shuffled: to choose tier 1, each task keeps a summary of its most frequent pre-tokens
(``per_task`` entries, one row), and the summaries are merged in a fixed fan-in; the choice affects speed, never a count.

A pre-token here is a word with the space before it, or what is left of the white space between two words. The
tokenizer's own split never joins characters over such a border, so the counts of a text's pre-tokens add up to
its own. Texts with a special token's string, or with white space beyond ASCII, go to the tokenizer whole.

Edge cases: null text counts as empty (0 bytes, 0 tokens); rows with a null or repeated id each give a row;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import flag_table, spans, utf8, word_bounds
from corpusmill.llm.word_ids import GROUP, UnitCache, byte_signs, model_ids, split_words

LONGEST = 32  # bytes of a pre-token in tier 1; tier 2 counts longer ones
BLANK = flag_table(b" \t\n\r\x0b\x0c").astype(bool)
OTHER_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_loaded: dict = {}


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    if path not in _loaded:
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _length(path: str, text: str) -> int:
    return len(_tokenizer(path).encode(text, add_special_tokens=False).ids)


def pre_tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pre-tokens of all texts, numbered, and each text's bounds among them."""
    data, offsets = utf8(texts)
    first = offsets[0]
    data, offsets = data[first : offsets[-1]], offsets - first
    starts, ends = word_bounds(~BLANK[data], offsets)
    mark = np.zeros(len(data) + 1, bool)
    mark[offsets] = True
    inner = starts[~mark[starts]]  # a blank of the same text stands before these
    mark[ends] = True
    spaced = data[inner - 1] == 32
    mark[inner - 1] = True
    mark[inner[~spaced]] = True
    edges = np.flatnonzero(mark)
    units = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return units.dictionary_encode(), np.searchsorted(edges, offsets)


class Lengths:
    """This worker's counts of pre-tokens: tier 1 stays, tier 2 is a bounded cache."""

    def __init__(self, path: str, units: list[str], counts: np.ndarray, bound: int = 300_000):
        self.path, self.cache, self.signs = path, UnitCache(bound), byte_signs()
        self.cache.add(units, counts)
        self.cache.fixed = len(units)
        vocabulary = _tokenizer(path).get_vocab()
        self.space = self.signs[32]
        self.first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.first[[i for token, i in vocabulary.items() if token.startswith(self.space)]] = True
        self.specials = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]

    def _places(self, units: pa.Array, plain: np.ndarray) -> np.ndarray:
        """Places of distinct units. plain: a space and letters, which are one pre-token to the tokenizer too."""
        names = units.to_numpy(zero_copy_only=False).tolist()
        places = self.cache.places(names)
        new = places < 0
        if (fresh := np.flatnonzero(new & plain)).size:
            words = [names[i] for i in fresh]
            ids = model_ids(_tokenizer(self.path).model, [self.space + w[1:] if w.isascii() else "".join(self.signs[b] for b in w.encode()) for w in words])
            at = np.flatnonzero(self.first[ids])
            if len(at) != len(words):
                raise ValueError("a word does not begin with its first token")
            places[fresh] = self.cache.add(words, np.diff(at, append=len(ids)))
        if (fresh := np.flatnonzero(new & ~plain)).size:
            words = [names[i] for i in fresh]
            places[fresh] = self.cache.add(words, np.array([_length(self.path, w) for w in words], np.int64))
        return places

    def of_group(self, texts: pa.Array) -> np.ndarray:
        self.cache.make_room()
        units, bounds = pre_tokens(texts)
        letters, tails, plain = split_words(units.dictionary, " ")
        count = np.zeros(len(units.dictionary), np.int64)
        for column in (letters, tails):
            column = column.dictionary_encode()
            at = column.indices.to_numpy()
            spaced = np.zeros(len(column.dictionary), bool)
            spaced[at[plain]] = True
            spaced &= pc.starts_with(column.dictionary, " ").to_numpy(zero_copy_only=False)
            places = self._places(column.dictionary, spaced)
            count += self.cache.count[places][at]
        sums = np.concatenate([[0], np.cumsum(count[units.indices.to_numpy()])])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def of_column(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = pc.match_substring_regex(texts, OTHER_SPACE)
        for special in self.specials:
            whole = pc.or_(whole, pc.match_substring(texts, special))
        out = np.zeros(len(texts), np.int64)
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[k] = _length(self.path, texts[int(k)].as_py())
        texts = pc.if_else(whole, "", texts)
        _, offsets = utf8(texts)
        for i, j in spans(offsets, GROUP):
            out[i:j] += self.of_group(texts[i:j])
        return out


def frequent_units(docs: DataFrame, text: str, table_size: int, per_task: int) -> list[str]:
    """The most frequent pre-tokens, by a bounded summary of each task; all rows are read."""

    def row(seen: Counter, most: int) -> pa.RecordBatch:
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]
        return pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["units", "n"])

    def summarize(batches):
        seen: Counter = Counter()
        for batch in batches:
            _, offsets = utf8(batch.column(0))
            for i, j in spans(offsets, GROUP):
                units, _ = pre_tokens(batch.column(0)[i:j])
                times = np.bincount(units.indices.to_numpy(), minlength=len(units.dictionary))
                most = np.argsort(-times, kind="stable")[: 2 * per_task]
                names = units.dictionary.take(pa.array(most)).to_numpy(zero_copy_only=False).tolist()
                for name, n in zip(names, times[most].tolist()):
                    if len(name) <= LONGEST:
                        seen[name] += n
                if len(seen) > 16 * per_task:
                    seen = Counter(dict(seen.most_common(8 * per_task)))
        yield row(seen, per_task)

    def merge(batches):
        seen: Counter = Counter()
        for batch in batches:
            for names, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, k in zip(names, n):
                    seen[name] += k
                if len(seen) > 4 * table_size:
                    seen = Counter(dict(seen.most_common(2 * table_size)))
        yield row(seen, table_size)

    schema = "units array<string>, n array<long>"
    found = docs.select(F.col(text).alias("text")).mapInArrow(summarize, schema)
    merged = found.repartition(16).mapInArrow(merge, schema).repartition(1).mapInArrow(merge, schema).first()
    return [w for w in merged.units if len(w.encode("utf-8", "surrogatepass")) <= LONGEST] if merged else []


def count_tokens(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", table_size: int = 32_768, per_task: int = 8192) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    spark = docs.sparkSession
    units = frequent_units(docs, text, table_size, per_task)
    table = spark.sparkContext.broadcast((units, np.array([_length(tokenizer_path, u) for u in units], np.int32)))
    name = uuid.uuid4().hex

    def count(batches):
        if (tokenizer_path, name) not in _loaded:
            for old in [k for k in _loaded if isinstance(k, tuple)]:
                del _loaded[old]
            _loaded[tokenizer_path, name] = Lengths(tokenizer_path, *table.value)
        lengths = _loaded[tokenizer_path, name]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lengths.of_column(batch.column(1)))], ["doc_id", "n_bytes", "n_tokens"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return chosen.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusmill.llm.common import read

    counted = count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
