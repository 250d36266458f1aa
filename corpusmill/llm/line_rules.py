"""Quality rules over lines that many documents of one host share.

Lines are compared by their words, A-Z lower-cased; a line without a word counts nowhere. For each host the distinct documents (texts)
that hold a line are counted: copies of one text count once, so a document is not held against itself. Lines in more than ``most``
documents of their host are removed; a document that is left with fewer than ``least`` words, or with less than ``share`` of its
words, is depleted and rejected. Before that, two rules look at the document alone: too few words, and too many words in windows that
the text repeats.

Only 16-byte hashes of (host, line) travel, never texts. Counts are pre-aggregated. Lines go back to their documents in two ways:
of n lines in all, those in more than n / ``hot`` documents are at most ``hot`` and are broadcast; the others meet by a shuffle, in
which no key has more than n / ``hot`` rows.

Edge cases: null text has no words and fails for it; null host is a host of its own. Each row is judged by itself, rows with null or
repeated ids too. Empty tables give empty results; other columns are ignored, whatever their names. A text of any length is read in
parts of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from corpusmill.llm.common import flag_table, gram_hashes, materialize, mix, read, spans, utf8, word_bounds, words_in_parts

WINDOW = 8
BLANK = flag_table(b" \t\n\r\x0b\x0c").astype(bool)
SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(part: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many words of each row lie in windows of WINDOW words that its text holds twice or more."""
    starts, ends = word_bounds(~BLANK[part], edges)
    row = np.searchsorted(edges, starts, "right") - 1
    first = np.searchsorted(row, np.arange(len(edges) - 1))
    n = len(starts) - WINDOW + 1
    if n < 2:
        return np.zeros(len(edges) - 1, np.int64)
    words = words_in_parts(part, starts, ends)
    whole = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    if not len(whole):
        return np.zeros(len(edges) - 1, np.int64)
    grams = mix(gram_hashes(words, WINDOW)[whole] + row[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(grams, kind="stable")
    twin = grams[order][1:] == grams[order][:-1]
    again = whole[order[np.append(twin, False) | np.append(False, twin)]]
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + WINDOW, -1)
    inside = np.append(0, np.cumsum(np.cumsum(step[:-1]) > 0))
    return inside[np.append(first[1:], len(starts))] - inside[first]


def line_key(host: str | None, words: list[bytes]) -> bytes:
    return xxh3_128_digest((b"-" if host is None else b"+" + host.encode("utf-8", "surrogatepass")) + b"\n" + b" ".join(words))


def measures(docs: DataFrame) -> DataFrame:
    """docs (row, doc_id, host, text) to row, doc_id, the five measures of a text, its key, and key and words of its distinct lines."""

    def measure(batches):
        for batch in batches:
            ids, hosts = [batch.column(0), batch.column(1)], batch.column(2).to_pylist()
            data, offsets = utf8(batch.column(3))
            for i, j in spans(offsets):
                edges = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                again = repeated_words(part, edges)
                out = []
                for at in range(i, j):
                    text = data[offsets[at] : offsets[at + 1]].tobytes()
                    seen, lines, n_words, dup = set(), {}, 0, 0
                    for line in text.split(b"\n"):
                        words = line.split()
                        if words:
                            n_words += len(words)
                            dup += line in seen
                            seen.add(line)
                            key = line_key(hosts[at], [w.lower() for w in words])
                            lines[key] = lines.get(key, 0) + len(words)
                    points = text.translate(None, b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0)))
                    symbols = len(text) - len(text.translate(None, SYMBOLS))
                    out.append((n_words, len(points), symbols, dup, int(again[at - i]), xxh3_128_digest(text), list(lines), list(lines.values())))
                types = [*[pa.int64()] * 5, pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                names = ["row", "doc_id", *(m.split()[0] for m in MEASURES.split(", ")), "body", "keys", "words"]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in ids), *columns], names)

    return docs.select("row", "doc_id", "host", "text").mapInArrow(measure, f"row long, doc_id long, {MEASURES}, body binary, keys array<binary>, words array<long>")


def common_lines(lines: DataFrame, most: int) -> DataFrame:
    """key, n of the lines (key, body) that more than most distinct bodies hold."""
    return lines.select("key", "body").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)


def removed_lines(lines: DataFrame, common: DataFrame, hot: int) -> DataFrame:
    """row, key, words of the lines (row, key, words) that are common (key, n)."""
    bar = lines.agg((F.count("*") / hot).alias("bar")).first().bar
    few, rest = common.where(F.col("n") > bar).select("key"), common.where(F.col("n") <= bar).select("key")
    lines = lines.select("row", "key", "words")
    return lines.join(F.broadcast(few), "key").unionByName(lines.join(rest, "key"))


def judged(docs: DataFrame, least: int = 20, repeats: float = 0.3, most: int = 100, share: float = 0.3, hot: int = 100_000) -> DataFrame:
    """row, doc_id, measures, removed_words, base_failed, kept, removed (keys of its removed lines, or null) of docs (row, doc_id, host, text)."""
    measured = materialize(measures(docs), "measures")
    lines = measured.select("row", "body", F.explode(F.arrays_zip("keys", "words")).alias("line")).select("row", "body", "line.keys", "line.words")
    lines = lines.withColumnRenamed("keys", "key")
    common = materialize(common_lines(lines, most), "common")
    removed = removed_lines(lines, common, hot).groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("key").alias("removed"))
    out = measured.drop("body", "keys", "words").join(removed, "row", "left")
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < least) | (F.col("n_repeat_words") * 100 > F.lit(round(repeats * 100)) * F.col("n_words"))
    depleted = (left < least) | (left * 100 < F.lit(round(share * 100)) * F.col("n_words"))
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
    out._shared_tables = [measured, common]
    return out


def numbered(docs: DataFrame, doc_id: str, host: str, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))


def clean(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """doc_id, host, text of the documents that are kept, without the lines that were removed."""
    rows = materialize(numbered(docs, doc_id, host, text), "rows")
    verdicts = judged(rows, **limits)
    kept = rows.join(verdicts.where("kept").select("row", "removed"), "row")

    def strip(batches):
        for batch in batches:
            out = []
            for host, text, removed in zip(*(batch.column(c).to_pylist() for c in ("host", "text", "removed"))):
                if removed:
                    gone = set(removed)
                    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                    left = [x for x in lines if not x.strip(b" \t\n\r\x0b\x0c") or line_key(host, x.lower().split()) not in gone]
                    text = b"\n".join(left).decode("utf-8", "surrogatepass")
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), pa.array(out, pa.string())], ["doc_id", "host", "text"])

    out = kept.mapInArrow(strip, "doc_id long, host string, text string")
    out._shared_tables = [rows, *verdicts._shared_tables]
    return out


def query(spark, sf_dir: str) -> DataFrame:
    docs = numbered(read(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return judged(docs).drop("row", "removed")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d),
windows AS (SELECT r, unnest(range(1, greatest(len(ws) - 6, 1))) AS i, ws FROM w),
grams AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM windows),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
inside AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r),
split AS (SELECT r, source, text AS body, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT r, source, body, line, lower_ascii AS norm, len(list_filter(string_split(lower_ascii, ' '), lambda x: x <> '')) AS n
  FROM (SELECT *, trim(translate(regexp_replace(line, '[ \t-\r]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') AS lower_ascii FROM split)
  WHERE lower_ascii <> ''),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
common AS (SELECT source, norm FROM lines GROUP BY source, norm HAVING count(DISTINCT body) > 100),
removed AS (SELECT r, sum(n) AS removed_words FROM lines JOIN common ON lines.source IS NOT DISTINCT FROM common.source AND lines.norm = common.norm GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \t-\r]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN inside USING (r) LEFT JOIN dups USING (r) LEFT JOIN removed USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (n_words - removed_words < 20 OR 100 * (n_words - removed_words) < 30 * n_words) AS kept FROM b
"""
