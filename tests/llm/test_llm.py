"""The training-data operators against brute force, round trips and held-out labels, and on odd rows."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import ann, gru_lm, id_files, langid, packing, quality, range_coder, simhash, token_count, toxicity, winnow
from corpusmill.llm.word_ids import WordIds

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"
LONG = " ".join(f"w{k % 977}" for k in range(40_000))
ODD = [(1, "the cat sat on the mat and ran away today", "en", "a", 1, 0.0, "x"), (1, "the cat sat on the mat and ran away today", "en", "a", 1, 0.0, "x"), (2, None, None, None, None, None, None), (None, "ein Haus am See", "de", None, 3, 1.0, ""), (3, "", "en", "b", 0, 0.0, ""), (4, "  \n\t ", "en", "b", 0, 0.0, ""), (5, LONG, "en", "b", 9, 0.0, ""), (6, "12 34 !!", None, "b", 9, 0.0, "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


def test_winnowing_is_exact(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b", "c1", "É"], rng.integers(0, 60))) for _ in range(60)]
    items = [(k, " ".join(rng.choice(["a", "b", "c1", "é", "É"], n))) for k, n in enumerate([0, 1, 3, 9, 10, 11, 14, 40])] + [(9, None), (None, "b b b b")]
    index = winnow.Index([(i, t) for i, t in items if t])
    got = list(winnow.scan(index, pa.array(texts)))
    for text, (n, runs, found) in zip(texts, got):
        w = text.split()
        marks, names = set(), set()
        for i, t in items:
            v = (t or "").split()
            size = min(len(v), 10)
            for a in range(len(v) - size + 1) if v else ():
                for b in range(len(w) - size + 1):
                    if w[b : b + size] == v[a : a + size]:
                        marks |= set(range(b, b + size))
                        names.add(i)
        assert n == len(w) and {x for a, b in runs for x in range(a, b)} == marks and found == sorted(x for x in names if x is not None)


def test_winnowing_index_is_compact():
    """Its size goes with its text's, and no more than the bound that blocks are cut by."""
    rng = np.random.default_rng(6)
    items = [(k, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400))) for k in range(100)]
    text = sum(len(t) for _, t in items)
    assert winnow.Index(items).nbytes() <= winnow.SPREAD * text


def test_winnowing_in_blocks_and_sql(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = winnow.find_overlaps(docs, bench)
    many = winnow.find_overlaps(docs, bench, block_bytes=40_000)
    key = lambda r: (r.doc_id, r.n_words, [tuple(x) for x in r.spans], r["items"])
    assert sorted(map(key, one.collect())) == sorted(map(key, many.collect()))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert sorted(map(tuple, winnow.query(spark, SF).collect())) == sorted(db.execute(winnow.SQL).fetchall())


def test_winnowing_odd_rows(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    got = winnow.find_overlaps(odd, none).collect()
    assert len(got) == len(ODD) and all(not r.spans for r in got)
    assert winnow.find_overlaps(odd.limit(0), none).count() == 0


def test_fingerprint_by_definition():
    text = "A b\tc d É f g a b c d"
    words = "a b c d É f g a b c d".split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    assert simhash.fingerprint(text, 4) == want
    assert simhash.fingerprint("A b", 4) == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint(None, 4) == 0


def brute_components(prints, radius):
    left, out = list(dict.fromkeys(prints)), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            near = [y for y in left if bin(x ^ y).count("1") <= radius]
            left = [y for y in left if y not in set(near)]
            todo += near
        for x in group:
            out[x] = frozenset(group)
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_links_find_all_components(spark, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = [int(x) for x in base] + [0, 15, 31]
    for x in list(prints):
        for _ in range(5):
            y = x
            for b in rng.choice(64, rng.integers(0, 8), replace=False):
                y ^= 1 << int(b)
            prints.append(y)
    want = brute_components(prints, 4)
    frame = spark.createDataFrame([(simhash.signed(x),) for x in set(prints)], "fp long")
    got: dict = {}
    for r in simhash.classes(frame, 4, block).collect():
        got.setdefault(r.root, set()).add(r.fp % (1 << 64))
    assert {frozenset(v) for v in got.values()} == set(want.values())


def test_near_duplicates_odd_rows(spark, odd):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert len(got) == len(ODD)
    assert {c for none, k, c in got if k in (2, 3, 4) and not none} == {2}
    assert simhash.keep_one(odd).count() == len(ODD) - 3 and simhash.keep_one(odd).columns == odd.columns
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_query_against_brute_force(spark, docs):
    """The whole query on all documents: fingerprints by definition, components over all pairs."""
    rows = docs.select("doc_id", "text").collect()

    def by_definition(text):
        words = (text or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))

    prints = {r.doc_id: by_definition(r.text) for r in rows}
    groups = brute_components(list(prints.values()), 4)
    least: dict = {}
    for k, p in prints.items():
        least[groups[p]] = min(k, least.get(groups[p], k))
    want = sorted((k, f"{p:016x}", least[groups[p]]) for k, p in prints.items())
    assert sorted(map(tuple, simhash.query(spark, SF).collect())) == want


def test_keep_one_leaves_other_columns(spark):
    rows = [(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y"), (3, None, 9, "z"), (4, "", 9, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row int, cls string")
    assert sorted(map(tuple, simhash.keep_one(frame).collect())) == [rows[0], rows[2]]


def test_keep_one_goes_by_jaccard(spark):
    """Groups by five-word shingles at 0.8, against brute force; in one large group and in pairs around the bound."""
    rng = np.random.default_rng(9)
    texts = []
    for size in [*rng.integers(60, 300, 60), 400]:
        base = [f"t{x}" for x in rng.integers(0, 50_000, size)]
        for _ in range(4 if size != 400 else 120):
            copy = list(base)
            for at in rng.choice(size, rng.integers(0, max(2, size // 30)), replace=False):
                copy[at] = f"n{rng.integers(0, 50_000)}"
            texts.append(" ".join(copy))
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root, near = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                near += simhash.fingerprint(texts[i], 5) != simhash.fingerprint(texts[j], 5)
                root = [min(a, b) if r in (a, b) else r for r in root]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near > 500 and sorted(r.doc_id for r in simhash.keep_one(frame, block=16).collect()) == sorted(set(root))


def test_packing_is_gapless_and_whole(spark, docs, odd):
    for frame, size in ((docs, 256), (odd, 4096)):
        rows = packing.pack(frame, word_bpe(), size).collect()
        spots: dict = {}
        for r in rows:
            spots.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in spots.values():
            parts.sort()
            assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts[:-1]])) and sum(n for _, n in parts) <= size
        used = sum(r.length for r in rows)
        if frame is docs:
            assert used / (len(spots) * size) > 0.97
            ids = WordIds(word_bpe())
            texts = {r.doc_id: r.text for r in docs.collect()}
            for r in rows:
                data = ids.direct(texts[r.doc_id] or "").tobytes() + b"\2\0\0\0"
                assert r.doc_tokens == len(data) // 4 and r.ids_crc32 == zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)])
    assert packing.pack(odd.limit(0), word_bpe()).count() == 0


def test_word_ids_equal_the_library():
    import random

    rng, letters = random.Random(2), "".join(map(chr, range(0xA0, 0x180))) + "abzXYZ"
    signs = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    odd = ["".join(rng.choice("abzABZJ .,'\n\téÉßİ\u0301\u030c\x00\x1c\x85<|endoftext|>09½中") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    plain = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + "".join(rng.choice(signs) for _ in range(rng.randint(0, 3))) for _ in range(3000)]
    ids = WordIds(word_bpe(), bound=50)
    for texts in (odd, plain, [" ".join(plain), None, *plain[:9]]):
        for k in range(0, len(texts), 100):  # the cache is cleared between groups
            for text, got in zip(texts[k : k + 100], ids.encode_column(pa.array(texts[k : k + 100]))):
                assert got.tolist() == ids.direct(text or "").tolist()


def test_token_counts_equal_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(k, x) for k, x in enumerate(["a  b", " a\n\n b ", "x<|endoftext|> y", "it's\x1c 1　é", "\n", "  "])], "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), extra):
        want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) for r in frame.collect())
        assert sorted(r.n_tokens for r in token_count.count_tokens(frame, path, table_size=50).collect()) == want
    assert token_count.count_tokens(odd.limit(0), path).count() == 0


def test_token_counts_of_blanks_and_signs():
    import random

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(7)
    for alphabet in ("ab 's  \n!", "abzABZ .,'\n\té \r\x0b\x0c\x1c\x85\xa0\x00<|endoftext|>09½中$%!-_sdm\u3000"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
        lengths = token_count.Lengths(path, [" a", "b"], np.array([1, 1]), bound=50)
        for k in range(0, len(texts), 500):
            got = lengths.of_column(pa.array(texts[k : k + 500]))
            assert got.tolist() == [token_count._length(path, t) for t in texts[k : k + 500]]


def test_token_counts_of_a_very_long_word(spark):
    from tokenizers import Tokenizer

    path, long = public_tokenizers.path("byte_bpe_50k.json"), "".join(chr(0x4E00 + k % 5000) for k in range(70_000))
    want = len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids)
    got = token_count.count_tokens(spark.createDataFrame([(1, long)], "doc_id long, text string"), path).first().n_tokens
    assert got == want > 65_535


def recall_at_10(frame, found):
    """Share of the true ten nearest (one of equal distances is as good as another) among the found ones."""
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in frame.collect() if r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    matrix, names, got = np.array([v for _, v in rows]), np.array([i for i, _ in rows]), {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append(r.score)
    hit = total = 0
    for q, v in rows:
        if q % 100 == 0:
            tenth = np.sort(np.sqrt(((matrix - v) ** 2).sum(axis=1))[names != q])[9]
            assert len(got[q]) == 10
            hit += sum(s <= tenth + 1e-9 for s in got[q])
            total += 10
    return hit / total


def test_neighbours_against_brute_force(spark):
    """One cell and many cells, on vectors without structure and on clusters."""
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall_at_10(frame, ann.query(spark, "/root/testdata/sf0.1")) >= 0.9
    assert recall_at_10(frame, ann.search(frame, frame.where("vec_id % 100 = 0"), cell_rows=300, block=5)) >= 0.9
    rng = np.random.default_rng(2)
    points = rng.normal(size=(40, 32))[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 32))
    clusters = spark.createDataFrame([(k, v) for k, v in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    assert recall_at_10(clusters, ann.search(clusters, clusters.where("vec_id % 100 = 0"), cell_rows=500)) >= 0.9


@pytest.mark.parametrize("clustered, most", [(True, 0.05), (False, 0.75)])
def test_neighbours_stop_early(clustered, most):
    """The chi-square test ends the walk before all vectors are checked."""
    rng = np.random.default_rng(3)
    if clustered:
        points = rng.normal(size=(100, 64))[rng.integers(0, 100, 5000)] + 0.1 * rng.normal(size=(5000, 64))
    else:
        points = rng.normal(size=(2000, 64))
        points /= np.linalg.norm(points, axis=1, keepdims=True)
    projected = points @ rng.normal(size=(64, 20))
    tree, stop = ann.Tree(projected), ann.chi_square_quantile(0.95, 20)
    checked = hit = 0
    for q in range(0, len(points), 100):
        best, n = ann.nearest(tree, points[tree.order], [[int(i)] for i in tree.order], points[q], projected[q], q, 10, stop)
        d = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len({i for _, i in best} & set(np.argsort(d)[:10].tolist()))
        checked += n
    queries = len(range(0, len(points), 100))
    assert checked < most * queries * len(points) and hit >= 0.9 * queries * 10


def test_neighbours_ties_and_odd_vectors(spark):
    rows = [(k, [1.0, 2.0]) for k in range(30)] + [(100, [1.0, 2.0]), (200, None), (300, [0.0, 0.0]), (400, [float("nan"), 1.0]), (500, [1.0, None]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(frame, frame.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [*range(1, 11), *range(10)] and {r.score for r in got} == {0.0}
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0


def test_neighbours_take_the_most_frequent_length(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), *((k, [float(k), 1.0]) for k in range(1, 6))], "vec_id long, embedding array<float>")
    assert sorted(r.vec_id for r in ann.search(frame, frame.where("vec_id = 1")).collect()) == [2, 3, 4, 5]


def test_range_coder_round_trip_and_checksum():
    rng = np.random.default_rng(4)
    blocks = [np.minimum(rng.zipf(1.3, n), 49407).astype("<u4") for n in (0, 1, 2, 700, 2048)] + [np.full(500, 7, "<u4"), np.arange(900, dtype="<u4") * 50]
    codes = range_coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(codes)))
    assert all((range_coder.decode([c])[0] == b).all() for b, c in zip(blocks, codes))  # each on its own
    bad = bytearray(codes[3])
    bad[40] ^= 255
    with pytest.raises(ValueError):
        range_coder.decode([bytes(bad)])


def test_range_coder_keeps_a_share_for_surprises():
    """Long repeats make the models sure; rare other ids must still have a share of the range in every case."""
    r, blocks = np.random.default_rng(1), []
    for k in range(60):
        block = np.resize(r.integers(0, [3, 9, 50_000][k % 3], r.integers(1, 60)), 2048).astype("<u4")
        odd = r.random(2048) < [0.002, 0.01, 0.05][k // 3 % 3]
        block[odd] = np.where(r.random(odd.sum()) < 0.5, block[:1], r.integers(0, 65_536, odd.sum()))
        blocks.append(block)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(range_coder.encode(blocks))))


def test_id_files_round_trip(spark, odd, tmp_path):
    path = str(tmp_path / "ids")
    id_files.write_ids(odd, path, word_bpe(), frame_ids=30_000, block_ids=512)
    got = sorted(id_files.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6] and [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    ids = WordIds(word_bpe())
    assert got[6].ids_crc32 == zlib.crc32(ids.direct(LONG).tobytes() + b"\2\0\0\0") and got[3].n_tokens == 1
    empty = str(tmp_path / "none")
    id_files.write_ids(odd.limit(0), empty, word_bpe())
    assert id_files.read_ids(spark, empty).count() == 0


def test_id_files_of_all_documents(spark, docs):
    """The whole query against the library: every start, length and checksum."""
    ids, at = WordIds(word_bpe()), 0
    got = {r.doc_id: r for r in id_files.query(spark, SF).collect()}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        data = np.append(ids.direct(r.text or ""), np.array([2], "<u4"))
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(data), zlib.crc32(data.tobytes()))
        at += len(data)


@pytest.mark.parametrize("query, label", [(quality.query, "quality"), (toxicity.query, "toxic")])
def test_classifiers_on_held_out_labels(spark, query, label):
    """By the area under the curve and by balanced accuracy, which a constant answer leaves at one half."""
    sf = "/root/testdata/sf0.1"
    rows = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    y, score, said = (np.array([r[c] for r in rows]) for c in (label, "score", "predicted"))
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for value in np.unique(score):  # equal scores share their mean rank
        rank[score == value] = rank[score == value].mean()
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    area = (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)
    assert min(ones, zeros) >= 20 and area >= 0.8
    assert ((said[y == 1] == 1).mean() + (said[y == 0] == 0).mean()) / 2 >= 0.75


def test_subsequence_kernel_against_brute_force():
    """Kernel values and the folded machine's word values, over all triples of letters in order within five."""

    def weights(word):
        out: dict = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + 5)):
                    key = (word[i], word[j], word[k])
                    out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i + 1)
        return out

    def norm(word):  # each place of a triple counts by itself
        return np.sqrt(max(sum(toxicity.DECAY ** (2 * (k - i + 1)) for i in range(len(word)) for j in range(i + 1, len(word)) for k in range(j + 1, min(len(word), i + 5))), 1e-9))

    rng = np.random.default_rng(12)
    words = [bytes(rng.integers(1, 6, rng.integers(1, 12)).tolist()) for _ in range(40)]
    tables = [{k: v / norm(w) for k, v in weights(w).items()} if len(w) > 2 else {} for w in words]
    want = np.array([[sum(v * b.get(k, 0.0) for k, v in a.items()) for b in tables] for a in tables])
    got = toxicity.kernel(words, words)
    assert np.allclose(got, want, atol=1e-4)
    alpha = rng.normal(size=len(words))
    beta = toxicity.fold(words, alpha)
    values = toxicity.word_scores(np.frombuffer(b"".join(b"\0" + w for w in words), np.uint8), beta)
    assert np.allclose(values, want @ alpha, atol=1e-3)


def test_toxicity_sees_through_gaps(spark):
    rng = np.random.default_rng(5)
    plain = ["river", "stone", "window", "garden", "letter", "morning", "bridge", "forest"]
    clean = [(0, " ".join(rng.choice(plain, 12))) for _ in range(120)]
    bad = [(1, " ".join([*rng.choice(plain, 8), rng.choice(["blockhead", "nitwit"])])) for _ in range(60)]
    model = toxicity.train(sorted(clean + bad))
    p = toxicity.probabilities(pa.array(["a block-head", "n i t w i t", "nittwit", "garden bridge", "", None]), model)
    assert (p[:3] > 0.5).all() and (p[3:] < 0.5).all()


def test_langid_counts_a_long_text_in_parts(monkeypatch):
    text = np.frombuffer(("Ünder dem Baum 12 sat Jörg. " * 40).encode(), np.uint8)
    whole = langid.counts(text, np.array([0, len(text)]))
    for size in (7, 100, 1120, 5000):
        monkeypatch.setattr(langid, "LONG", size)
        assert (sum(langid.part_counts(text)) == whole).all()


def test_langid_held_out(spark):
    """Each language by itself."""
    rows = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    for lang in {r.lang for r in rows}:
        assert np.mean([r.lang_pred == lang for r in rows if r.lang == lang]) >= 0.9


def test_langid_rejects_other_languages(spark):
    """Texts of other languages and junk go though some training texts are short and odd; clean texts stay."""
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    other = [
        "De burgemeester heeft gisteren besloten dat het oude gebouw aan de gracht wordt afgebroken en vervangen door nieuwe woningen voor jonge gezinnen uit de buurt.",
        "W sobotę wieczorem wszyscy mieszkańcy naszej wsi spotkali się przy ognisku, żeby wspólnie śpiewać piosenki i opowiadać dzieciom stare historie o królach.",
        "昨天晚上我们一起去了城里的图书馆,读了很多关于历史和科学的书,然后慢慢地走回家,路上还买了一些水果和面包。",
        "Вчера вечером мы пошли в городскую библиотеку и долго читали книги по истории, а потом медленно шли домой через парк.",
        "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3QgbWVzc2FnZSB3aXRoIG5vIG1lYW5pbmc0IHF4enZrIHdwcWpoIGJ0bWNmIHpxeGtqdiBwbXdxIHJ0eQ",
        "xqzv wkjq pzxr vbqk mwxz qjfh zzkv xpwq kqjz vxwm jqpz wvkx qzxj hvkq zwpx qkvj xzmq wjzk",
    ]
    model = langid.fit(frame)
    assert all(r.rejected for r in langid.predict(spark.createDataFrame(list(enumerate(other)), "doc_id long, text string"), model).collect())
    good = frame.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id").distinct(), "doc_id")
    assert langid.predict(good, model).where("not rejected").count() >= 0.99 * good.count()


def test_samples_bound_rows_not_ids(spark, docs):
    """A repeated or null id brings one row, or its share of them, to the fit."""
    labelled = spark.read.parquet(f"{SF}/labels.parquet")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        key = labelled.where(f"{label} = 1").join(docs.where("text is not null"), "doc_id").select("doc_id").orderBy("doc_id").first().doc_id
        again = docs.where(F.col("doc_id") == key).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("copy")
        few, many = module.fit(docs, labelled, label), module.fit(docs.unionByName(again), labelled, label)
        assert all(np.array_equal(a, b) for a, b in zip(few, many))
        assert quality.labelled_rows(docs.unionByName(again), labelled, label, "doc_id", "text", 50).count() <= 50
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    assert 400 < langid.sampled(rows, {"en": 20_000}, 500).count() < 600


def test_models_on_odd_rows(spark, odd, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        got = module.score(odd, module.fit(odd, labels, label)).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert module.score(odd.limit(0), module.fit(odd, labels.limit(0), label)).count() == 0
    got = langid.predict(odd, langid.fit(odd)).collect()
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4, 6)} == {"und"} and len(got) == len(ODD)
    assert langid.predict(odd, langid.fit(odd.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_model(spark, docs, odd):
    sf = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10)
    got = gru_lm.score(docs, sf.where("h <> 0"), known=3000, head=500, inputs=800).collect()
    from collections import Counter

    c: Counter = Counter()
    for r in sf.where("h <> 0").collect():
        c.update(gru_lm.words_of(r.text))
    n, v = sum(c.values()), len(c)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        words = gru_lm.words_of(texts[r.doc_id])
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert r.train_tokens == n and r.n_tokens == len(words) and r.n_known == sum(c[w] > 0 for w in words) and abs(r.base_score - base) < 1e-6 * abs(base)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    few = gru_lm.score(odd, odd, known=50, head=10, inputs=20).collect()
    assert len(few) == len(ODD) and all(np.isfinite(r.score) for r in few)
    none = gru_lm.score(odd, odd.limit(0)).collect()
    assert all(r.n_known == 0 and np.isfinite(r.score) and np.isfinite(r.base_score) for r in none)


def small_vocabulary():
    counts = np.array(sorted(np.random.default_rng(8).integers(5, 500, 300).tolist(), reverse=True))
    v = gru_lm.Vocabulary(counts, int(counts.sum()) + 40, 320, 130, 100)
    v.end = 3
    return v


def random_weights(v):
    rng = np.random.default_rng(9)
    w = {k: x.astype(np.float64) + rng.normal(size=x.shape) * 0.3 for k, x in gru_lm.start_weights(v).items()}
    w["bi"].reshape(-1)[v.head :] = -1e4
    return w


def test_language_model_gradients(monkeypatch):
    """Against finite differences, for some entries of each weight."""
    monkeypatch.setattr(gru_lm.np, "float32", np.float64)
    v, rng = small_vocabulary(), np.random.default_rng(10)
    w = random_weights(v)
    ids = rng.integers(0, 301, (9, 5))
    x, y, h = np.minimum(ids[:-1], v.inputs), ids[1:], rng.normal(size=(5, gru_lm.HIDDEN))
    _, g, _ = gru_lm.gradients(w, v, x, y, h)
    rows, values = g.pop("emb")
    g["emb"] = np.zeros_like(w["emb"])
    g["emb"][rows] = values
    for key, whole in w.items():
        flat, grad = whole.reshape(-1), g[key].reshape(-1)
        for at in [*np.argsort(-np.abs(grad))[:4], *rng.integers(0, len(flat), 4)]:
            if flat[at] < -1e3:
                continue
            old, loss = flat[at], []
            for d in (1e-5, -1e-5):
                flat[at] = old + d
                loss.append(gru_lm.gradients(w, v, x, y, h)[0])
            flat[at] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - grad[at]) < 1e-4 * max(1, abs(grad[at])), (key, at)


def test_language_model_chances_sum_to_one():
    """Over all known tokens, the other seen ones and the unknown one, in any state; for the mixture with the base model."""
    v = small_vocabulary()
    w = {k: x.astype(np.float32) for k, x in random_weights(v).items()}
    for before in ([], [5], [200, 7, 300, 1]):
        each = [np.array([*before, t]) for t in range(301)]
        prefix = gru_lm.log_likelihoods(w, v, [np.array(before)], 0.9)[0] if before else 0.0
        chance = 10 ** (gru_lm.log_likelihoods(w, v, each, 0.9) - prefix)
        chance[v.head : 300] *= v.counts[v.head :] + 0.1
        chance[300] *= 40 + 0.1 * 21  # twenty seen tokens beyond the table, forty times, and the unknown one
        assert abs(chance.sum() - 1) < 1e-4


def test_language_model_gains_on_held_out_texts(spark):
    rows = gru_lm.query(spark, "/root/testdata/sf0.01").where("held_out").collect()
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.1


def test_language_model_trains_on_every_token(spark, monkeypatch):
    """Over both rounds and all tasks, each training token is read once."""
    held = spark.sparkContext.accumulator(0)
    real = gru_lm.train_stream
    monkeypatch.setattr(gru_lm, "train_stream", lambda w, v, seen, stream: held.add(len(stream)) or real(w, v, seen, stream))
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words ") , F.col("id").cast("string")).alias("text"))
    gru_lm.score(frame, frame, known=50)
    assert held.value == 1600


def test_pipeline_keeps_clean_documents(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    frame = docs
    counts = []
    for name in ("language", "toxicity", "near-duplicates", "decontamination"):
        frame = stages[name](spark, frame, SF)
        assert frame.columns == docs.columns
        counts.append(frame.count())
    assert counts == sorted(counts, reverse=True) and counts[0] >= 0.97 * docs.count()
    ids = {r.doc_id for r in frame.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == ids
    assert hashlib.sha256(b"").hexdigest() == winnow.query(spark, SF).where("not contaminated").first().items_sha256


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    """Null, empty, repeated and very long texts, null ids, columns with the names that the stages use; and empty tables."""
    bench = spark.createDataFrame([(1, "the cat sat on the mat and ran away"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    again = odd.unionByName(odd).withColumn("_row", F.lit(1)).withColumn("cls", F.lit("x")).withColumn("spans", F.lit(2.0))
    for name, frame, ids in (("full", again, {1, 5}), ("none", again.limit(0), set())):
        folder = tmp_path / name
        for table, rows in (("documents", frame), ("benchmark", bench), ("labels", labels if ids else labels.limit(0))):
            rows.write.parquet(str(folder / f"{table}.parquet"))
        got = corpus_pipeline.run(spark, str(folder))
        assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert {r.doc_id for r in got.collect()} <= ids | {None}
        stages = dict(corpus_pipeline.STAGES)
        for stage in ("language", "toxicity", "near-duplicates", "decontamination"):
            kept = stages[stage](spark, frame, str(folder))
            assert kept.columns == frame.columns
            rows = [r.asDict() for r in kept.collect()]
            assert len(rows) <= 2 * len(ODD) and (ids or not rows)
            if stage == "near-duplicates" and ids:
                assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "5", "6", "None"]
            if stage == "decontamination":
                assert all(r["doc_id"] != 1 for r in rows)


LOST = ["w3176 w6950 w9745 w2120 w8534 w6158 w929 w2457 w9142", "w4243 w5810 w4520 w8703 w3752 w1032 w955 w829 w6995", "w2000 w1070 w7556 w6176 w7137 w3922 w6965 w5063 w63", "w7194 w457 w7602 w4938 w4381 w5433 w2779 w8001 w2749"]


def test_keep_one_loses_no_pair_to_chance(spark):
    """Texts at 0.8 whose min-hashes agree in none of 20 bands of four."""
    rows = [(k + 10 * n, t) for k, text in enumerate(LOST) for n, t in enumerate((text, text.rsplit(" ", 1)[0]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == [0, 1, 2, 3]


def test_keep_one_with_passages_that_many_texts_share(spark, monkeypatch):
    """Against brute force: passages common to a third of the texts, pairs just above and just below the bound, sets of any size, parts of few classes."""
    rng = np.random.default_rng(3)
    passage, texts = [f"p{k}" for k in range(30)], []
    for size in rng.integers(1, 90, 150):
        base = [f"t{x}" for x in rng.integers(0, 50_000, size)] + (passage if rng.random() < 0.3 else [])
        texts += [" ".join(base[: max(1, len(base) - cut)]) for cut in rng.integers(0, len(base) // 4 + 2, 3)]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(frame, block=8).collect()) == sorted(set(root))
    known, _ = simhash.common_grams(frame.selectExpr("doc_id as _row", "text"), 5)
    assert len(known) >= 26 and (np.diff(known.astype(object)) > 0).all()


@pytest.mark.parametrize("similarity", [0.3, 0.8, 1.0])
def test_pairs_that_may_be_similar_hold_all_that_are(similarity):
    rng = np.random.default_rng(5)
    sets = []
    for size in [1, 2, 4, 5, 9, 31, 32, 33, 64, 300, 5000, 40_000]:
        base = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for share in (1, 0.95, 0.85, 0.8, 0.6, 0.3):
            sets.append(np.unique(np.concatenate([base[: max(1, round(len(base) * share))], rng.integers(0, 1 << 63, int(rng.integers(0, 2))).astype(np.uint64)])))
    common = (np.sort(np.concatenate([s[:2] for s in sets[::6]])), np.full(24, 5))
    common = tuple(c[np.unique(common[0], return_index=True)[1]] for c in common)
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if simhash.similar(sets[i], sets[j], similarity)}
    sizes, odd = np.array([len(s) for s in sets]), [simhash.parities(s) for s in sets]
    got = [(int(x), int(y)) for a, b in simhash.near_sets(odd, sizes, np.zeros(len(sets), int), similarity) for x, y in zip(a, b)]
    assert near <= set(got) and len(got) == len(set(got)) < len(sets) ** 2 / 4
    keys = [set(simhash.prefix(s, similarity, common).tolist()) for s in sets]
    assert all(keys[i] & keys[j] for i, j in near)
