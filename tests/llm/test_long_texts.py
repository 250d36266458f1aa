"""Texts far longer than a part: the results of the whole text, with what is held bounded by a part."""

import tracemalloc

import numpy as np
import pytest

from corpusmill.llm import quality, range_coder
from corpusmill.llm.common import long_word_hash, word_hashes


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_a_long_word_hashes_as_a_short_one():
    rng = np.random.default_rng(0)
    for n in (1, 5, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, 3_000_000):
        word = rng.integers(97, 123, n).astype(np.uint8)
        assert long_word_hash(word)[0] == word_hashes(word, np.array([0]), np.array([n]))[0]


@pytest.mark.parametrize("part", [1, 2, 3, 5, 16, 64, 1000])
def test_quality_features_in_parts_are_those_of_the_whole(part):
    rng = np.random.default_rng(part)
    texts = [b"", b" ", b"   \n\t" * 9, b"x", b"ab", b"abc", b"word" * 40, b" " * 30 + b"end", b"a b  c" * 12, "né ü ".encode() * 20]
    texts += [bytes(rng.choice(np.frombuffer(b"abc  \n", np.uint8), rng.integers(1, 200))) for _ in range(60)]
    texts += [b" ".join(b"w" * int(k) for k in rng.integers(1, 90, 12)) for _ in range(10)]
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        whole = np.bincount(quality.features(data, np.array([0, len(data)]))[0], minlength=quality.KINDS << quality.BITS)
        parts = sum((np.bincount(c, minlength=len(whole)) for c in quality.long_features(data, part)), np.zeros(len(whole), np.int64))
        assert (whole == parts).all(), text


def test_quality_counts_and_scores_of_a_text_beyond_a_part(spark, monkeypatch):
    text = " ".join(f"w{k % 977} {'x' * (k % 70)}" for k in range(3000))
    data = np.frombuffer(text.encode(), np.uint8)
    model = (np.random.default_rng(3).normal(0, 1, quality.KINDS << quality.BITS).astype(np.float32), 0.25)
    codes, counts = quality.feature_counts(data)
    expected = 1 / (1 + np.exp(-((model[0][codes].astype(float) * counts).sum() / counts.sum() + 0.25)))
    monkeypatch.setattr(quality, "PART", 4096)
    in_parts = quality.feature_counts(data)
    assert (in_parts[0] == codes).all() and (in_parts[1] == counts).all()
    long = "lorem ipsum " * 200_000  # beyond a part as the workers know it
    docs = spark.createDataFrame([(1, text), (2, long), (3, " " * 2_000_000), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    monkeypatch.undo()
    codes, counts = np.unique(quality.features(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))[0], return_counts=True)
    of_long = 1 / (1 + np.exp(-((model[0][codes].astype(float) * counts).sum() / counts.sum() + 0.25)))
    bias = 1 / (1 + np.exp(-0.25))
    assert got == pytest.approx({1: expected, 2: of_long, 3: bias, 4: bias})


@pytest.mark.parametrize("kind", ["words", "one word"])
def test_quality_holds_little_of_a_text_of_50_mb(kind):
    data = np.frombuffer((b"some words of a text " * 2_500_000 if kind == "words" else b"w" * 50_000_000), np.uint8)
    assert len(data) >= 50_000_000
    assert peak_mb(lambda: quality.feature_counts(data)) < 300


def test_range_coder_in_groups_of_any_number():
    rng = np.random.default_rng(4)
    blocks = [np.minimum(rng.zipf(1.3, n), 49407).astype("<u4") for n in (0, 1, 2, 700, 300, 40, 90)]
    assert range_coder.encode([]) == [] and range_coder.decode([]) == []
    for write in (1, 3, 7):  # a short block beside a longer one carries some padding, so codes need not be equal
        for read in (1, 2, 7):
            assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(range_coder.encode(blocks, write), read)))


def test_a_block_has_one_code_whatever_stands_beside_it():
    rng = np.random.default_rng(5)
    blocks = [np.minimum(rng.zipf(1.3, n), 49407).astype("<u4") for n in (0, 1, 3, 65, 700, 2048)] + [np.full(300, 9, "<u4")]
    assert range_coder.encode(blocks) == [range_coder.encode([b])[0] for b in blocks]


def test_range_coder_leaves_no_block_to_a_group_of_its_own():
    """A frame ends with a whole document, so it has one block more than its ids would fill; a step costs much the same for one block as for many."""
    many = [np.arange(2, dtype="<u4")] * (range_coder.TOGETHER + 1)
    steps = []
    step = range_coder.encode_in_step
    range_coder.encode_in_step = lambda blocks: steps.append(len(blocks)) or step(blocks)
    try:
        assert len(range_coder.encode(many)) == len(many)
    finally:
        range_coder.encode_in_step = step
    assert sum(steps) == len(many) and max(steps) - min(steps) <= 1


def test_range_coder_on_blocks_of_65535_ids():
    rng = np.random.default_rng(6)
    blocks = [rng.permutation(1 << 16)[:-1], np.zeros(65_535), np.minimum(rng.zipf(1.2, 65_535), 65_535), np.resize(rng.integers(0, 65_536, 50), 65_535)]
    blocks = [b.astype("<u4") for b in blocks]
    codes = range_coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(codes)))
    assert len(codes[1]) < 1200 and len(codes[3]) < 4000


def test_range_coder_finds_damage_anywhere():
    rng = np.random.default_rng(7)
    blocks = [np.minimum(rng.zipf(1.4, n), 49407).astype("<u4") for n in (400, 900)]
    whole = range_coder.encode(blocks)[0]
    for at in rng.integers(4, len(whole) - 8, 40):
        bad = bytearray(whole)
        bad[at] ^= int(rng.integers(1, 256))
        with pytest.raises(ValueError):
            range_coder.decode([bytes(bad), range_coder.encode(blocks)[1]])


def test_range_coder_holds_little_of_many_blocks():
    """As a text of tens of MB gives; short blocks, as the tables of a block do not depend on its length."""
    blocks = [np.arange(k % 7, k % 7 + 12, dtype="<u4") for k in range(8 * range_coder.TOGETHER)]
    got = []
    assert peak_mb(lambda: got.extend(range_coder.decode(range_coder.encode(blocks)))) < 400
    assert all((a == b).all() for a, b in zip(blocks, got))
