"""Ids of texts and their files: what is done once for many words, blocks and frames."""

import zlib

import numpy as np
import pytest

from corpusmill.llm import id_files, range_coder
from corpusmill.llm.word_ids import UnitCache, WordIds, byte_signs


@pytest.mark.parametrize("n, check", [(0, 1696784233), (1, 3851881604), (63, 1817435965), (2048, 4124339236), (2049, 2479869163), (5000, 341411845)])
def test_codes_are_those_of_files_written_before(n, check):
    at = np.arange(n)
    block = np.minimum((at * at // 7) % (11 + at // 9) * 37 % 49407, 49407).astype("<u4")
    code = range_coder.encode([block])[0]
    assert zlib.crc32(code) == check and (range_coder.decode([code])[0] == block).all()


def frame(k: int, blocks: int):
    ids = [np.arange(k, k + 4, dtype="<u4")] * blocks
    return 0, k, [k, k + 100], [1, 4 * blocks - 1], range_coder.encode(ids)


def test_frames_of_a_task_are_decoded_in_the_same_steps(monkeypatch):
    """A step takes little more time for more blocks, so frames by themselves took a step each."""
    steps, step = [], range_coder.decode_in_step
    frames = [frame(k, 5 + k) for k in range(3)]
    monkeypatch.setattr(range_coder, "decode_in_step", lambda codes: steps.append(len(codes)) or step(codes))
    got = [batch.to_pylist() for batch in id_files.checked(iter(frames))]
    assert steps == [18]
    for k, rows in enumerate(got):
        data = np.tile(np.arange(k, k + 4, dtype="<u4"), 5 + k)
        checks = [zlib.crc32(data[:1].tobytes()), zlib.crc32(data[1:].tobytes())]
        assert [(r["frame"], r["doc_id"], r["inner"], r["n_tokens"], r["ids_crc32"]) for r in rows] == [(k, k, 0, 1, checks[0]), (k, k + 100, 1, 4 * (5 + k) - 1, checks[1])]


def test_frames_are_held_for_two_groups_at_most(monkeypatch):
    monkeypatch.setattr(range_coder, "TOGETHER", 8)
    taken = []

    def frames():
        for k in range(9):
            taken.append(k)
            yield frame(k, 4)

    batches = id_files.checked(frames())
    next(batches)
    assert len(taken) == 4 and len(list(batches)) == 8
    assert list(id_files.checked(iter([]))) == []


def test_frames_with_a_block_missing_are_an_error():
    whole, short = frame(0, 5), frame(1, 5)
    with pytest.raises(ValueError):
        list(id_files.checked(iter([whole, (*short[:4], short[4][:-1])])))


def test_cache_keeps_what_most_groups_ask_for():
    cache = UnitCache(100, "<u2")
    often = [f"often{k}" for k in range(40)]
    cache.add(often, np.full(40, 2), np.arange(80))
    for group in range(4):
        once = [f"once{group}-{k}" for k in range(70)]
        assert (cache.places(once) == -1).all()
        cache.add(once, np.ones(70, np.int64), np.zeros(70))
        at = cache.places(often)
        assert (at >= 0).all() and (cache.count[at] == 2).all() and (cache.ids[cache.start[at]] == np.arange(0, 80, 2)).all()
        cache.make_room()
        assert len(cache.at) <= 100


def test_words_as_the_vocabulary_writes_them():
    import public_tokenizers

    words, signs = ["abc", "été", "ÿ", "x" * 70, "naïve"], byte_signs()
    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert ids.signed(words) == ["".join(signs[b] for b in w.encode()) for w in words] and ids.signed([]) == []
