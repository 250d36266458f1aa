"""Whole texts to token ids with a worker cache, for tokenizers whose split drops white space.

Such a tokenizer never joins characters over white space, so a text's ids are the ids of its words in turn. Texts
are taken in groups of some megabytes. Arrow splits a group at ASCII white space and numbers its distinct words; a word
of letters with ASCII signs behind them is two units, any other word is one. Only the distinct units of a group are
looked up, in a cache of at most ``bound`` units; units it lacks go to the library, plain letters all in one call, by the
model's merges alone. The ids of the whole group are then put together by position. Special tokens' strings hold no white
space, so the tokenizer itself finds them in the word that holds them.

When the cache is full, the units that the fewest groups have asked for leave it; what was asked before it was last full counts half.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusmill.llm.common import spans

_encoders: dict = {}
GROUP = 4 << 20  # bytes of text in one group
#: Letters that are lower-cased alike everywhere and left alone by normalising, and the ASCII signs.
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def byte_signs() -> list[str]:
    """The sign that a byte-level vocabulary has for each byte: itself if it prints in Latin-1, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def split_words(words: pa.Array, before: str = "") -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Letters and signs of words that are made of both in this order, else the word and nothing; and which are split.

    before: what a word may begin with."""
    words = words.cast(pa.string())
    letters = pc.ascii_rtrim(words, SIGNS)
    plain = pc.fill_null(pc.match_substring_regex(letters, f"^[{before}]?[{LETTERS}]+$" if before else f"^[{LETTERS}]+$"), False)
    return pc.if_else(plain, letters, words), pc.if_else(plain, pc.utf8_ltrim(words, before + LETTERS), ""), plain.to_numpy(zero_copy_only=False)


def model_ids(model, words: list[str]) -> np.ndarray:
    """Ids of words that are one pre-token each, by the merges alone, in one call."""
    from tokenizers import Tokenizer, pre_tokenizers

    plain = Tokenizer(model)
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return np.array(plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)


class UnitCache:
    """Unit to a place in flat tables: how many ids it has and, if ids are kept, where they begin in one buffer.

    The first ``fixed`` units never leave."""

    def __init__(self, bound: int, kind: str | None = None):
        self.bound, self.fixed, self.at = bound, 0, {}
        self.start, self.count, self.asked = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = None if kind is None else np.zeros(0, kind)

    def places(self, units: list[str]) -> np.ndarray:
        """The units' places, -1 where they are not held."""
        found = np.fromiter(map(self.at.get, units, repeat(-1)), np.int64, len(units))
        self.asked[found[found >= 0]] += 1  # the units are distinct
        return found

    def add(self, units: list[str], count: np.ndarray, ids: np.ndarray | None = None) -> np.ndarray:
        """Their places; the units are new."""
        first = len(self.count)
        self.at.update(zip(units, range(first, first + len(units))))
        self.count = np.append(self.count, count)
        self.asked = np.append(self.asked, np.ones(len(units), np.int32))
        if self.ids is not None:
            self.start = np.append(self.start, len(self.ids) + np.cumsum(count) - count)
            self.ids = np.append(self.ids, ids.astype(self.ids.dtype))
        return first + np.arange(len(units))

    def make_room(self) -> None:
        """Between groups only: places change."""
        if len(self.at) <= self.bound + self.fixed:
            return
        keep = np.zeros(len(self.count), bool)
        keep[: self.fixed] = True
        keep[self.fixed + np.argpartition(-self.asked[self.fixed :], self.bound // 2)[: self.bound // 2]] = True
        units = [u for u, k in zip(self.at, keep.tolist()) if k]
        count, asked, ids = self.count[keep], self.asked[keep], None
        if self.ids is not None:
            ids = gather(self.ids, self.start[keep], count)
            self.start, self.ids = self.start[:0], self.ids[:0]
        self.at, self.count, self.asked = {}, self.count[:0], self.asked[:0]
        self.add(units, count, ids)
        self.asked[:] = asked >> 1


def gather(ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches ids[start:start + count], end to end."""
    ends = np.cumsum(count)
    return ids[np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


class WordIds:
    def __init__(self, path: str, bound: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.signs, self.model = np.array([ord(c) for c in byte_signs()], "<u4"), self.tokenizer.model
        self.signs[32] = 32  # words are joined by spaces
        vocabulary = self.tokenizer.get_vocab()
        self.cache = UnitCache(bound, "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def units(self, units: pa.Array, plain: np.ndarray) -> np.ndarray:
        """Places of distinct units in the cache. plain: nothing but letters of LETTERS, lower-cased."""
        names = units.to_numpy(zero_copy_only=False).tolist()
        places = self.cache.places(names)
        new = places < 0
        if (fresh := np.flatnonzero(new & plain)).size:
            words = [names[i] for i in fresh]
            ids = model_ids(self.model, self.signed(words))
            count = np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)
            if len(count) != len(words):
                raise ValueError("a word does not end with its last token")
            places[fresh] = self.cache.add(words, count, ids)
        if (fresh := np.flatnonzero(new & ~plain)).size:
            ids = [self.direct(names[i]) for i in fresh]
            places[fresh] = self.cache.add([names[i] for i in fresh], np.array([len(x) for x in ids]), np.concatenate(ids))
        return places

    def signed(self, words: list[str]) -> list[str]:
        """Words without white space as the vocabulary writes their bytes."""
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        return self.signs[data].tobytes().decode("utf-32-le").split(" ") if words else []

    def encode_group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and each text's bounds in them."""
        self.cache.make_room()
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        edges = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy()
        letters, tails, plain = split_words(words.dictionary)
        parts = []
        for column, mask in ((pc.if_else(pa.array(plain), pc.utf8_lower(letters), letters), plain), (tails, None)):
            column = column.dictionary_encode()
            at = column.indices.to_numpy()
            lower = np.zeros(len(column.dictionary), bool)
            if mask is not None:
                lower[at[mask]] = True
            parts.append(self.units(column.dictionary, lower)[at])
        places = np.stack(parts, axis=1)  # of each distinct word's two units
        count = self.cache.count[places]
        ids, count = gather(self.cache.ids, self.cache.start[places].ravel(), count.ravel()), count.sum(1)
        start, count = (np.cumsum(count) - count)[codes], count[codes]
        bounds = np.concatenate([[0], np.cumsum(count)])[edges - edges[0]]
        return gather(ids, start, count), bounds

    def encode_column(self, texts: pa.Array):
        """The ids (unsigned, 32 bits) of each text in turn; null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        for i, j in spans(offsets, GROUP):
            ids, bounds = self.encode_group(texts[i:j])
            ids, bounds = ids.astype("<u4"), bounds.tolist()
            yield from (ids[a:b] for a, b in zip(bounds, bounds[1:]))

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_column(pa.array([text], pa.string())))


def encoder(path: str) -> WordIds:
    """This worker's encoder; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
