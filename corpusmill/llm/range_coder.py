"""Adaptive context-mixing range coder for token ids, many blocks in step.

A block is coded on its own: its models start empty, and it carries a checksum. Blocks are coded side by side, one id
of each per step, with numpy over the blocks; a block's code ends with the block, whatever stands beside it.

Within a block an id goes by its rank of first appearance. For each id the models of order 2 and order 1 name a
candidate (the id that followed their context last) and how often they have been right. What happens under each pair of
confidences is counted; chances that a candidate is right, and that the id was seen in the block at all, come from these
counts and from those by one confidence alone, mixed in the logistic domain with weights learned per block. An id is
coded as one symbol: which of four cases holds (order 2 right, order 1 right, seen, new), and within it a seen id by
its order-0 count in the block, a new one evenly. Counts and weights are taken over after each stretch of steps, which
grows with the block; ids that come up in between have a count of one kept for them. All arithmetic is in integers, so
that any machine decodes what another has coded.

What is held grows with the blocks in step, so ``TOGETHER`` of them at most are coded and decoded at once.

The range has 64 bits and is kept at 2**32 or more by words of 32 bits, one an id at most. Carries are added to the
word before and resolved at the end.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np

IDS = 1 << 16
TOGETHER = 2048  # blocks in step; each holds some 60 KB while it is coded
SLOTS2 = 1 << 11
STRETCHED = 64, 256  # steps from one taking over of the counts to the next: a quarter of those behind, by powers of two, within these
CASES, UNIT = 12, 28  # bits of a case's share of the range, and of a whole symbol's
PAIRS = 32  # of confidences: order 2 (four), order 1 (four), whether both name the same
FLOOR, LOW, S5, S32, LAST = (np.uint64(x) for x in (1 << 32, (1 << 32) - 1, 5, 32, (1 << UNIT) - 1))
UNIT_SHIFT, WHOLE = np.uint64(UNIT), np.uint64((1 << 64) - 1)

# The bounds of the cases in one word of 64 bits: 0, then the lower bounds of the second to fourth, 16 bits each. All three are compared at
# once: each gets what it is compared with and a bit above, which is left if it is not greater.
S16, S4, S15, FIELD, CASE_SHIFT, FOURTH = (np.uint64(x) for x in (16, 4, 15, (1 << 16) - 1, 48, 3))
THRICE, ABOVE, ADDED, END = (np.uint64(x) for x in (0x0001000100010000, 0x8000800080000000, 0x0000000100010001, 1 << (48 + CASES)))

_x = np.arange(4096)
STRETCH = np.round(np.log((_x + 0.5) / (4095.5 - _x)) * 256).clip(-2047, 2047).astype(np.int32)
SQUASH = np.round(65536 / (1 + np.exp(-(np.arange(4096) - 2048) / 256))).clip(32, 65504).astype(np.int32)

# An entry has its candidate from bit 5 on and twice its doubt (3 to 0, three less its confidence) below; blocks of at most SHORT ids need
# 16 bits for it. With the id that came taken off, what is left is below OFF if the candidate was right.
NAMED, SHORT = 5, 1 << 11
OFF = 1 << NAMED
RIGHT, SEEN, BELIEVED = np.array([11, 5, 2, 0], np.int32), 12, 4  # shares of 16 at first: a candidate of a doubt is right, an id was seen; their weight
HIGH = int(sys.byteorder == "little")  # the half of 64 bits that holds the upper 32


def doubts(off: np.ndarray) -> np.ndarray:
    """Twice the doubts of entries after an id, by the entries with the id taken off: one less if it was named, else 2."""
    out = np.maximum(off, 2)
    out -= 2
    return np.minimum(out, 4, out=out)


def stretch(t: int) -> int:
    """Steps from a taking over at t to the next."""
    least, most = STRETCHED
    return min(max((1 << t.bit_length()) >> 3, least), most)


class Models:
    """The state of all blocks, in flat tables with one stretch for each block."""

    def __init__(self, blocks: int, longest: int):
        most = min(STRETCHED[1], longest)
        self.n, self.room, self.t, self.begun, self.until = blocks, longest + STRETCHED[1] + 1, 0, 0, 0
        lane = np.arange(blocks)
        self.lane, self.at1, self.at2 = lane, lane * self.room, blocks * self.room + lane * SLOTS2
        self.kind = np.uint16 if longest <= SHORT else np.uint32
        self.next = np.full(blocks * (self.room + SLOTS2), 6, self.kind)  # entries of order 1, then of order 2
        self.counts, self.seen = np.zeros(blocks * self.room, np.uint16), np.zeros(blocks, np.int64)
        self.x, self.event = np.zeros((most, blocks), np.int64), np.zeros((most, blocks), np.int64)  # since the last taking over
        # what each question (order 2 right, order 1 right, seen) was answered, by both confidences and by one alone
        right2, right1 = RIGHT[:, None, None], (RIGHT.repeat(2) * np.array([1, 0] * 4))[:, None]
        self.hits = np.empty((3, 4, 8, blocks), np.int32)
        self.hits[0], self.hits[1], self.hits[2] = right2, right1, SEEN
        self.hits *= BELIEVED
        self.asks = np.full((3, 4, 8, blocks), 16 * BELIEVED, np.int32)
        self.one_hits = [self.hits[0, :, :1].copy(), self.hits[1, :1].copy(), self.hits[2, :1, :1].copy()]
        self.one_asks = [np.full_like(x, 16 * BELIEVED) for x in self.one_hits]
        self.weight_one, self.weight = np.full((3, 1, 1, blocks), 24576, np.int32), np.full((3, 1, 1, blocks), 40960, np.int32)

    def take_over(self) -> None:
        """Order-0 counts and their sums, and the chances of the cases, as of this step."""
        n, since, steps = self.n, self.t - self.begun, stretch(self.t)
        if since:
            np.add.at(self.counts, (self.x[:since] + self.at1).ravel(), np.uint16(1))
            self.learn(np.bincount(self.event[:since].ravel(), minlength=4 * n * PAIRS).astype(np.int32).reshape(4, 4, 8, n))
        self.begun, self.until, self.width, self.total = self.t, self.t + steps, int(self.seen.max(initial=0)) + steps + 1, self.t + steps
        self.row = np.arange(n) * self.width
        held = np.zeros((n, self.width), np.uint32)  # a column more, so that sums begin with none
        held[:, 1:] = self.counts.reshape(n, -1)[:, : self.width - 1]
        held.reshape(-1)[(self.row + self.seen + 1)[:, None] + np.arange(steps)] = 1  # each id that may come up before the next time
        self.places = sums = np.cumsum(held, axis=1, out=held)
        if self.total < IDS:  # of 65536, so that (q * total) >> 16 falls below a sum as q does
            sums = sums << np.uint32(16)
            sums += np.uint32(self.total - 1)
            sums //= np.uint32(self.total)
        self.sums = sums.reshape(-1)
        self.chances()

    def ranks_by_place(self) -> tuple[np.ndarray, np.ndarray]:
        """Each rank as often as it is held, block behind block, and where each block begins."""
        filled, highest = self.places[:, -1].astype(np.int64), self.seen + (self.until - self.begun - 1)
        begin = np.cumsum(filled) - filled
        steps = np.zeros(int(filled.sum()) + self.total, np.uint16)  # more, for what damage leads to
        steps[(self.places + begin[:, None]).ravel()] = 1  # no rank up to the highest is held never
        steps[begin[1:]] = -highest[:-1] & (IDS - 1)
        steps[0] = 0
        ranks = np.cumsum(steps, dtype=np.uint16)
        ranks[-self.total :] = 0
        return ranks, begin

    def learn(self, found: np.ndarray) -> None:
        """found: how often each case came, by pair of confidences."""
        asks = found[2:].sum(0, dtype=np.int32)
        asks = np.stack([asks + found[1] + found[0], asks + found[1], asks])
        error = found[:3] * 4095 - asks * (self.p >> 4)
        self.weight += (self.inputs * error).sum((1, 2), keepdims=True, dtype=np.int32) >> 12
        for ask, (axes, hits, tried) in enumerate(zip((1, 0, (0, 1)), self.one_hits, self.one_asks)):
            self.weight_one[ask] += (self.one_inputs[ask] * error[ask].sum(axes, keepdims=True, dtype=np.int32)).sum((0, 1), keepdims=True, dtype=np.int32) >> 12
            hits += found[ask].sum(axes, keepdims=True, dtype=np.int32) - (hits >> 1)
            tried += asks[ask].sum(axes, keepdims=True, dtype=np.int32) - (tried >> 1)
        self.hits += found[:3]
        self.asks += asks
        for weight in (self.weight, self.weight_one):
            np.clip(weight, -(1 << 20), 1 << 20, out=weight)  # so that 32 bits hold what is mixed

    def chances(self) -> None:
        """Lower bounds of the four cases, of 4096, and their end, each by pair of confidences and block."""
        self.inputs = STRETCH.take(self.hits * 4095 // (self.asks + 1))
        self.one_inputs = [STRETCH.take(h * 4095 // (a + 1)) for h, a in zip(self.one_hits, self.one_asks)]
        mixed = self.inputs * (self.weight >> 4)
        for ask, x in enumerate(self.one_inputs):
            mixed[ask] += x * (self.weight_one[ask] >> 4)
        mixed >>= 12
        mixed += 2048
        self.p = p = SQUASH.take(mixed, mode="clip")
        below, self.bounds = 0, np.zeros((5, self.n * PAIRS), np.uint32)
        self.bounds[4] = 1 << CASES
        for ask in range(3):
            rest = (1 << CASES) - below
            below = below + np.clip(rest * p[ask] >> 16, 4, rest - 4 * (3 - ask))  # each case keeps a share
            self.bounds[ask + 1] = below.reshape(-1)

    def packed_bounds(self) -> np.ndarray:
        b = self.bounds.astype(np.uint64)
        return b[1] << np.uint64(16) | b[2] << np.uint64(32) | b[3] << np.uint64(48)


def ranked(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id's rank of first appearance, and whether it appears first there; first is room for a place an id."""
    ids, place = ids.astype(np.int64), np.arange(len(ids), dtype=first.dtype)
    first[ids[::-1]] = place[::-1]
    at = first.take(ids)
    new = at == place
    return (np.cumsum(new, dtype=first.dtype) - first.dtype.type(1)).take(at), new


def groups(blocks: list, together: int) -> list[list]:
    """Of much the same number of blocks each, as a step takes much the same time for few blocks as for many."""
    size = -(-len(blocks) // max(1, -(-len(blocks) // together)))
    return [blocks[i : i + size] for i in range(0, len(blocks), size or 1)]


def encode(blocks: list[np.ndarray], together: int = TOGETHER) -> list[bytes]:
    """Each block's code, behind its length and checksum (4 bytes each); at most 65,535 ids below 65,536 a block."""
    return [code for group in groups(blocks, together) for code in encode_in_step(group)]


def encode_in_step(blocks: list[np.ndarray]) -> list[bytes]:
    n, longest = len(blocks), max((len(b) for b in blocks), default=0)
    if longest >= IDS or any(len(b) and int(b.max()) >= IDS for b in blocks):
        raise ValueError("blocks hold at most 65,535 ids, each below 65,536")
    wide = longest | 1  # rows that lie a power of two apart are slow to turn
    ids, ranks, fresh = np.zeros((n, wide), np.uint16), np.zeros((n, wide), np.uint16), np.zeros((n, wide), bool)
    fresh[:, :1] = True
    first = np.zeros(IDS, np.uint16)
    for k, b in enumerate(blocks):
        ids[k, : len(b)] = b
        ranks[k, : len(b)], fresh[k, : len(b)] = ranked(b, first)
    ids, ranks, fresh = (np.ascontiguousarray(x[:, :longest].T) for x in (ids, ranks, fresh))
    m, sizes = Models(n, longest), np.array([len(b) for b in blocks], np.int64)
    words, kept, carried = np.zeros((longest, n), np.uint32), np.zeros((longest, n), bool), np.zeros((longest, n), bool)
    low, span, ends, ending = np.zeros(n, np.uint64), np.full(n, WHOLE), np.zeros(n, np.uint64), set(sizes.tolist())
    past = np.zeros((STRETCHED[1] + 2, n), np.int64)  # two steps before, and those to code
    while m.t < longest:
        m.take_over()
        t0, steps = m.t, min(m.until, longest) - m.t
        part = slice(t0, t0 + steps)
        x, new = past[2 : steps + 2], fresh[part]
        x[:] = ranks[part]
        m.x[:steps] = x
        slots = np.empty((steps, 2 * n), np.int64)
        np.add(past[1 : steps + 1], m.at1, out=slots[:, :n])
        np.add((past[1 : steps + 1] * 0x9E3B + past[:steps]) & (SLOTS2 - 1), m.at2, out=slots[:, n:])
        named = ranks[part].astype(m.kind) << NAMED
        past[:2] = past[steps : steps + 2].copy()
        off, table = np.empty((steps, 2, n), m.kind), m.next
        for slot, named_, off_ in zip(slots, named, off):
            np.bitwise_xor(table.take(slot).reshape(2, n), named_, out=off_)
            entry = doubts(off_)
            entry += named_
            table[slot] = entry.reshape(-1)
        off1, off2 = off[:, 0], off[:, 1]
        pair = off2 << 2
        pair |= off1
        pair &= PAIRS - 2
        pair |= ((off1 ^ off2) < OFF).view(np.uint8)
        case = (off1 >= OFF).view(np.uint8) + np.uint8(1)
        case *= (off2 >= OFF).view(np.uint8)
        np.copyto(case, 3, where=new)
        event, bounds = m.event[:steps], m.bounds.reshape(-1)
        np.multiply(case, np.int64(n * PAIRS), out=event)
        event += m.lane
        event += pair * np.int64(n)
        below = bounds.take(event)
        share = (bounds[n * PAIRS :].take(event) - below).astype(np.uint64)
        start = below.astype(np.uint64)
        start <<= np.uint64(16)
        at, guessed = m.row + x, case < 2
        within = m.sums.take(at)
        size = m.sums[1:].take(at) - within
        for values, of_new, of_guessed in ((within, ids[part], 0), (size, 1, IDS)):
            np.copyto(values, of_new, where=new)
            np.copyto(values, of_guessed, where=guessed)
        start += within * share
        share *= size
        m.seen += new.sum(0)
        m.t += steps
        for t, start_, share_ in zip(range(t0, t0 + steps), start, share):
            unit = span >> UNIT_SHIFT
            start_ *= unit
            low += start_
            np.less(low, start_, out=carried[t])
            words[t] = low.view(np.uint32)[HIGH::2]
            span = unit * share_
            short = np.less(span, FLOOR, out=kept[t]) << S5
            low <<= short
            span <<= short
            if t + 1 in ending:
                ends = np.where(sizes == t + 1, low, ends)
    return packed(blocks, words, kept, carried, ends, sizes)


def packed(blocks, words, kept, carried, ends, sizes) -> list[bytes]:
    """The words that are kept of each block, with what was carried to them and the two that end it."""
    longest, n = words.shape
    inside = np.arange(longest) < sizes[:, None]
    at = np.flatnonzero(kept.T & inside)
    lane = at // max(longest, 1)
    filled = np.bincount(lane, minlength=n) + 2
    stop = np.cumsum(filled)
    flat = np.zeros(int(filled.sum()), np.uint64)
    flat[np.arange(len(at)) + 2 * lane] = words.reshape(-1).take((at - lane * longest) * n + lane)
    flat[stop - 2], flat[stop - 1] = ends >> S32, ends & LOW
    over = np.flatnonzero(carried.T & inside)  # carried to the word before those that are kept from this step on
    np.add.at(flat, np.searchsorted(at, over) - 1 + 2 * (over // max(longest, 1)), np.uint64(1))
    while (high := np.flatnonzero(flat >> S32)).size:
        flat[high] &= LOW
        np.add.at(flat, high - 1, np.uint64(1))
    flat = flat.astype("<u4")
    return [np.array([len(b), zlib.crc32(b.astype("<u4").tobytes())], "<u4").tobytes() + (flat[i:j].tobytes() if len(b) else b"") for b, i, j in zip(blocks, stop - filled, stop)]


def decode(codes: list[bytes], together: int = TOGETHER) -> list[np.ndarray]:
    """The blocks' ids; a wrong checksum is an error."""
    return [block for group in groups(codes, together) for block in decode_in_step(group)]


@np.errstate(divide="ignore")  # a range of nothing comes of damage, which the checksum finds, and of steps that are left out
def decode_in_step(codes: list[bytes]) -> list[np.ndarray]:
    n = len(codes)
    heads = np.array([np.frombuffer(c[:8], "<u4") for c in codes], np.int64).reshape(n, 2)
    sizes = heads[:, 0]
    longest = int(sizes.max(initial=0))
    if longest >= IDS:
        raise ValueError("a block's length is damaged")
    width = max((len(c) // 4 for c in codes), default=0) + 2
    data = np.zeros(n * width + longest, np.uint64)  # past its end a block reads another's words, for steps that are left out
    for k, c in enumerate(codes):
        body = np.frombuffer(c[8 : len(c) - len(c) % 4], "<u4")
        data[k * width : k * width + len(body)] = body
    m = Models(n, longest)
    lane = m.lane
    pos, span = lane * width + 2, np.full(n, WHOLE)
    value = data.take(pos - 2) << S32 | data.take(pos - 1)
    ranks, second, over = np.zeros((longest, n), np.uint16), np.zeros((longest, n), np.uint16), np.empty((longest, n), bool)
    withins, counts, xs = np.zeros((4, n), np.uint64), np.full((4, n), IDS, np.uint64), np.zeros((4, n), np.uint16)
    counts[3] = 1
    slots, table, last, before = np.empty(2 * n, np.int64), m.next, np.zeros(n, np.int64), np.zeros(n, np.int64)
    hashed, slots2, slots1, of_pair = np.empty(n, np.int64), slots[:n], slots[n:], np.int64(n)
    for t in range(longest):
        if t in (0, m.until):
            m.take_over()
            bounds, sums_after, total = m.packed_bounds(), m.sums[1:], np.uint64(m.total)
            whose, whose_at = m.ranks_by_place()
            whose_at = whose_at.astype(np.uint64)
        np.add(last, m.at1, out=slots1)
        np.multiply(last, 0x9E3B, out=hashed)
        hashed += before
        hashed &= SLOTS2 - 1
        np.add(hashed, m.at2, out=slots2)
        k = t - m.begun
        entry = table.take(slots).reshape(2, n)  # of order 2, then of order 1
        np.right_shift(entry, NAMED, out=xs[:2])
        pair = entry[0] << 2
        pair |= entry[1]
        pair &= PAIRS - 2
        pair |= np.equal(xs[0], xs[1]).view(np.uint8)
        event = np.multiply(pair, of_pair, out=m.event[k])
        event += lane
        unit = span >> UNIT_SHIFT
        v = value // unit
        np.minimum(v, LAST, out=v)
        start = bounds.take(event)
        case = v >> S16
        case *= THRICE
        case |= ABOVE
        case -= start
        case &= ABOVE
        case >>= S15
        case *= ADDED
        case >>= CASE_SHIFT
        new = np.equal(case, FOURTH, out=over[t])
        share = start >> S16
        share |= END
        field = case << S4
        start >>= field
        start &= FIELD
        share >>= field
        share &= FIELD
        share -= start
        start <<= S16
        v -= start
        case = case.view(np.int64)
        at = case * n
        at += lane
        case *= n * PAIRS
        event += case
        q = np.floor_divide(v, share, out=withins[3])
        second[t] = q
        found = q * total
        found >>= S16
        found += whose_at
        found = found.view(np.int64)
        xs[2], xs[3] = whose.take(found), m.seen
        row = m.row + xs[2]
        withins[2] = within = m.sums.take(row)
        counts[2] = sums_after.take(row) - within
        x, within = xs.take(at), withins.take(at)
        within *= share
        start += within
        share *= counts.take(at)
        value -= unit * start
        span = unit * share
        short = np.flatnonzero(span < FLOOR)
        at = pos.take(short)
        value[short] = value.take(short) << S32 | data.take(at)
        span[short] = span.take(short) << S32
        at += 1
        pos[short] = at
        m.seen += new
        named = np.left_shift(x, NAMED, dtype=m.kind)
        entry ^= named
        entry = doubts(entry)
        entry += named
        table[slots] = entry.reshape(-1)
        m.x[k], ranks[t] = x, x
        before, last = last, m.x[k]
        m.t += 1
    new, past = np.ascontiguousarray(over.T), np.ascontiguousarray(second.T)  # the ids that came up, in turn, block by block
    named = np.append(past[new], np.zeros(m.room, np.uint16))
    ids = named.take(ranks + (np.cumsum(m.seen) - m.seen), mode="clip")
    blocks = [ids[:size].astype(np.uint32) for ids, size in zip(np.ascontiguousarray(ids.T), sizes)]
    for b, check in zip(blocks, heads[:, 1]):
        if zlib.crc32(b.astype("<u4").tobytes()) != check:
            raise ValueError("a block's checksum does not match")
    return blocks
