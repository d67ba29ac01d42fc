"""Adaptive context-mixing range coder for 16-bit ids, run over many independent blocks in lockstep.

The distribution of an id mixes three predictions: order 2 (the id that last followed the previous two), order 1 (the id that
last followed the previous one) and order 0 (the ids of the block so far, by how often each occurred, with a share for
ids that are new). P(x) = m2 [x = order-2 id] + m1 [x = order-1 id] + m0 P0(x). The masses m2 and m1 are learnt after every id, apart
for each confidence of a prediction (how often running it held in its context); m0 is what they leave. One step of a 48-bit range
coder codes an id, and a new id takes another step for its 16 bits.

P0 is formed anew at fixed places of the block, each twice as far as the one before, from the counts up to there: 2,048
slots are shared among the ids by count, at least one each, so that decoding an id takes one look at its slot instead of a search.
The share of new ids is that of the stretch before.

Blocks share no state: each starts from the same model, so any one can be read alone. Many blocks are lanes of the
same numpy operations, which is what makes the coder affordable in Python. All arithmetic is on integers, or single IEEE divisions
of integers whose quotients cannot be rounded across a whole number, so encoder and decoder agree on any machine.
"""

from __future__ import annotations

import numpy as np

#: The longest block: the ids before P0 is last formed, and the share of new ids, must fit into the slots.
LONGEST = 2048
_BITS = 11
_SLOTS = 1 << _BITS
_MASK32, _TOP = (1 << 32) - 1, (1 << 48) - 1
_ONE = 1 << 16
_CONTEXTS = 8  # bits of a context's hash
_MOST = np.array([[55_000], [18_000]], np.int32)  # of 2^16 for order 2, and of what it leaves in 2^15 for order 1
_LEAST, _RATE = 64, 5
_PART = 256  # blocks whose tables are made at once, so that what goes into them stays small
_AHEAD = 64  # steps whose slots are looked up at once
_FIRST, _LEAST_NEW, _MOST_NEW = 64, 16, 900


def _stretches(steps: int) -> list[tuple[int, int]]:
    """The stretches of a block within which P0 stays as it is."""
    places = [0]
    while places[-1] < steps:
        places.append(min(steps, max(_FIRST, 2 * places[-1])))
    return list(zip(places, places[1:], strict=False))


def _new_share(new: np.ndarray, length: int) -> np.ndarray:
    """Slots for new ids, by how many of the last ``length`` ids were new."""
    return np.clip(new * _SLOTS // length, _LEAST_NEW, _MOST_NEW)


class _Contexts:
    """What followed the last two ids (row 0) and the last one (row 1) in each lane, and how far to believe it.

    An entry is an id, and in its last two bits how often running it was right.
    """

    def __init__(self, lanes: int):
        both = np.arange(2 * lanes).reshape(2, lanes)
        self.base, self.by_sure = both << _CONTEXTS, both << 2
        self.entries = np.zeros(2 * lanes << _CONTEXTS, np.int32)
        self.masses = np.full(8 * lanes, _ONE >> 4, np.int32)
        self.masses[4 * lanes :] >>= 1
        self.at = self.base
        self.before = np.zeros(lanes, np.int32)

    def predict(self) -> None:
        """Sets ids (the predictions), m2, both (m2 + m1) and m0."""
        e = self.entries.take(self.at)
        self.sure, self.ids = e & 3, e >> 2
        self.by = self.by_sure + self.sure
        self.raw = self.masses.take(self.by)
        self.m2 = self.raw[0]
        m1 = ((_ONE - self.m2) * self.raw[1] >> 15) * (self.ids[0] != self.ids[1])
        self.both = self.m2 + m1
        self.m0 = _ONE - self.both

    def learn(self, x: np.ndarray, hit: np.ndarray) -> None:
        """Take the id of each lane; ``hit`` is ids == x."""
        self.entries[self.at] = np.minimum(self.sure + 1, 3) * hit + (x << 2)
        self.masses[self.by] = self.raw + (np.where(hit, _MOST, _LEAST) - self.raw >> _RATE)
        h = x * np.int32(30011)
        self.at = self.base + (np.stack((h ^ self.before, h)) >> 6 & (1 << _CONTEXTS) - 1)
        self.before = x * np.int32(20021)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Where a row of sorted numbers has one that differs from the one before."""
    first = np.ones(rows.shape, bool)
    np.not_equal(rows[:, 1:], rows[:, :-1], out=first[:, 1:])
    return first


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The code of each block of up to LONGEST ids below 65536. Blocks of like length are best given together."""
    if not blocks:
        return []
    lanes, steps = len(blocks), max(map(len, blocks))
    if steps > LONGEST:
        raise ValueError(f"a block of {steps} ids is longer than {LONGEST}")
    by_lane = np.zeros((lanes, steps), np.uint16)
    for i, b in enumerate(blocks):
        by_lane[i, : len(b)] = b
    # The place of each id among the distinct ids of its block.
    place, kinds = np.empty((steps, lanes), np.uint16), 1
    for i in range(0, lanes, _PART):
        part = by_lane[i : i + _PART]
        order = np.argsort(part, axis=1, kind="stable")
        rank = np.cumsum(_distinct(np.take_along_axis(part, order, 1)), axis=1, dtype=np.uint16) - np.uint16(1)
        kinds = max(kinds, int(rank[:, -1].max()) + 1 if steps else 1)
        own = np.empty_like(rank)
        np.put_along_axis(own, order, rank, 1)
        place[:, i : i + _PART] = own.T
    ids = np.ascontiguousarray(by_lane.T)
    del order, rank, own, part, by_lane
    counts = np.zeros((lanes, kinds), np.uint16)
    table = np.empty((lanes, kinds), np.int32)  # the first slot of an id, and below it in _BITS + 1 bits the number of its slots
    offset = np.arange(lanes, dtype=np.int32) * kinds
    new = np.zeros(lanes, np.int64)
    known, lane = _Contexts(lanes), np.arange(lanes)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _TOP, np.int64)
    out = np.empty((2 * steps + 4) * lanes, np.uint32)  # 16 bits, and above them what is carried into the item before
    at = lane.copy()

    def settle(rows: np.ndarray) -> None:
        where, a = at[rows], low[rows]
        out[where] = a >> 32
        at[rows] = where + lanes
        low[rows] = (a & _MASK32) << 16
        rng[rows] <<= 16

    last_begin = 0
    for begin, after in _stretches(steps):
        if begin == 0:
            limit = np.zeros(lanes, np.int32)
            table[:] = 0
        else:
            limit = (_SLOTS - _new_share(new, begin - last_begin)).astype(np.int32)
            for i in range(0, lanes, _PART):
                seen = place[last_begin:begin, i : i + _PART]
                wide = seen.shape[1]
                counts[i : i + wide] += np.bincount((seen + offset[:wide]).ravel(), minlength=wide * kinds).reshape(wide, kinds).astype(np.uint16)
                upto = np.cumsum(counts[i : i + wide] > 0, axis=1, dtype=np.int32)
                ends = np.cumsum(counts[i : i + wide], axis=1, dtype=np.int32) * (limit[i : i + wide] - upto[:, -1])[:, None] // np.int32(begin)
                ends += upto
                table[i : i + wide] = ends
                table[i : i + wide, 1:] += (ends[:, :-1] << _BITS + 1) - ends[:, :-1]
            new[:] = 0
        last_begin = begin
        for t in range(begin, after):
            if (t - begin) % _AHEAD == 0:
                slots = table.ravel().take(place[t : min(t + _AHEAD, after)] + offset)
                first, width = slots >> _BITS + 1, slots & (_SLOTS << 1) - 1
            x, lo, wide = ids[t].astype(np.int32), first[(t - begin) % _AHEAD], width[(t - begin) % _AHEAD]
            known.predict()
            hit = known.ids == x
            held = hit[0] | hit[1]
            fresh = (wide == 0).nonzero()[0]
            if len(fresh):
                lo[fresh], wide[fresh] = limit[fresh], _SLOTS - limit[fresh]
                fresh = fresh[~held[fresh]]
            unit = rng >> 16
            slot = unit * known.m0 >> _BITS
            held = held.nonzero()[0]
            if len(held):
                by2, m2, own = hit[0][held], known.m2[held], unit[held]
                begin_held = low[held] + np.where(by2, 0, m2) * own
                range_held = np.where(by2, m2, known.both[held] - m2) * own
            low += unit * known.both + slot * lo
            rng = slot * wide
            if len(held):
                low[held], rng[held] = begin_held, range_held
            settle((rng <= _MASK32).nonzero()[0])
            if len(fresh):
                unit = rng[fresh] >> 16
                low[fresh] += unit * x[fresh]
                rng[fresh] = unit
                settle(fresh)
                new[fresh] += 1
            known.learn(x, hit)
    del ids, place, counts, table, known
    for _ in range(3):
        out[at] = low >> 32
        low = (low & _MASK32) << 16
        at += lanes
    used = (at - lane) // lanes
    rows = out.reshape(-1, lanes)[: used.max()]
    rows[np.arange(len(rows))[:, None] >= used] = 0
    for k in range(len(rows) - 1, 0, -1):
        rows[k - 1] += rows[k] >> 16
    codes = []
    for i in range(0, lanes, _PART):
        part = rows[:, i : i + _PART].T.astype(">u2", order="C")
        codes += [c[:n].tobytes() for c, n in zip(part, used[i : i + _PART].tolist(), strict=True)]
    return codes


def _slots(ids: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the slots hold, from the ids so far: (entry of each slot in its lane, where a lane's entries begin, entries).

    An entry is an id, its first slot and its number of slots in one number; the last of a lane is that of new ids.
    """
    t, lanes = ids.shape
    ordered = np.sort(np.ascontiguousarray(ids.T), axis=1)
    first = _distinct(ordered)
    kinds = np.count_nonzero(first, axis=1)
    at = first.ravel().nonzero()[0]
    lane = np.repeat(np.arange(lanes), kinds)
    ends = np.cumsum(kinds)
    limit = _SLOTS - share
    begins = np.arange(len(at)) - (ends - kinds)[lane] + (at - lane * t) * (limit - kinds)[lane] // t
    where, more = np.arange(len(at)) + lane, ends + np.arange(lanes)
    begin, id_ = np.empty(len(at) + lanes, np.int64), np.zeros(len(at) + lanes, np.int64)
    begin[where], begin[more], id_[where] = begins, limit, ordered.ravel()[at]
    end = np.empty_like(begin)
    end[:-1] = begin[1:]
    end[more] = _SLOTS
    marks = np.zeros((lanes, _SLOTS), np.uint16)
    marks.reshape(-1)[begin + (np.repeat(np.arange(lanes), kinds + 1) << _BITS)] = 1
    marks[:, 0] = 0
    return np.cumsum(marks, axis=1, dtype=np.uint16), more - kinds, id_ | begin << 16 | end - begin << 29


def decode_blocks(codes: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block, from its code and length."""
    if not codes:
        return []
    lanes, steps = len(codes), max(lengths)
    by_lane = np.zeros((lanes, max(map(len, codes)) // 2 + 4), np.uint16)
    for i, c in enumerate(codes):
        by_lane[i, : len(c) // 2] = np.frombuffer(c, ">u2")
    words = np.ascontiguousarray(by_lane.T).ravel()
    del by_lane
    known, lane = _Contexts(lanes), np.arange(lanes)
    rng = np.full(lanes, _TOP, np.int64)
    code = words[lane].astype(np.int64) << 32 | words[lane + lanes].astype(np.int64) << 16 | words[lane + 2 * lanes]
    at = lane + 3 * lanes
    ids = np.zeros((steps, lanes), np.uint16)
    new = np.zeros(lanes, np.int64)
    base = lane << _BITS
    which, offset, entries = np.zeros(lanes << _BITS, np.uint16), lane.copy(), np.full(lanes, _SLOTS << 29, np.int64)
    limit = np.zeros(lanes, np.int64)

    def settle(rows: np.ndarray) -> None:
        where = at[rows]
        code[rows] = code[rows] << 16 | words.take(where, mode="clip")
        rng[rows] <<= 16
        at[rows] = where + lanes

    last_begin = 0
    for begin, after in _stretches(steps):
        if begin:
            share = _new_share(new, begin - last_begin)
            parts, held, limit = [], 0, _SLOTS - share
            del entries
            for i in range(0, lanes, _PART):
                which.reshape(lanes, _SLOTS)[i : i + _PART], offset[i : i + _PART], part = _slots(ids[:begin, i : i + _PART], share[i : i + _PART])
                offset[i : i + _PART] += held
                parts.append(part)
                held += len(part)
            entries = np.concatenate(parts)
            del parts, part
            new[:] = 0
        last_begin = begin
        for t in range(begin, after):
            known.predict()
            unit = rng >> 16
            rest = code - unit * known.both
            one = unit * known.m0 >> _BITS
            slot = (rest / one).astype(np.int64)
            entry = entries.take(which.take(base + slot, mode="clip") + offset, mode="clip")
            x = (entry & 0xFFFF).astype(np.int32)
            fresh = slot >= limit
            rng = (entry >> 29) * one
            held = (rest < 0).nonzero()[0]
            if len(held):
                c, own, m2 = code[held], unit[held], known.m2[held]
                by2 = c < m2 * own
                x[held] = np.where(by2, *known.ids[:, held])
                code_held = c - np.where(by2, 0, m2) * own
                rng[held] = np.where(by2, m2, known.both[held] - m2) * own
                fresh[held] = False
            code = rest - (entry >> 16 & 0x1FFF) * one
            if len(held):
                code[held] = code_held
            settle((rng <= _MASK32).nonzero()[0])
            fresh = fresh.nonzero()[0]
            if len(fresh):
                unit = rng[fresh] >> 16
                v = (code[fresh] / unit).astype(np.int64)
                x[fresh] = v
                code[fresh] -= unit * v
                rng[fresh] = unit
                settle(fresh)
                new[fresh] += 1
            ids[t] = x
            known.learn(x, known.ids == x)
    return [ids[:n, i].copy() for i, n in enumerate(lengths)]
