"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks of about ``BLOCK_IDS``. Each block is coded on its own: model and coder
start afresh, and a CRC-32 of its ids guards it. Of each id the model predicts

* by order 2 (the two ids before) and order 1 (the id before) the id that has followed most
  steadily, with a count of its successes;
* by order 0 the counts of all ids of the block so far, for ids that neither order expects.

Which order is right is one symbol: its probabilities are counted for each pair of successes and
agreement, so the evidence of both orders is mixed by what it has been worth so far. Unexpected
ids are coded by their order-0 counts in the share that is left.

A block's ids are dealt in runs to up to ``LANES`` lanes, which share one model: a step codes one id
of every lane with the model as it stood before the step, then the model learns all of them. So
NumPy works on wide vectors and the model still learns from the whole block. Each lane has a range
coder of 63 bits; the lanes' 32-bit digits share one stream, in the order in which a decoder asks for
them. All arithmetic is on integers: any machine decodes what another encoded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LTOK\x02"
BLOCK_IDS, LANES, LEAST_STEPS = 1 << 21, 4096, 256
MOST_VOCABULARY = 1 << 20
_HEAD, _BLOCK = struct.Struct("<II"), struct.Struct("<IIIII")
_SLOTS = 1 << 18  # contexts of order 2 in a block
_ID, _SURE = 20, 15  # bits of an id in a table's entry; most successes counted
_MIX = 12  # bits of the scale of the choice between orders
_LEARN = 24  # weight of an observed choice against the prior
_U = np.uint64
_LOW, _SMALL = _U((1 << 31) - 1), _U(1 << 31)


class _Model:
    """Counts of one block over dense ids 0 to ``size`` - 1."""

    def __init__(self, size: int):
        self.size = size
        self.scale0 = max(14, size.bit_length() + 2)
        self.one, self.two = np.zeros(size, np.int64), np.zeros(_SLOTS, np.int64)
        sure = np.arange(1 << 9)
        prior = np.stack([2 + 4 * (sure >> 5), 2 + 2 * ((sure >> 1) & 15), 16 + 0 * sure], 1)
        self.choices = prior.reshape(-1).astype(np.int64)
        self.seen, self.steps = np.zeros(size, np.int64), 0
        self.pending: list[np.ndarray] = []
        self._mix()
        self._order0()

    def _mix(self) -> None:
        """Start and size of each choice, of each row, in a scale of 2^_MIX."""
        n = self.choices.reshape(-1, 3)
        room = (1 << _MIX) - 3 * 16
        size = 16 + n * room // n.sum(1, keepdims=True)
        size[:, 2] += (1 << _MIX) - size.sum(1)
        start = np.cumsum(size, 1) - size
        self.start2, self.start1 = start[:, 1].copy(), start[:, 2].copy()
        self.span = (start.astype(_U) << _U(32) | size.astype(_U)).reshape(-1)

    def _order0(self) -> None:
        """Start and size of each id by the counts so far, in a scale of 2^scale0."""
        scale = 1 << self.scale0
        total = int(self.seen.sum())
        size = 1 + self.seen * (scale - self.size) // total if total else np.full(self.size, scale // self.size)
        size[int(size.argmax())] += scale - int(size.sum())
        self.size0 = size.astype(_U)
        self.start0 = (np.cumsum(size) - size).astype(_U)

    def predict(self, x1: np.ndarray, x2: np.ndarray) -> None:
        self.at2 = (x1 * 2654435761 + x2 * 2246822519 >> 13) & (_SLOTS - 1)
        self.at1 = x1
        self.e1, self.e2 = self.one.take(x1), self.two.take(self.at2)
        self.p1, self.p2 = self.e1 & ((1 << _ID) - 1), self.e2 & ((1 << _ID) - 1)
        self.c1, self.c2 = self.e1 >> _ID, self.e2 >> _ID
        self.row = (self.c2 << 5) + (self.c1 << 1) + (self.p1 == self.p2)

    def update(self, x: np.ndarray, choice: np.ndarray, escaped: np.ndarray) -> None:
        """Learn one step's ids; of lanes with one context the last one's entry stays."""
        self.choices += _LEARN * np.bincount(choice, minlength=len(self.choices))
        for table, at, e, p, c in ((self.one, self.at1, self.e1, self.p1, self.c1), (self.two, self.at2, self.e2, self.p2, self.c2)):
            half = c >> 1
            lost = np.where(half > 0, p + (half << _ID), x)
            table[at] = np.where(x == p, e + ((c < _SURE).astype(np.int64) << _ID), lost)
        self.pending.append(x[escaped])
        self.steps += 1
        # Often at first, then every eighth step: the tables cost more than a step's ids.
        if self.steps < 8 or self.steps % 8 == 0:
            self.seen += np.bincount(np.concatenate(self.pending), minlength=self.size)
            self.pending = []
            self._mix()
            self._order0()


def _shape(n: int) -> tuple[int, int]:
    """Steps and lanes of a block of n ids."""
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    return -(-n // lanes), lanes


def _encode_block(ids: np.ndarray) -> bytes:
    steps, lanes = _shape(len(ids))
    present = np.zeros(int(ids.max()) + 1, bool)
    present[ids] = True
    alphabet = np.flatnonzero(present)
    grid = np.zeros(lanes * steps, np.int64)
    grid[: len(ids)] = (np.cumsum(present) - 1).take(ids)
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    m = _Model(len(alphabet))
    low, span = np.zeros(lanes, _U), np.full(lanes, _U(1 << 63))
    digits, asked = [], []  # of each step: digits that left the coders, and their lanes
    x1 = x2 = np.zeros(lanes, np.int64)
    shift0, whole0 = _U(m.scale0), _U(1 << m.scale0)
    zero = _U(0)
    for t in range(steps):
        x = grid[t]
        m.predict(x1, x2)
        right2 = x == m.p2
        escaped = ~(right2 | (x == m.p1))
        choice = m.row * 3 + np.where(right2, 0, 1 + escaped)
        part = m.span.take(choice)
        r = span >> _U(_MIX)
        low += r * (part >> _U(32))
        r = (r * (part & _U(0xFFFFFFFF))) >> shift0
        low += np.where(escaped, r * m.start0.take(x), zero)
        span = r * np.where(escaped, m.size0.take(x), whole0)
        small = np.flatnonzero(span < _SMALL)
        if len(small):
            a = low[small]
            digits.append(a >> _U(31))
            asked.append(small)
            low[small] = (a & _LOW) << _U(32)
            span[small] <<= _U(32)
        m.update(x, choice, escaped)
        x2, x1 = x1, x
    every = np.arange(lanes)
    digits += [low >> _U(31), (low & _LOW) << _U(1)]
    asked += [every, every]
    lane, value = np.concatenate(asked), np.concatenate(digits)
    # By lane, in the order of time, to pass carries on; a carry into the first digit cannot occur.
    order = np.argsort(lane.astype(np.uint16), kind="stable")
    value = value[order]
    while True:
        over = np.flatnonzero(value >> _U(32))
        if not len(over):
            break
        value[over] &= _U(0xFFFFFFFF)
        value[over - 1] += _U(1)
    count = np.bincount(lane, minlength=lanes)
    first = np.cumsum(count) - count
    # A decoder starts with two digits of each lane and asks for the third when the first has left.
    place = np.empty(len(lane), np.int64)
    place[order] = np.arange(len(lane))
    body = np.concatenate([value[first], value[first + 1], value[place[: len(lane) - 2 * lanes] + 2]]).astype("<u4").tobytes()
    names = zlib.compress(np.diff(alphabet, prepend=0).astype("<u4").tobytes(), 1)
    return _BLOCK.pack(len(ids), len(alphabet), len(names), len(body), _checksum(ids, names + body)) + names + body


def _checksum(ids: np.ndarray, coded: bytes) -> int:
    """Of the ids and of their code: a changed bit is found even where the ids do not depend on it."""
    return zlib.crc32(coded, zlib.crc32(ids.astype("<u4").tobytes()))


def _decode_block(n: int, alphabet: np.ndarray, body: np.ndarray) -> np.ndarray:
    steps, lanes = _shape(n)
    m = _Model(len(alphabet))
    body = body.astype(_U)
    if len(body) < 2 * lanes:
        raise ValueError("a block is cut short")
    code, span, at = (body[:lanes] << _U(31)) | (body[lanes : 2 * lanes] >> _U(1)), np.full(lanes, _U(1 << 63)), 2 * lanes
    spare = body[lanes : 2 * lanes] & _U(1)  # the code's next bit: 63 bits are held of two digits
    out = np.empty((steps, lanes), np.int64)
    x1 = x2 = np.zeros(lanes, np.int64)
    shift0 = _U(m.scale0)
    table = None
    zero = _U(0)
    for t in range(steps):
        m.predict(x1, x2)
        if table is None or not m.pending:
            table = np.repeat(np.arange(m.size), m.size0.astype(np.int64))
        r = span >> _U(_MIX)
        v = np.minimum(code // r, _U((1 << _MIX) - 1)).astype(np.int64)
        right2 = v < m.start2.take(m.row)
        escaped = v >= m.start1.take(m.row)
        choice = m.row * 3 + np.where(right2, 0, 1 + escaped)
        part = m.span.take(choice)
        code -= r * (part >> _U(32))
        r = (r * (part & _U(0xFFFFFFFF))) >> shift0
        x = np.where(right2, m.p2, m.p1)
        span = r << shift0
        out_of = np.flatnonzero(escaped)
        if len(out_of):
            re = r[out_of]
            xe = table.take(np.minimum(code[out_of] // re, _U(len(table) - 1)).astype(np.int64))
            x[out_of] = xe
            code[out_of] -= re * m.start0.take(xe)
            span[out_of] = re * m.size0.take(xe)
        small = np.flatnonzero(span < _SMALL)
        if len(small):
            d = body[at : at + len(small)]
            if len(d) < len(small):
                raise ValueError("a block is cut short")
            code[small] = (code[small] << _U(32)) | (spare[small] << _U(31)) | (d >> _U(1))
            spare[small] = d & _U(1)
            span[small] <<= _U(32)
            at += len(small)
        out[t] = x
        m.update(x, choice, escaped)
        x2, x1 = x1, x
    return alphabet[out.T.reshape(-1)[:n]]


def encode(ids: np.ndarray, vocabulary: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A frame: all blocks of ``ids``, which are below ``vocabulary`` (at most 2^20)."""
    if vocabulary > MOST_VOCABULARY or len(ids) and (int(ids.max()) >= vocabulary or int(ids.min()) < 0):
        raise ValueError("ids do not fit the vocabulary")
    ids = np.asarray(ids).astype(np.uint32)
    blocks = np.array_split(ids, max(1, round(len(ids) / block_ids))) if len(ids) else []
    return MAGIC + _HEAD.pack(len(ids), len(blocks)) + b"".join(map(_encode_block, blocks))


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame, as uint32; ValueError if a block is cut or fails its checksum."""
    if frame[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token frame")
    count, blocks = _HEAD.unpack_from(frame, len(MAGIC))
    at, out = len(MAGIC) + _HEAD.size, [np.empty(0, np.uint32)]
    for k in range(blocks):
        n, size, names, length, crc = _BLOCK.unpack_from(frame, at)
        at += _BLOCK.size
        try:
            alphabet = np.cumsum(np.frombuffer(zlib.decompress(frame[at : at + names]), "<u4"), dtype=np.uint32)
        except zlib.error as e:
            raise ValueError(f"block {k} has no table of ids") from e
        if len(alphabet) != size or at + names + length > len(frame):
            raise ValueError(f"block {k} is cut short")
        ids = _decode_block(n, alphabet, np.frombuffer(frame, "<u4", length // 4, at + names))
        if _checksum(ids, frame[at : at + names + length]) != crc:
            raise ValueError(f"block {k} fails its checksum")
        out.append(ids)
        at += names + length
    ids = np.concatenate(out)
    if len(ids) != count:
        raise ValueError("a frame is cut short")
    return ids
