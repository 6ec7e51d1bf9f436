"""Range coding of id sequences below 65,536 with mixed orders 0 to 2, many blocks side by side.

The ids of a call share one model, counted from them first and stored ahead of the blocks: order 0 has the
share of every id; orders 1 and 2 have, for contexts of one id and of two hashed ids, the id that mostly
follows and how sure that is. With the model any block decodes on its own. Each block adapts the hit
rates of the two predictions by confidence, and where they agree mixes them by a weight that follows
the better one. An id takes one step of the coder: the order-2 prediction, the order-1 prediction, or
neither and then the id by order 0. All arithmetic is on integers, so blocks decode alike on any
machine. numpy works on one id of every block at a time.
"""

import zlib

import numpy as np

BLOCK = 2048
ONE = 4096
#: Order-0 shares add up to this; contexts of order 2 are hashed to so many slots.
TOTAL, SLOTS = 1 << 20, 1 << 16
_ONE_BITS, _TOTAL_BITS, _WORD = np.uint64(12), np.uint64(20), np.uint64(32)
_FULL, _LEAST, _MASK = np.uint64((1 << 64) - 1), np.uint64(1 << 32), np.uint64((1 << 32) - 1)
_LAST, _LAST_ID, _ID_BEFORE = np.uint64(TOTAL - 1), np.uint16(40503), np.uint16(30011)
_HIT, _ID, _SURE, _SLOW = np.int32(ONE), np.int32(0xFFFF), np.int32(16), np.int32(5)
_REST, _ONE_SHIFT = np.int32(ONE - 16), np.int32(12)
#: A prediction is kept that was right so often, and in at least one of so many cases.
_HITS, _CASES = 4, 16
_RATES = np.array([16, 350, 900, 1450, 2000, 2600, 3150, 3800], np.int32)


def _pair(last, before):
    """The slot of an order-2 context, from 16-bit ids: the product wraps."""
    return last * _LAST_ID + before * _ID_BEFORE


def _prediction(contexts, ids):
    """Per context the id that mostly follows, with the confidence in the bits above it."""
    keys = contexts.astype(np.uint32)
    keys <<= 16
    keys |= ids
    keys.sort()
    starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
    counts = np.diff(np.append(starts, len(keys)))
    kinds = keys[starts]
    of = kinds >> 16
    first = np.append(0, np.flatnonzero(of[1:] != of[:-1]) + 1)
    cases, hits = np.add.reduceat(counts, first), np.maximum.reduceat(counts, first)
    kept = np.flatnonzero((hits >= _HITS) & (hits * _CASES >= cases))
    table = np.zeros(SLOTS, np.int32)
    groups = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(of))))
    best = np.flatnonzero(counts == hits[groups])
    said = np.zeros(len(first), np.int64)
    said[groups[best][::-1]] = kinds[best][::-1] & 0xFFFF  # of several the smallest id
    sure = np.minimum(1 + hits[kept] * 7 // cases[kept], 7)
    table[of[first[kept]]] = said[kept] | (sure << 16)
    return table


class Model:
    """Order-0 shares and the predictions of orders 1 and 2."""

    def __init__(self, shares, one, two):
        self.shares, self.one, self.two = shares, one, two
        self.size = shares.astype(np.uint64)
        self.start = np.cumsum(self.size) - self.size

    @classmethod
    def count(cls, ids, block):
        counts = np.bincount(ids, minlength=1 << 16)
        found = counts > 0
        shares = np.where(found, 1 + counts * (TOTAL - found.sum()) // len(ids), 0)
        shares[np.argmax(shares)] += TOTAL - shares.sum()
        last = np.concatenate((np.zeros(1, np.uint16), ids[:-1]))
        last[::block] = 0
        before = np.concatenate((np.zeros(1, np.uint16), last[:-1]))
        before[::block] = 0
        return cls(shares, _prediction(last, ids), _prediction(_pair(last, before), ids))

    def symbols(self):
        """The id at each place of order 0."""
        return np.repeat(np.arange(1 << 16, dtype=np.uint16), self.shares)

    def to_bytes(self):
        parts, sizes = [], []
        for table in (self.shares, self.one, self.two):
            at = np.flatnonzero(table)
            sizes.append(len(at))
            parts.append(np.diff(at, prepend=0).astype("<u2").tobytes())
            parts += [(table[at] >> k & 0xFF).astype(np.uint8).tobytes() for k in (0, 8, 16)]
        return zlib.compress(np.array(sizes, "<u4").tobytes() + b"".join(parts))

    @classmethod
    def from_bytes(cls, data):
        data = zlib.decompress(data)
        sizes, begin, tables = np.frombuffer(data, "<u4", 3).tolist(), 12, []
        for n in sizes:
            table = np.zeros(1 << 16, np.int32)
            at = np.cumsum(np.frombuffer(data, "<u2", n, begin), dtype=np.int64)
            planes = np.frombuffer(data, np.uint8, 3 * n, begin + 2 * n).reshape(3, n)
            planes = planes.astype(np.int32)
            table[at] = planes[0] | planes[1] << 8 | planes[2] << 16
            tables.append(table)
            begin += 5 * n
        return cls(*tables)


class _Range:
    """Carry-less range coder intervals, one per block; at most one word leaves per step."""

    def __init__(self, n, model):
        self.low = np.zeros(n, np.uint64)
        self.width = np.full(n, _FULL, np.uint64)
        self.size, self.start = model.size, model.start

    def _ends(self, m, two, both):
        """Where the intervals of the predictions end, and the unit of order 0 in what is left."""
        width = self.width[:m]
        unit = width >> _ONE_BITS
        first, second = unit * two, unit * both
        return first, second, (width - second) >> _TOTAL_BITS

    def _narrow(self, m, ids, hit, other, first, second, unit):
        add = second + unit * self.start.take(ids)
        width = unit * self.size.take(ids)
        told = np.flatnonzero(other)
        add[told] = start = first.take(told)
        width[told] = second.take(told) - start
        told = np.flatnonzero(hit)
        add[told], width[told] = 0, first.take(told)
        self._move(m, add)
        self.width[:m] = width
        go = np.flatnonzero(width < _LEAST)
        if len(go):
            low = self.low.take(go)
            # Of an interval across the end of a word, the part before it is kept.
            kept = np.minimum(width.take(go), _LEAST - (low & _MASK))
            self._shift(go, low)
            self.low[go], self.width[go] = low << _WORD, kept << _WORD


class Encoder(_Range):
    def __init__(self, n, steps, model):
        super().__init__(n, model)
        self.data, self.at = np.zeros((n, steps + 1), ">u4"), np.zeros(n, np.int64)

    def _move(self, m, add):
        self.low[:m] += add

    def _shift(self, go, low):
        at = self.at.take(go)
        self.data[go, at] = low >> _WORD
        self.at[go] = at + 1

    def code(self, m, two, both, said, said_one, ids):
        hit = ids == said
        self._narrow(m, ids, hit, ids == said_one, *self._ends(m, two, both))
        return ids, hit

    def finish(self):
        self._shift(np.arange(len(self.low)), self.low + _MASK)
        return [self.data[i, :n].tobytes() for i, n in enumerate(self.at.tolist())]


class Decoder(_Range):
    def __init__(self, blocks, model):
        super().__init__(len(blocks), model)
        blocks = [b + bytes(8 + -len(b) % 4) for b in blocks]
        ends = np.cumsum([len(b) // 4 for b in blocks])
        self.data = np.frombuffer(b"".join(blocks), ">u4").astype(np.uint64)
        self.at, self.last = np.concatenate(([0], ends[:-1])) + 2, ends - 1
        self.value = self.data[self.at - 2] << _WORD | self.data[self.at - 1]  # above low
        self.symbols = model.symbols()

    def _move(self, m, add):
        self.low[:m] += add
        self.value[:m] -= add

    def _shift(self, go, low):
        at = self.at.take(go)
        word = self.data.take(np.minimum(at, self.last.take(go)))  # damage must not run on
        self.value[go] = self.value.take(go) << _WORD | word
        self.at[go] = at + 1

    def code(self, m, two, both, said, said_one, ids):
        first, second, unit = self._ends(m, two, both)
        value = self.value[:m]
        hit, other = value < first, value < second
        place = np.minimum((value - second) // unit, _LAST).astype(np.int64)
        ids = self.symbols.take(place).astype(np.int32)
        np.copyto(ids, said_one, where=other)
        np.copyto(ids, said, where=hit)
        self._narrow(m, ids, hit, other, first, second, unit)
        return ids, hit


def _run(coder, model, ids, lengths):
    """Code ids [step, block] (None when decoding) of blocks in order of falling length."""
    n, steps = len(lengths), int(lengths[0])
    out = np.zeros((steps, n), np.uint16)
    lanes = np.arange(n) * len(_RATES)
    rate_one, rate_two = np.tile(_RATES, n), np.tile(_RATES, n)
    weight = np.full(n, 8, np.int32)
    before, last = np.zeros(n, np.uint16), np.zeros(n, np.uint16)
    counts = np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()
    for t, m in enumerate(counts):
        one = model.one.take(last[:m])
        two = model.two.take(_pair(last[:m], before[:m]))
        said_one, said = one & _ID, two & _ID
        cell_one, cell_two = lanes[:m] + (one >> _SURE), lanes[:m] + (two >> _SURE)
        chance_one, chance = rate_one.take(cell_one), rate_two.take(cell_two)
        same = said_one == said
        agree = np.flatnonzero(same)
        w, gap = weight.take(agree), chance_one.take(agree) - chance.take(agree)
        first = chance.copy()
        first[agree] += gap * (16 - w) >> 4
        np.minimum(np.maximum(first, 16, out=first), ONE - 64, out=first)
        both = np.maximum((_REST - first) * chance_one >> _ONE_SHIFT, 1)
        both[agree] = 0
        both += first
        x, hit = coder.code(m, first.astype(np.uint64), both.astype(np.uint64), said, said_one,
                            None if ids is None else ids[t, :m])
        out[t, :m] = x
        rate_two[cell_two] = chance + ((hit * _HIT - chance) >> _SLOW)
        counted = same | ~hit
        rate_one[cell_one] = chance_one + (((x == said_one) * _HIT - chance_one) >> _SLOW) * counted
        # Where both say the same, the weight follows the one that was nearer to what came.
        nearer = np.sign(gap)
        w += np.where(hit.take(agree), -nearer, nearer)
        weight[agree] = np.minimum(np.maximum(w, 1), 15)
        before[:m], last[:m] = last[:m], out[t, :m]
    return out


def encode_blocks(ids: np.ndarray, block=BLOCK) -> list:
    """The model, then coded blocks of `block` ids each, the last one shorter."""
    if len(ids) == 0:
        return []
    if int(ids.max()) >= 1 << 16 or int(ids.min()) < 0:
        raise ValueError("ids must be below 65536")
    n = -(-len(ids) // block)
    padded = np.zeros(n * block, np.uint16)
    padded[:len(ids)] = ids
    lengths = np.full(n, block, np.int64)
    lengths[-1] = len(ids) - (n - 1) * block
    grid = padded.reshape(n, block).T[:int(lengths.max())].astype(np.int32, order="C")
    model = Model.count(padded[:len(ids)], block)
    coder = Encoder(n, len(grid), model)
    _run(coder, model, grid, lengths)  # only the last block is shorter: the order is right
    return [model.to_bytes(), *coder.finish()]


def decode_blocks(coded, lengths) -> np.ndarray:
    """The ids of a model and blocks that were coded with it, one after the other."""
    if len(lengths) == 0:
        return np.zeros(0, np.uint16)
    model, blocks = Model.from_bytes(coded[0]), coded[1:]
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    out = _run(Decoder([blocks[i] for i in order], model), model, None, falling)
    parts = [None] * len(blocks)
    for place, i in enumerate(order.tolist()):
        parts[i] = out[:int(falling[place]), place]
    return np.concatenate(parts)
