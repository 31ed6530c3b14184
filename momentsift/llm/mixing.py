"""Binary predictors over hashed contexts, mixed online in the logistic domain; numpy only.

A symbol is the bits of its Huffman code. Each bit is predicted from the counts
that its code node has in contexts of 0, 1, ... preceding symbols (order 0 by
the node itself, longer ones by a hash), and of the last frequent symbol, which
tells the language or the kind of text from far behind. A gate, chosen by how much the two
longest contexts have been seen, names the set of weights that adds up the
predictors' log odds; the sum is refined by a table of what came of such sums.
Weights are corrected after every chunk of a sequence, never within it, so that
all sequences of a batch move on together and every bit is predicted from what
stands before it.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np

#: What a count starts from; log odds at most; buckets of the refining table; classes of how often a context was seen.
PRIOR, MOST, BUCKETS, SEEN = 0.4, 9.0, 24, (1, 4, 24)
#: Symbols of a chunk; how far a chunk moves the weights, and the bits after which it moves them half as far.
CHUNK, RATE, SLOW = 128, 4.0, 1500.0
GATES = (len(SEEN) + 1) ** 2
#: Symbols whose bits are counted at a time.
PIECE = 200_000


class Codes:
    """Huffman codes of symbols 0, 1, ...: flat lists of (node, bit) from the root, and where each symbol's begins."""

    def __init__(self, weights: np.ndarray):
        n, tie = len(weights), count()
        heap = [(float(w), next(tie), k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int8)
        for node in range(n, 2 * n - 1):
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = node
            side[y] = 1
            heapq.heappush(heap, (a + b, next(tie), node))
        root = 2 * n - 2
        nodes, bits, first = [], [], [0]
        for k in range(n):
            at, path = k, []
            while at != root:
                path.append((parent[at] - n, side[at]))
                at = parent[at]
            nodes += [x for x, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
            first.append(len(nodes))
        self.nodes, self.node, self.bit, self.first = n - 1, np.array(nodes, np.int32), np.array(bits, np.int8), np.array(first, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


class Mixture:
    """``orders`` contexts beyond order 0, and one of the last symbol in ``frequent``; each has 2 ** ``table_bits`` slots.

    The tables of hashed contexts come first, the nodes of order 0 last.
    """

    def __init__(self, codes: Codes, orders: int, table_bits: int, frequent: range = range(0)):
        self.codes, self.orders, self.table_bits, self.frequent = codes, orders, table_bits, frequent
        self.inputs = 1 + orders + bool(frequent)
        self.slots = codes.nodes + ((self.inputs - 1) << table_bits)
        self.mask = np.uint32((1 << table_bits) - 1)
        self.hashed_node = (_mixed(codes.node.astype(np.uint32) + np.uint32(1)) & self.mask).astype(np.int64)
        self.own_node = codes.node.astype(np.int64) + ((self.inputs - 1) << table_bits)
        self.weights = np.full((GATES, self.inputs), 1.0 / self.inputs)
        self.refined = np.tile(1 / (1 + np.exp(-self._centres())), (GATES, 1))

    @staticmethod
    def _centres() -> np.ndarray:
        return (np.arange(BUCKETS) + 0.5) * (2 * MOST / BUCKETS) - MOST

    def set_counts(self, zeros: np.ndarray, ones: np.ndarray) -> None:
        """Predictors as log odds, whose last two bits tell how often the context was seen."""
        odds = np.clip(np.log((ones + PRIOR) / (zeros + PRIOR)), -MOST, MOST).astype(np.float32)
        seen = np.searchsorted(SEEN, zeros.astype(np.int64) + ones, "right").astype(np.uint32)
        self.odds = ((odds.view(np.uint32) & ~np.uint32(3)) | seen).view(np.float32)

    def set_learnt(self, moved: np.ndarray) -> None:
        """From the sum of what tasks have learnt (see ``learnt``); where none did, all stays as it was."""
        w = moved[: self.weights.size].reshape(self.weights.shape)
        n, met = moved[self.weights.size], moved[self.weights.size + 1 :].reshape(2, GATES, BUCKETS)
        if n:
            self.weights = w / n
        first = 1 / (1 + np.exp(-self._centres()))
        self.refined = (met[1] + 8 * first) / (met.sum(0) + 8)

    def _last_frequent(self, symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """For each place the last symbol before it in its sequence that is in ``frequent``, from 1; 0 if there is none."""
        place = np.arange(len(symbols))
        met = (symbols >= self.frequent.start) & (symbols < self.frequent.stop)
        last = np.maximum.accumulate(np.where(np.concatenate([[False], met[:-1]]), place - 1, -1))
        return np.where(last >= begin, symbols[last] - self.frequent.start + 1, 0)

    def contexts(self, symbols: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each hashed context the place in its table of what stands before; ``first`` tells where sequences begin."""
        if not len(symbols):
            return [np.zeros(0, np.int64)] * (self.inputs - 1)
        place = np.arange(len(symbols))
        begin = np.maximum.accumulate(np.where(first, place, 0))
        before, hashes, h = place - begin, [], np.zeros(len(symbols), np.uint32)
        if self.frequent:
            hashes.append(self._of_frequent(self._last_frequent(symbols, begin)))
        for m in range(1, self.orders + 1):
            last = np.zeros(len(symbols), np.uint32)
            last[m:] = symbols[:-m] + 2
            last[before < m] = 1
            h = _mixed(h * np.uint32(0x01000193) + last + np.uint32(m << 20))
            hashes.append(h)
        return [(h & self.mask).astype(np.int64) | (k << self.table_bits) for k, h in enumerate(hashes)]

    @staticmethod
    def _of_frequent(which: np.ndarray) -> np.ndarray:
        return _mixed(which.astype(np.uint32) + np.uint32(7 << 20))

    def _bits(self, symbols: np.ndarray, hashes: list[np.ndarray], alone: bool = True) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Bits of each symbol's code, the bits, and for each context their slots, order 0 last (unless not ``alone``)."""
        start = self.codes.first[symbols]
        size = self.codes.first[symbols + 1] - start
        end = np.cumsum(size)
        at = np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)
        node = self.hashed_node.take(at, mode="clip")
        slots = [np.repeat(h, size) ^ node for h in hashes]
        if alone:
            slots.append(self.own_node.take(at, mode="clip"))
        return size, self.codes.bit.take(at, mode="clip"), slots

    def run(self, symbols: np.ndarray, offsets: np.ndarray, own: bool, met: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """log2 probability of each sequence ``symbols[offsets[i]:offsets[i + 1]]``, and how many bits there were.

        With ``own`` every sequence goes on from the learnt weights for itself,
        by what it adds to the weights of all gates; otherwise all of them move
        ``self.weights``, each gate for itself. ``met`` gathers what came of the
        sums, for the refining table.
        """
        n, sizes = len(offsets) - 1, np.diff(offsets)
        first = np.zeros(len(symbols), bool)
        first[offsets[:-1][sizes > 0]] = True
        hashes = self.contexts(symbols, first)
        weights = np.ascontiguousarray(self.weights.T.astype(np.float32))
        added, seen_bits = np.zeros((self.inputs, n), np.float32), np.zeros(n if own else GATES)
        total, bits = np.zeros(n), 0
        refined = self.refined.astype(np.float32).ravel()
        for step in range(-(-int(sizes.max(initial=0)) // CHUNK)):
            alive = np.flatnonzero(sizes > step * CHUNK)
            length = np.minimum(sizes[alive] - step * CHUNK, CHUNK)
            ends = np.cumsum(length)
            at = np.repeat(offsets[alive] + step * CHUNK - ends + length, length) + np.arange(ends[-1])
            size, bit, slots = self._bits(symbols[at], [h[at] for h in hashes])
            if not len(bit):
                continue
            edges = np.concatenate([[0], np.cumsum(size)[ends - 1]])
            odds = [self.odds.take(s, mode="clip") for s in slots]
            long, middle = (odds[k].view(np.int32) & 3 for k in ((-2, -3) if self.inputs > 2 else (-1, -1)))
            gate = (long * (len(SEEN) + 1) + middle).astype(np.int64)
            t = np.zeros(len(bit), np.float32)
            for k, x in enumerate(odds):
                w = weights[k].take(gate, mode="clip")
                if own and step:
                    w += np.repeat(added[k, alive], np.diff(edges))
                t += w * x
            np.clip(t, -MOST + 1e-3, MOST - 1e-3, out=t)
            p = 1 / (1 + np.exp(-t))
            bucket = ((t + np.float32(MOST)) * np.float32(BUCKETS / (2 * MOST))).astype(np.int64) + gate * BUCKETS
            final = (p + refined.take(bucket, mode="clip")) * np.float32(0.5)
            np.subtract(1, final, out=final, where=bit == 0)
            total[alive] += np.add.reduceat(np.log2(final), edges[:-1])
            bits += len(bit)
            err = bit - p
            if own:
                seen_bits[alive] += np.diff(edges)
                pace = RATE / (seen_bits[alive] + SLOW)
                for k, x in enumerate(odds):
                    added[k, alive] += pace * np.add.reduceat(err * x, edges[:-1])
            else:
                seen_bits += np.bincount(gate, minlength=GATES)
                for k, x in enumerate(odds):
                    weights[k] += RATE * np.bincount(gate, weights=err * x, minlength=GATES) / (seen_bits + SLOW)
            if met is not None:
                met += np.bincount(bucket + bit.astype(np.int64) * (GATES * BUCKETS), minlength=met.size).reshape(met.shape)
        if not own:
            self.weights = weights.T.astype(np.float64)
        return total, bits

    def learnt(self, bits: int, met: np.ndarray) -> np.ndarray:
        """What a task has learnt, such that sums over tasks can be taken: weights by bits, bits, what came of the sums."""
        return np.concatenate([self.weights.ravel() * bits, [bits], met.ravel()])


class BitCounts:
    """Counts of zeros and ones in all slots of a mixture.

    Order 0 and the last frequent symbol have few contexts, so their symbols are
    counted first and become bits at the end; the others are counted bit by bit.
    """

    def __init__(self, mixture: Mixture):
        self.mixture, self.n = mixture, len(mixture.codes.first) - 1
        self.alone = np.zeros(self.n, np.int64)
        self.after = np.zeros((len(mixture.frequent) + 1) * self.n if mixture.frequent else 0, np.int32)
        self.table = np.zeros((2, mixture.slots), np.int32)

    def add(self, symbols: np.ndarray, first: np.ndarray) -> None:
        m = self.mixture
        if not len(symbols):
            return
        hashes = m.contexts(symbols, first)
        self.alone += np.bincount(symbols, minlength=self.n)
        if m.frequent:
            begin = np.maximum.accumulate(np.where(first, np.arange(len(symbols)), 0))
            self.after += np.bincount(m._last_frequent(symbols, begin) * self.n + symbols, minlength=len(self.after)).astype(np.int32)
            hashes = hashes[1:]
        if not hashes:
            return
        # Only their tables, which stand together, are counted over.
        low, high = bool(m.frequent) << m.table_bits, (m.inputs - 1) << m.table_bits
        for a in range(0, len(symbols), PIECE):
            _, bit, slots = m._bits(symbols[a : a + PIECE], [h[a : a + PIECE] for h in hashes], False)
            ones = bit.astype(np.int64) * (high - low) - low
            both = np.bincount(np.concatenate([s + ones for s in slots]), minlength=2 * (high - low))
            self.table[:, low:high] += both.reshape(2, -1).astype(np.int32)

    def _count(self, places: np.ndarray, weights: np.ndarray | None = None) -> None:
        both = np.bincount(places, weights=weights, minlength=2 * self.mixture.slots)
        self.table += both.reshape(2, -1).astype(np.int32)

    def counts(self) -> np.ndarray:
        """(2, slots); to be asked for once."""
        m = self.mixture
        symbols = np.flatnonzero(self.alone)
        size, bit, slots = m._bits(symbols, [])
        self._count(slots[-1] + bit.astype(np.int64) * m.slots, np.repeat(self.alone[symbols], size))
        pairs = np.flatnonzero(self.after)
        if len(pairs):
            size, bit, slots = m._bits(pairs % self.n, [(m._of_frequent(pairs // self.n) & m.mask).astype(np.int64)], False)
            self._count(slots[0] + bit.astype(np.int64) * m.slots, np.repeat(self.after[pairs], size))
        return self.table
