"""Logistic context mixing of binary decisions: adaptive counts, gated weights that learn online, and a last refinement.

Rows are decisions, each of a sequence (a document) and in its order there. Everything that adapts looks at earlier rows
of the same sequence only, so a row's probability could be computed before its bit is known.
"""

from __future__ import annotations

import numpy as np

#: Decisions of a sequence that share weights before these learn again: so many at first, twice as many each time, up to a bound.
FIRST, MOST = 32, 4096
RATE = 0.02
#: How many observations the start of a count is worth.
WORTH = 8.0
LIMIT = 12.0


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -LIMIT, LIMIT)))


def earlier(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many earlier rows have its key, and how many of their bits are one."""
    order = np.argsort(keys, kind="stable")
    same = np.r_[False, keys[order[1:]] == keys[order[:-1]]] if len(keys) else np.empty(0, dtype=bool)
    at = np.arange(len(keys))
    first = np.maximum.accumulate(np.where(same, 0, at))
    before = np.cumsum(bits[order], dtype=np.float64) - bits[order]
    seen, ones = np.empty(len(keys)), np.empty(len(keys))
    seen[order], ones[order] = at - first, before - before[first]
    return seen, ones


def adapted(keys: np.ndarray, bits: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probabilities of a one: `start`, worth WORTH observations, and what the sequence has shown of the key so far."""
    seen, ones = earlier(keys, bits)
    return (start * WORTH + ones) / (WORTH + seen)


def whole_rounds(steps: int) -> int:
    """How many of a sequence's first `steps` decisions are whole rounds, once these are of one length; else none."""
    return 0 if steps < FIRST * 127 else FIRST * 127 + (steps - FIRST * 127) // MOST * MOST


def mix(sequence: np.ndarray, step: np.ndarray, gate: np.ndarray, inputs: np.ndarray, bits: np.ndarray, gates: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of a one from the weighted sum of `inputs` (rows, predictors; log odds).

    Each sequence has weights for each gate, one at first; after each round of its decisions they move along the gradient.
    `weights` of one sequence that goes on are taken as they are, and moved in place.
    """
    rounds = np.where(step < FIRST * 127, np.floor(np.log2(step / FIRST + 1)), 7 + (step - FIRST * 127) // MOST).astype(np.int64)
    code = (sequence - sequence.min(initial=0)) * gates + gate
    weights = np.ones((int(code.max(initial=0)) + 1, inputs.shape[1])) if weights is None else weights
    order = np.argsort(rounds, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(rounds[order]) > 0, True]) if len(order) else [0]
    out = np.empty(len(bits))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        rows = order[lo:hi]
        at, x = code[rows], inputs[rows]
        out[rows] = p = squash((weights[at] * x).sum(axis=1))
        error = RATE * (bits[rows] - p)
        for j in range(x.shape[1]):
            moved = np.bincount(at, error * x[:, j])
            weights[: len(moved), j] += np.clip(moved, -0.3, 0.3)
    return out


class Shown:
    """What a sequence that goes on has shown where the mixture said about the same: rows and ones of each bucket."""

    def __init__(self) -> None:
        self.seen, self.ones = np.zeros(64), np.zeros(64)

    def refined(self, p: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """`p` refined as by `refined`, with what earlier calls have shown."""
        bucket = np.clip(np.rint(stretch(p) * 2), -24, 24).astype(np.int64) + 24
        seen, ones = earlier(bucket, bits)
        now = (p * WORTH + ones + self.ones[bucket]) / (WORTH + seen + self.seen[bucket])
        self.seen += np.bincount(bucket, minlength=64)
        self.ones += np.bincount(bucket, bits, minlength=64)
        return squash((stretch(p) + stretch(np.clip(now, 1e-6, 1 - 1e-6))) / 2)


def refined(sequence: np.ndarray, kind: np.ndarray, p: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """`p` drawn half way towards what the sequence has shown so far where the mixture said about the same."""
    bucket = np.clip(np.rint(stretch(p) * 2), -24, 24).astype(np.int64) + 24
    seen = adapted((sequence * 64 + kind) * 64 + bucket, bits, p)
    return squash((stretch(p) + stretch(np.clip(seen, 1e-6, 1 - 1e-6))) / 2)


#: Letter predictors: how many letters before (0: all of the word so far).
ORDERS = (1, 2, 3, 4, 0)
PRIOR = 0.3
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _SPREAD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Letters:
    """The binary decisions of some spelled words: `bits` (letters, 8), the word of each letter, and predictors' slots.

    A word is its bytes and an end byte, each coded as eight decisions from the highest bit.
    """

    def __init__(self, words: list[bytes]) -> None:
        body = np.frombuffer(b"\n".join(words) + b"\n" if words else b"", dtype=np.uint8)
        ends = body == 10
        self.owner = np.cumsum(ends) - ends
        starts = np.r_[0, np.flatnonzero(ends)[:-1] + 1] if words else np.empty(0, dtype=np.int64)
        self.place = np.arange(len(body)) - starts[self.owner]
        self.bits = np.unpackbits(body.reshape(-1, 1), axis=1)
        self.letters, self.node = body.astype(np.uint64) + np.uint64(1), _NODES[body]

    def slots(self, order: int, slot_bits: int) -> np.ndarray:
        """(letters, 8) slot numbers of one predictor."""
        value = np.full(len(self.letters), order + 1, dtype=np.uint64)
        for k in range(1, (order or int(self.place.max(initial=-1)) + 1) + 1):
            rows = np.flatnonzero(self.place >= k - 1) if not order else slice(None)
            back = np.zeros(len(self.letters), dtype=np.uint64)
            back[k:] = self.letters[:-k]
            back[self.place < k] = 0
            back[self.place == k - 1] = 300
            value[rows] = value[rows] * np.uint64(0x94D049BB133111EB) + back[rows]
            if not order and k >= 12:  # what lies further back tells no more
                break
        return ((mixed(value)[:, None] + self.node) >> np.uint64(64 - slot_bits)).astype(np.int64)


def _nodes() -> np.ndarray:
    """For each byte and bit, the node of the bits before it, as an offset to the context's hash."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).astype(np.uint64)
    out = np.ones((256, 8), dtype=np.uint64)
    for k in range(1, 8):
        out[:, k] = out[:, k - 1] * np.uint64(2) + bits[:, k - 1]
    return out * np.uint64(0xD1342543DE82EF95)


_NODES = _nodes()


def count_letters(words: list[bytes], out: np.ndarray, slot_bits: int) -> None:
    """Adds to `out` (predictors, slots, 2) how often a zero and a one came in each slot."""
    read = Letters(words)
    for i, order in enumerate(ORDERS):
        out[i] += np.bincount((read.slots(order, slot_bits) * 2 + read.bits).reshape(-1), minlength=out[i].size).reshape(-1, 2)


def letter_table(counts: np.ndarray) -> np.ndarray:
    """(predictors, slots): each slot's log odds of a one, weighed by how much it has seen."""
    zero, one = counts[..., 0], counts[..., 1]
    gate = np.frexp(zero + one)[1]
    weight = 0.12 + 0.3 / (1 + gate / 8)
    weight[0] = 0.15 + 0.45 / (1 + gate[0] / 6)
    return (weight * np.log((one + PRIOR) / (zero + PRIOR))).astype(np.float32)


def letter_inputs(words: list[bytes], odds: np.ndarray, slot_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bit of the words: the word, the bit, and each predictor's log odds."""
    read = Letters(words)
    inputs = [odds[i][read.slots(order, slot_bits).reshape(-1)] for i, order in enumerate(ORDERS)]
    return np.repeat(read.owner, 8), read.bits.reshape(-1).astype(np.float64), np.stack(inputs, axis=1)
