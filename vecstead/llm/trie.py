"""Binary trie self-join: pairs of fingerprints within a Hamming budget, from a traversal of node pairs.

The trie's levels are taken eight bits at a time: a node is a run of sorted fingerprints that share their first bytes. The
traversal holds a frontier of node pairs with the differing bits so far, replaces each pair by the pairs of its children,
adds the differing bits of their labels, and drops what is over the budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

POPCOUNT = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i: first[i], first[i] + 1, ... (count[i] of them), and the i that each belongs to."""
    owner = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return first[owner] + offset, owner


def _join(prints: np.ndarray, bucket: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs within the budget; rows are distinct and sorted by bucket, then bytes."""
    n, width = prints.shape
    starts = np.r_[True, bucket[1:] != bucket[:-1]]
    node_of_row = np.cumsum(starts) - 1
    first_row = np.flatnonzero(starts)
    size = np.diff(np.r_[first_row, n])
    a = np.flatnonzero(size > 1)
    b, apart = a.copy(), np.zeros(len(a), dtype=np.int32)
    for depth in range(width):
        if not len(a):
            break
        edge = starts.copy()
        edge[1:] |= prints[1:, depth] != prints[:-1, depth]
        child_of_row = np.cumsum(edge) - 1
        child_row = np.flatnonzero(edge)
        first_child = child_of_row[first_row]
        children = np.diff(np.r_[first_child, len(child_row)])
        label, rows_in = prints[child_row, depth], np.diff(np.r_[child_row, n])
        left, owner = _expand(first_child[a], children[a])
        right_of, apart_of, same = b[owner], apart[owner], a[owner] == b[owner]
        from_child = np.where(same, left, first_child[right_of])
        right, owner2 = _expand(from_child, first_child[right_of] + children[right_of] - from_child)
        left, apart_of = left[owner2], apart_of[owner2]
        apart_of = apart_of + POPCOUNT[label[left] ^ label[right]]
        keep = (apart_of <= budget) & ((left != right) | (rows_in[left] > 1))
        a, b, apart = left[keep], right[keep], apart_of[keep]
        starts, node_of_row, first_row = edge, child_of_row, child_row
    return first_row[a], first_row[b]


def trie_pairs(prints: np.ndarray, bucket: np.ndarray, budget: int, at_once: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers whose fingerprints (rows of bytes) share a bucket and differ in at most `budget` bits.

    Rows of one bucket must be distinct. Buckets are taken in blocks of about `at_once` possible pairs, which bounds the
    frontier; one bucket alone may exceed that, so callers split large buckets.
    """
    order = np.lexsort((*prints.T[::-1], bucket))
    prints, bucket = prints[order], bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[cuts, len(bucket)]).astype(np.int64)
    block = np.cumsum(sizes * sizes) // at_once
    edges = np.r_[cuts[np.r_[True, block[1:] != block[:-1]]], len(bucket)] if len(cuts) else []
    for lo, hi in zip(edges[:-1], edges[1:]):
        i, j = _join(prints[lo:hi], bucket[lo:hi], budget)
        yield order[lo + i], order[lo + j]


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label
