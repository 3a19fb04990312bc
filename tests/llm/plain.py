"""Plain-Python versions of what the operators compute: Spark's xxhash64, the Feistel permutation, the mix."""

import math
import struct

import xxhash


def spark_hash(*values):
    """xxhash64 of (kind, value) pairs as Spark has it, signed: i a 32-bit and l a 64-bit number, s a string; nulls are passed over."""
    h = 42
    for kind, v in values:
        if v is not None:
            raw = v.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", v)
            h = xxhash.xxh64_intdigest(raw, h & (2**64 - 1))
    return h - 2**64 if h >= 2**63 else h


def permuted(x, n, key):
    """The place of x in the shuffle; key: a (kind, value) pair."""
    a = max(1, math.ceil(math.sqrt(n)))
    b = (n + a - 1) // a

    def step(y):
        left, right = y // b, y % b
        for k in range(4):
            left = (left + spark_hash(("l", right), ("i", k), key) % a) % a
            right = (right + spark_hash(("l", left), ("i", k + 1000), key) % b) % b
        return left * b + right

    y = step(x)
    while y >= n:
        y = step(y)
    return y


def runs(pieces):
    """Lengths of equal neighbours."""
    out = []
    for p in pieces:
        if out and out[-1][0] == p:
            out[-1][1] += 1
        else:
            out.append([p, 1])
    return out
