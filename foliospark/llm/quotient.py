"""Counting quotient filter over 64-bit fingerprints.

A fingerprint is split into a quotient (high bits) and a remainder. Remainders are kept sorted within
the run of their quotient, run lengths in unary, so the whole filter reads back as one sorted list of
distinct fingerprints with counts. Nothing is lost: a merge of filters is a merge of sorted lists.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BBQQ")


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal keys; keys come as concatenated sorted runs, which a stable sort merges."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


class CountingQuotientFilter:
    """Fingerprints that share their top ``skip`` bits with counts, as (quotient run, remainder, count)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, skip: int = 0):
        self.keys, self.counts, self.skip = keys, counts, skip

    @classmethod
    def of(cls, fingerprints: np.ndarray, skip: int = 0) -> CountingQuotientFilter:
        """``fingerprints``: any order, with repeats."""
        keys, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls(keys, counts.astype(np.int64), skip)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        keys, counts = _tally(np.concatenate([f.keys for f in filters]), np.concatenate([f.counts for f in filters]))
        return cls(keys, counts, filters[0].skip)

    def count(self, fingerprint: int) -> int:
        at = int(np.searchsorted(self.keys, np.uint64(fingerprint)))
        return int(self.counts[at]) if at < len(self.keys) and int(self.keys[at]) == fingerprint else 0

    def to_bytes(self) -> bytes:
        n = len(self.keys)
        q = min(max(1, (max(n, 1) - 1).bit_length()), 64 - self.skip - 8, 28)
        r = 64 - self.skip - q
        prefix = int(self.keys[0]) >> (64 - self.skip) if self.skip and n else 0
        tail = self.keys & np.uint64((1 << (64 - self.skip)) - 1) if self.skip else self.keys
        quotient, rest = (tail >> np.uint64(r)).astype(np.int64), tail & np.uint64((1 << r) - 1)
        unary = np.zeros(n + (1 << q), dtype=np.uint8)  # of each quotient: as many ones as its run is long, then a zero
        unary[quotient + np.arange(n)] = 1
        width = (r + 7) // 8
        remainders = rest.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        more = np.flatnonzero(self.counts > 1)
        return b"".join((
            _HEAD.pack(self.skip, q, prefix, n), np.packbits(unary).tobytes(), np.ascontiguousarray(remainders).tobytes(),
            more.astype("<u4").tobytes(), self.counts[more].astype("<i8").tobytes(),
        ))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        skip, q, prefix, n = _HEAD.unpack_from(data)
        r = 64 - skip - q
        at = _HEAD.size
        size = (n + (1 << q) + 7) // 8
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at))[: n + (1 << q)])
        at += size
        width = (r + 7) // 8
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        keys = ((ones - np.arange(n)).astype(np.uint64) << np.uint64(r)) | rest.reshape(-1).view("<u8").astype(np.uint64)
        if skip:
            keys |= np.uint64(prefix << (64 - skip))
        k = (len(data) - at) // 12
        counts = np.ones(n, np.int64)
        counts[np.frombuffer(data, "<u4", k, at)] = np.frombuffer(data, "<i8", k, at + 4 * k)
        return cls(keys, counts, skip)
