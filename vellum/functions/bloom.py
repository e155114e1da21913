"""A Bloom filter over key bytes, for membership tests outside Parquet's own filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from math import ceil, log

from ..errors import IllegalArgument


@dataclass(frozen=True)
class BloomFilter:
    """Immutable; callable as a predicate."""

    bits: int
    k: int
    bins: int = 0
    meta: dict = field(default_factory=dict, compare=False)

    @classmethod
    def create(cls, expected: int, error_rate: float = 0.01) -> BloomFilter:
        bits = max(8, ceil(-max(1, expected) * log(error_rate) / log(2) ** 2))
        return cls(bits, max(1, round(bits / max(1, expected) * log(2))))

    def _mask(self, item: bytes) -> int:
        digest = hashlib.blake2b(bytes(item), digest_size=16).digest()
        a, b = int.from_bytes(digest[:8]), int.from_bytes(digest[8:]) | 1
        mask = 0
        for i in range(self.k):
            mask |= 1 << (a + i * b) % self.bits
        return mask

    def insert(self, *items: bytes) -> BloomFilter:
        return self.into(items)

    def into(self, items: Iterable[bytes]) -> BloomFilter:
        bins = self.bins
        for item in items:
            bins |= self._mask(item)
        return BloomFilter(self.bits, self.k, bins, self.meta)

    def __contains__(self, item: bytes) -> bool:
        mask = self._mask(item)
        return self.bins & mask == mask

    __call__ = __contains__

    def mergeable(self, other: BloomFilter) -> bool:
        return (self.bits, self.k) == (other.bits, other.k)

    def merge(self, other: BloomFilter) -> BloomFilter:
        if not self.mergeable(other):
            raise IllegalArgument("filters of different sizes cannot be merged")
        return BloomFilter(self.bits, self.k, self.bins | other.bins, self.meta | other.meta)

    def to_form(self) -> list:
        return [self.k, self.bits, f"{self.bins:x}"]

    @classmethod
    def from_form(cls, form: list) -> BloomFilter:
        return cls(form[1], form[0], int(form[2], 16))
