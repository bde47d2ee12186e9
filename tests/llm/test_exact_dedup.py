import hashlib
import re

import numpy as np
from helpers import ODD, docs

from foliospark.llm.exact_dedup import exact_dedup
from foliospark.llm.quotient import CountingQuotientFilter


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        ids = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
        known = [j for j in ids if j is not None]
        keep = i if len(ids) == 1 else min(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = ODD + [(100 + i, f"text {i % 7}  of  group") for i in range(60)]
    assert sorted(map(tuple, exact_dedup(docs(spark, rows)).collect()), key=repr) == brute(rows)


def test_empty(spark):
    assert exact_dedup(docs(spark, [])).collect() == []


def test_filter_is_lossless():
    r = np.random.default_rng(3)
    parts = [r.integers(0, 1 << 63, 500, dtype=np.uint64) >> np.uint64(s) for s in (0, 40, 56, 60)]
    merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(CountingQuotientFilter.of(p).to_bytes()) for p in parts])
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.keys == keys).all() and (merged.counts == counts).all()
    again = CountingQuotientFilter.from_bytes(merged.to_bytes())
    assert (again.keys == keys).all() and (again.counts == counts).all()
    assert merged.count(int(keys[5])) == counts[5] and merged.count(int(keys[-1]) + 1) == 0
    ranged = CountingQuotientFilter.of(keys & np.uint64((1 << 52) - 1) | np.uint64(9 << 52), 12)
    assert (CountingQuotientFilter.from_bytes(ranged.to_bytes()).keys == ranged.keys).all()
