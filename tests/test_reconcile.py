"""Digest trees against the join of whole editions."""

import random

import pytest

from foliospark.operators import ingest, reconcile

SCHEMA = "corpus_id string, locator string, sha256 string"


def prints(draw, n):
    return {(f"c{i % 4}", f"L {i}"): f"{draw.randrange(10**9):x}" for i in range(n)}


@pytest.mark.parametrize(("changes", "levels"), [(0, 1), (3, 2), (200, 1)])
def test_equal_to_the_whole_join(spark, tmp_path, changes, levels):
    draw = random.Random(changes)
    one = prints(draw, 3000)
    two = dict(one)
    for key in draw.sample(sorted(one), changes):
        way = draw.randrange(3)
        if way == 0:
            del two[key]
        elif way == 1:
            two[key] = "changed"
        else:
            two[key[0], key[1] + " new"] = "added"
    frames = [spark.createDataFrame([(*k, v) for k, v in x.items()], SCHEMA) for x in (one, two)]
    paths = [f"file://{tmp_path}/{x}" for x in "ab"]
    for frame, path in zip(frames, paths, strict=True):
        reconcile.write_prints(frame, path, levels)
    if not changes:
        reconcile.write_prints(frames[0].repartition(3), paths[1], levels)  # in another order: the same digests
    want = sorted(map(tuple, ingest.fingerprint_diff(*frames).collect()))
    diff = reconcile.stored_diff(spark, *paths, levels)
    assert sorted(map(tuple, diff.collect())) == want and len(want) == changes
    odd = reconcile.differing_leaves(spark, *paths, levels)
    assert (len(odd) <= changes) and (changes == 0) == (odd == [])
    if 0 < changes < 4:  # leaves that agree can be broken, and nobody notices
        good = next(i for i in range(256) if i not in odd and (tmp_path / "a" / "prints" / f"leaf={i}").exists())
        (tmp_path / "a" / "prints" / f"leaf={good}" / "part-broken.parquet").write_bytes(b"not parquet")
        assert sorted(map(tuple, reconcile.stored_diff(spark, *paths, levels).collect())) == want


def test_one_side_only(spark, tmp_path):
    frame = spark.createDataFrame([("c", "L 1", "x"), ("c", "L 2", None)], SCHEMA)
    a, b, none = (f"file://{tmp_path}/{x}" for x in ("a", "b", "none"))
    reconcile.write_prints(frame, a, 1)
    reconcile.write_prints(frame.limit(0), b, 1)
    for other in (b, none):
        assert sorted((r["locator"], r["class"]) for r in reconcile.stored_diff(spark, a, other, 1).filter("locator = 'L 1'").collect()) == [("L 1", "missing")]
        assert [r["class"] for r in reconcile.stored_diff(spark, other, a, 1).filter("locator = 'L 1'").collect()] == ["unexpected"]
