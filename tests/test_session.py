"""Stored tables have an owner."""

import os

from limewash.session import materialise, release, scratch


def folder(df):
    return df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]


def test_a_block_removes_what_was_stored_inside(spark):
    with scratch(spark) as paths:
        outer = materialise(spark.range(3), "outer")
        with scratch(spark):
            inner = folder(materialise(spark.range(3), "inner"))
            kept = materialise(spark.range(4), "kept", keep=True)
        assert not os.path.exists(inner) and kept.count() == 4 and outer.count() == 3 and len(paths) == 1
    assert not any(os.path.exists(p) for p in paths)
    path = folder(kept)
    release(kept)
    assert not os.path.exists(path)


def test_a_failed_block_leaves_nothing(spark):
    seen = []
    try:
        with scratch(spark) as paths:
            materialise(spark.range(3), "t")
            seen += paths
            raise ValueError
    except ValueError:
        pass
    assert seen and not any(os.path.exists(p) for p in seen)
