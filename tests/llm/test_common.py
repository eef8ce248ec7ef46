import os

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import _common


def test_stashes_are_kept_until_they_are_dropped(spark):
    a, b = _common.stash(spark.range(3), "a"), _common.stash(spark.range(4), "b")
    assert a.count() == 3 and a.stash_path.startswith(_common.shared_dir(spark))
    _common.discard(a)
    assert not os.path.exists(a.stash_path) and b.count() == 4
    _common.clean(spark)
    assert not os.path.exists(b.stash_path)


def test_slices_hold_every_row():
    texts = ["a" * 10, "", None, "b" * 100, "c", "d" * 7]
    batch = pa.RecordBatch.from_pydict({"text": texts, "k": list(range(6))})
    for most in (1, 5, 11, 1000):
        parts = list(_common.slices([batch], "text", most))
        assert [x for p in parts for x in p.column("text").to_pylist()] == texts
        assert all(p.num_rows for p in parts)
    assert list(_common.slices([batch.slice(0, 0)], "text")) == []


@pytest.mark.parametrize("starts, lengths", [([], []), ([5, 0, 9], [2, 0, 3])])
def test_ragged(starts, lengths):
    want = [x for a, n in zip(starts, lengths, strict=True) for x in range(a, a + n)]
    assert _common.ragged(np.array(starts, np.int64), np.array(lengths, np.int64)).tolist() == want
