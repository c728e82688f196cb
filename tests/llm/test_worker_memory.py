"""What Python workers hold during a step, and after it."""

import tracemalloc

import numpy as np
import pyarrow as pa

from ledgerfold.llm import bpe, common, near_dup


def test_a_task_gives_its_memory_back_at_its_end(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    out = common.lean(lambda batches: (b for b in batches))(iter([1, 2, 3]))
    assert next(out) == 1 and not given
    assert list(out) == [2, 3] and given == [1]


def test_steps_of_the_pipeline_are_lean(spark, monkeypatch):
    """The function that Spark gets ends by giving back."""
    class Docs:
        schema = common.T._parse_datatype_string("doc_id long, text string")

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    run = bpe._with_column(Docs(), "n", common.T.LongType(), "text", lambda: lambda texts: pa.array([len(t) for t in texts.to_pylist()], pa.int64()))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["abc"]})
    assert [b.to_pylist() for b in run(iter([batch]))] == [[{"doc_id": 1, "text": "abc", "n": 3}]]
    assert given == [1]


def test_members_of_a_large_group_are_compared_in_bounded_memory():
    """400 near copies of 2,000 words, all in two components: the shingles are many times what is looked up at once."""
    words = " ".join(f"w{k}" for k in range(2000))
    texts = [f"{words} own{i}" for i in range(400)]
    rows = pa.RecordBatch.from_pydict({"gid": [1] * 400, "class": [b"%04d" % i for i in range(400)],
                                       "comp": [b"main"] * 399 + [b"out"], "text": texts})
    run = near_dup._linked(75, 5)
    tracemalloc.start()
    got = [r for b in run(iter([rows])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [{"a": b"main", "b": b"out"}]
    assert peak < 36e6, peak  # 38.8 MB with all looked up at once, 32.3 MB so


def test_shared_with_is_a_plain_count(monkeypatch):
    monkeypatch.setattr(near_dup, "MET_AT_ONCE", 5)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(12)]
    size = np.array([len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(12), size)[order]
    for x in sets:
        got = near_dup._shared_with(owner, np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right"), 12)
        assert got.tolist() == [len(np.intersect1d(x, y)) for y in sets]
