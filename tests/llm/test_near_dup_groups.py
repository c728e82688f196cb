"""What near-duplicate detection moves grows with a group's members, not with its pairs."""

import numpy as np

from ledgerfold.llm import near_dup


def test_a_group_is_confirmed_by_members_not_by_pairs(spark, monkeypatch):
    """120 documents of similarity 0.64 by one passage, in pairs of 0.85: all pairs are plausible, 60 are links."""
    moved, written = [], near_dup.written

    def counting(df, name):
        out = written(df, name)
        if name == "open":
            moved.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "written", counting)
    passage = " ".join(f"p{x}" for x in range(82))
    data = [(i, passage + "".join(f" o{i // 2}x{k}" for k in range(14)) + "".join(f" u{i}x{k}" for k in range(8))) for i in range(120)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(120)}
    assert sum(moved) < 120 * 120 / 4  # in the group's pairs there are 7,140


def test_links_are_tied_alike_in_one_task_and_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    edges = [(b"%04d" % a, b"%04d" % b) for a, b in rng.integers(0, 200, (150, 2))]
    df = spark.createDataFrame(edges, "a binary, b binary")
    one = {tuple(map(bytes, r)) for r in near_dup.components(df).collect()}
    monkeypatch.setattr(near_dup, "MOST_TIED", 0)
    assert one == {tuple(map(bytes, r)) for r in near_dup.components(df).collect()}


def test_few_members_outside_a_large_component_meet_all_of_it():
    """A probe's plausible members come in groups of SMALL at most, the probe in each; its own component does not."""
    import pyarrow as pa
    sig, n = bytes(range(128)), near_dup.SMALL + 50
    keys = [b"%08d" % i for i in range(n)]
    batch = pa.RecordBatch.from_pydict({
        "class": keys, "sig": [sig] * n, "comp": [b"main"] * (n - 1) + [b"out"], "size": [3] * n, "probes": [[b"probe"]] * n,
        "probe_sigs": [[sig]] * n, "probe_comps": [[b"out"]] * n, "probe_sizes": [[3]] * n})
    rows = [r for b in near_dup._close(69)(iter([batch])) for r in b.to_pylist()]
    groups = {}
    for r in rows:
        groups.setdefault(r["gid"], set()).add(r["class"])
    assert len(groups) == 2 and all(b"probe" in g and len(g) <= near_dup.SMALL for g in groups.values())
    assert set().union(*groups.values()) == {*keys[:-1], b"probe"}
