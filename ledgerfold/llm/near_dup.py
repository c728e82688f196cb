"""Near-duplicate detection by a chosen-path set similarity join.

Documents are sets of word shingles. Equal word sequences are one class first,
so thousands of copies cost one row. Every class has a MinHash signature. In
each of several independent trees a class walks from the root to the children
that it chooses: at a node, 1/threshold coordinates on average are drawn (the
draw depends on the node alone, so similar sets draw alike), and the class
goes to the child of each drawn coordinate's minwise token. Sets with
similarity at the threshold keep meeting (the walk is a critical branching
process), others part. A node ends

* when all of its members are in one component already (it can add no link);
* when it is small, or few members are outside its largest component: those are
  compared with every member, exhaustively;
* otherwise all members are compared with a few pivots, and the node branches on.

Comparisons look at the signatures' agreement (a bound five and a half standard
deviations under the threshold) and then confirm the link on the whole shingle
sets. First every class tries the partner that agrees most with it. Then the
members of a node that hang together by plausible pairs between components are
a group; a group's texts are brought together once, and all of its sets are
compared there, so that what is moved grows with the members and not with the
pairs. Equal groups of several trees are one. Links between members of one
component are not confirmed again. The
number of trees follows from the target recall of one link for walks of DEPTH
generations. Members of nodes that go on after those walk in more trees, as
many as walks of twice the depth need, and so on until no node goes on for
longer than the trees were sized for. The steps share the allowance for lost
links (each may lose half of what the step before may), so that all of them
together hold the target.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; fewer words
than a shingle's width are one shingle; texts without words (null ones too)
have no shingles, are linked with nothing, and are their own component; rows
with a null doc_id take part, and their component is the smallest doc_id that
it has (null if none, and then all of them are kept). Rows that repeat a doc_id with equal text are one
document; with another text, two. Other columns are ignored. Nothing is capped:
the limits below decide how a comparison is made, not whether.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.llm.common import MASK64, U64, WordHash, distinct, docs_view, lean, map_rows, mix, shingles, signed, slices, written

COORDINATES = 128
ENTRY = "node long, class binary, sig binary, size int"
GROUP = "gid long, class binary, partner binary, agree int"
WIDTH, THRESHOLD, RECALL = 5, 0.75, 0.9999
FEW = 32  # a node with no more members outside its largest component is compared exhaustively
SMALL = 2048  # and so is a node with no more members
MOST_HELD = 4_000_000  # shingles (32 MB) of a node that is compared exhaustively, unless it has FEW members at most
MET_AT_ONCE = 1 << 18  # owners of shingles that are looked up together, some 10 MB
PIVOTS = 8
MOST_TIED = 200_000  # links that one task ties together, about 60 MB; more take rounds over all tasks
DEPTH = 4  # generations that the first trees are sized for
MOST_SHIPPED = 500_000  # rows (class, id, hash) that go to every task at once, about 50 MB


def survival(threshold: float, depth: int) -> float:
    """Chance that two sets of similarity ``threshold`` share a node ``depth`` levels down in one tree."""
    mean = 1 / threshold
    low, p = math.floor(mean), mean - math.floor(mean)
    dead = 0.0
    for _ in range(depth):
        g = 1 - threshold + threshold * dead
        dead = (1 - p) * g ** low + p * g ** (low + 1)
    return 1 - dead


def trees_for(threshold: float, recall: float, depth: int = 4) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth))))


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


TIMES = (multipliers(COORDINATES) >> U64(32)).astype(np.uint32) | np.uint32(1)
FLIP = (multipliers(2 * COORDINATES)[COORDINATES:] >> U64(32)).astype(np.uint32)


def root_plan(threshold: float, trees: int) -> list[tuple[int, int]]:
    """(tree, coordinate) of all roots' children; no coordinate is used by two trees while there are enough."""
    mean, out, used = 1 / threshold, [], 0.0
    for tree in range(trees):
        used += mean
        while len(out) < round(used):
            out.append((tree, len(out) % COORDINATES))
    return out


def minwise(sh: np.ndarray) -> np.ndarray:
    """The element of the set that comes first under each coordinate's order (an order of the upper 32 bits)."""
    x, first = (sh >> U64(32)).astype(np.uint32), np.empty(COORDINATES, dtype=np.int64)
    step = max(1, (1 << 16) // len(x))
    for a in range(0, COORDINATES, step):
        first[a:a + step] = ((x[None, :] ^ FLIP[a:a + step, None]) * TIMES[a:a + step, None]).argmin(axis=1)
    return sh[first]


def _class_rows(threshold: float, trees: int, width: int):
    roots = root_plan(threshold, trees)
    tree_of, coord_of = np.array([t for t, _ in roots], dtype=U64), np.array([c for _, c in roots])

    def make():
        words_of = WordHash()

        def step(cols: dict) -> dict:
            out = {"doc_id": cols["doc_id"], "tie": cols["tie"], "class": [], "n_shingles": [], "roots": [], "sig": []}
            for text in cols["text"]:
                words = text.encode("utf-8").lower().split()
                out["class"].append(hashlib.md5(b" ".join(words)).digest())
                sh = distinct(shingles(words_of.array(words), width))
                out["n_shingles"].append(len(sh))
                if len(sh):
                    token = minwise(sh)
                    nodes = mix(mix(token[coord_of]) + tree_of * U64(0xD6E8FEB86659FD93) + coord_of.astype(U64))
                    out["roots"].append(signed(nodes))
                    out["sig"].append((mix(token) & U64(0xFF)).astype(np.uint8).tobytes())
                else:
                    out["roots"].append([])
                    out["sig"].append(b"")
            return out
        return step
    return make


def _children(threshold: float, generations: int):
    """Rows (node, member, sig, size) to the children that the node draws, so many generations on."""
    mean = 1 / threshold

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        if not n:
            return
        node = batch.column("node").to_numpy().view(U64)
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint8).reshape(n, COORDINATES)
        low = math.floor(mean)
        more = mix(node + U64(0x51ED270B)).astype(np.float64) / 2.0 ** 64 < mean - low
        drawn = np.stack([mix(node + U64(0xA24BAED4963EE407 * (k + 1) & MASK64)) % U64(COORDINATES) for k in range(low + 1)])
        for k in range(1, low + 1):  # drawn without replacement
            for j in range(k):
                drawn[k] = np.where(drawn[k] == drawn[j], (drawn[k] + U64(1)) % U64(COORDINATES), drawn[k])
        for k in range(low + 1):
            rows = np.flatnonzero(more) if k == low else np.arange(n)
            if not len(rows):
                continue
            c = drawn[k][rows].astype(np.int64)
            child = mix(node[rows] * U64(0xD1342543DE82EF95) + (c.astype(U64) << U64(8)) + sig[rows, c] + U64(1))
            take = pa.array(rows)
            rest = [batch.column(name).take(take) for name in ("class", "sig", "size")]
            yield pa.RecordBatch.from_arrays([pa.array(signed(child), pa.int64()), *rest], names=["node", "class", "sig", "size"])

    def after(batch: pa.RecordBatch, left: int) -> Iterator[pa.RecordBatch]:
        for out in step(batch):
            yield from after(out, left - 1) if left > 1 else (out,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from after(batch, generations)
    return run


def _more_roots(threshold: float, low: int, high: int):
    """Rows (class, sig, size) to the roots' children in the trees from ``low`` to ``high`` - 1."""
    roots = [(t, c) for t, c in root_plan(threshold, high) if t >= low]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint8).reshape(n, COORDINATES)
            for t, c in roots:
                root = mix(np.array([t * 0xD6E8FEB86659FD93 + c & MASK64], dtype=U64))
                node = mix(root + sig[:, c] + U64(1))
                rest = [batch.column(name) for name in ("class", "sig", "size")]
                yield pa.RecordBatch.from_arrays([pa.array(signed(node), pa.int64()), *rest], names=["node", "class", "sig", "size"])
    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str, *names: str) -> Iterator[list[tuple]]:
    """The rows (``names``) of each value of ``key``; rows arrive sorted by it."""
    now, held = None, []
    for batch in (part for whole in batches for part in slices(whole, 4 << 20)):
        for k, row in zip(batch.column(key).to_pylist(), zip(*(batch.column(c).to_pylist() for c in names), strict=True), strict=True):
            if k != now:
                if held:
                    yield held
                now, held = k, []
            held.append(row)
    if held:
        yield held


def _gid(keys: list[bytes]) -> int:
    """A group's name: equal groups have equal names, whichever node they come from."""
    return int.from_bytes(hashlib.md5(b"".join(sorted(keys))).digest()[:8], "little", signed=True)


def _group_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["gid", "class", "partner", "agree"])


def _close(least: int):
    """Rows of a large node's member with the probes of the node -> groups of one probe and the members plausible with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            near: dict[bytes, list[tuple]] = {}
            cols = [batch.column(c).to_pylist() for c in ("class", "sig", "comp", "size", "probes", "probe_sigs", "probe_comps", "probe_sizes")]
            for x, s, comp, size, others, their, comps, sizes in zip(*cols, strict=True):
                at = np.frombuffer(b"".join(their), dtype=np.uint8).reshape(len(others), COORDINATES)
                same = (at == np.frombuffer(s, dtype=np.uint8)).sum(axis=1)
                for k in np.flatnonzero(same >= least).tolist():
                    if comps[k] != comp:
                        near.setdefault(others[k], [(sizes[k],)]).append((x, size, int(same[k])))
            out = []
            for probe, (own, *members) in near.items():
                part, held = {}, own[0]
                for k, (x, size, same) in enumerate(members):
                    part[x] = same
                    held += size
                    if k + 1 == len(members) or len(part) >= SMALL - 1 or held + members[k + 1][1] > MOST_HELD:
                        gid, best = _gid([probe, *part]), max(part, key=lambda y: (part[y], y))
                        out.append((gid, probe, best, part[best]))
                        out += [(gid, y, probe, n) for y, n in part.items()]
                        part, held = {}, own[0]
            yield _group_batch(out)
    return run


def _best_pivot(least: int):
    """Rows of a large node's member with the node's pivots -> the plausible pivot that agrees most with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            cols = [batch.column(c).to_pylist() for c in ("class", "sig", "comp", "probes", "probe_sigs", "probe_comps")]
            for x, s, comp, others, their, comps in zip(*cols, strict=True):
                at = np.frombuffer(b"".join(their), dtype=np.uint8).reshape(len(others), COORDINATES)
                same = (at == np.frombuffer(s, dtype=np.uint8)).sum(axis=1)
                found = [(int(n), y) for n, y, c in zip(same, others, comps, strict=True) if n >= least and c != comp]
                if found:
                    n, y = max(found)
                    out.append((0, x, y, n))
            yield _group_batch(out)
    return run


def _plausible(least: int):
    """Rows of small nodes' members, sorted by node -> groups that hang together by plausible pairs between components."""

    def groups(members: list[tuple]) -> list[tuple]:
        keys = [m[0] for m in members]
        at = {c: i for i, c in enumerate({m[2] for m in members})}
        if len(at) < 2:
            return []
        comp = np.array([at[m[2]] for m in members])
        sig = np.frombuffer(b"".join(m[1] for m in members), dtype=np.uint8).reshape(len(keys), COORDINATES)
        label, agree, partner = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for i in range(1, len(keys)):
            same = (sig[:i] == sig[i]).sum(axis=1)
            hits = np.flatnonzero((same >= least) & (comp[:i] != comp[i]))
            if not len(hits):
                continue
            n = same[hits]
            agree[i], partner[i] = n.max(), hits[n.argmax()]
            better = hits[n > agree[hits]]
            agree[better], partner[better] = same[better], i
            label[i] = label[hits].min()
            label[np.isin(label, label[hits])] = label[i]
        out, parts = [], {}
        for i in np.flatnonzero(agree).tolist():
            parts.setdefault(label[i], []).append(i)
        for part in parts.values():
            gid = _gid([keys[i] for i in part])
            out += [(gid, keys[i], keys[partner[i]], int(agree[i])) for i in part]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for members in _runs(batches, "node", "class", "sig", "comp"):
            out += groups(members)
            if len(out) > 10_000:
                yield _group_batch(out)
                out = []
        yield _group_batch(out)
    return run


def _shared_with(owner: np.ndarray, low: np.ndarray, high: np.ndarray, n_sets: int) -> np.ndarray:
    """How often each set is the owner in the spans low .. high; about MET_AT_ONCE owners are looked up together."""
    n, both, first = high - low, np.zeros(n_sets, dtype=np.int64), 0
    upto = np.cumsum(n)
    while first < len(n):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + MET_AT_ONCE, "right")))
        m = n[first:last]
        at = np.repeat(low[first:last] - np.cumsum(m) + m, m) + np.arange(m.sum())
        both += np.bincount(owner[at], minlength=n_sets)
        first = last
    return both


def _linked(threshold_pct: int, width: int):
    """Rows of groups' members with their texts, sorted by group -> links between components, by whole sets; no more of
    them than it takes to tie together what the group ties together."""

    def links(members: list[tuple]) -> list[tuple]:
        names = sorted({m[0] for m in members})
        at = {c: i for i, c in enumerate(names)}
        comp, sets = np.array([at[m[0]] for m in members]), [m[1] for m in members]
        size = np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(sets), dtype=np.int32), size)[order]
        del order
        root, out = np.arange(len(names)), []
        for x in np.flatnonzero(comp != np.bincount(comp).argmax()).tolist():  # members of the largest component meet all others
            low, high = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
            both = _shared_with(owner, low, high, len(sets))
            near = np.flatnonzero(100 * both >= threshold_pct * (size[x] + size - both))
            for c in np.unique(comp[near]).tolist():
                if root[c] != root[comp[x]]:
                    out.append((names[c], names[comp[x]]))
                    root[root == root[c]] = root[comp[x]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, known, held = WordHash(), {}, 0

        def whole(key: bytes, text: str) -> np.ndarray:
            nonlocal held
            got = known.get(key)
            if got is None:
                if held > 2_000_000:  # 16 MB
                    known.clear()
                    held = 0
                got = known[key] = distinct(shingles(words_of.array(text.encode("utf-8").lower().split()), width))
                held += len(got)
            return got

        def sets() -> Iterator[tuple]:
            for batch in (part for whole_batch in batches for part in slices(whole_batch, 4 << 20)):
                for gid, key, comp, text in zip(*(batch.column(c).to_pylist() for c in ("gid", "class", "comp", "text")), strict=True):
                    yield gid, comp, whole(key, text)

        out = []
        for _, members in groupby(sets(), key=lambda row: row[0]):
            out += links([m[1:] for m in members])
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*out, strict=True) if out else ((), ()))], names=["a", "b"])
    return run


def fingerprint(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of one task -> (member, comp) of every end, comp the smallest member reachable."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((top(a), top(b)))
            up[high] = low
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.binary()), pa.array([top(x) for x in list(up)], pa.binary())], names=["member", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """(member, comp) of every end of ``edges`` (a, b): comp is the smallest member reachable.

    MOST_TIED links at most are tied together in one task. More take large-star
    and small-star rounds: every node's neighbours are linked to its
    smallest neighbour, until nothing changes. Minima are taken as sums are, so
    a hub with a third of all edges is no single group.
    """
    if edges.count() <= MOST_TIED:
        return written(edges.filter("a <> b").coalesce(1).mapInArrow(_forest, "member binary, comp binary"), "forest")
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        now = fingerprint(e)
        if now == before or not now[0]:
            return e.select(F.col("u").alias("member"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("member"), F.col("v").alias("comp")).distinct())
        before = now
        # large star: the larger neighbours of u go to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = written(star.filter("u <> v").distinct(), "star")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH,
                    recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept, class (md5 of the word sequence),
    tie (xxhash64 of the text, to tell rows of one doc_id apart)."""
    spark = docs.sparkSession
    pct = round(threshold * 100)
    least = max(1, math.floor(COORDINATES * threshold - 5.5 * math.sqrt(COORDINATES * threshold * (1 - threshold))))
    # chance that a link is lost: six tenths of the allowance in the first trees, the rest in the steps after them
    trees, depth, sized = trees_for(threshold, 1 - 0.6 * (1 - recall), DEPTH), 0, DEPTH
    lost = 0.4 * (1 - recall)
    d = docs_view(docs, id_col, text_col)
    rows = written(map_rows(d.withColumn("tie", F.xxhash64("text")), _class_rows(threshold, trees, width), "doc_id long, tie long, class binary, n_shingles long, roots array<long>, sig binary"), "rows")
    classes = written(rows.filter("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("first_id"), F.first("roots").alias("roots"), F.first("sig").alias("sig"), F.max("n_shingles").cast("int").alias("size")), "classes")
    # nodes of one member go before signatures are carried anywhere
    entries = classes.select(F.explode("roots").alias("node"), "class")
    sizes = entries.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    level = written(entries.join(sizes, "node", "left_semi").join(classes.select("class", "sig", "size"), "class").select("node", "class", "sig", "size"), "level")
    comp = spark.createDataFrame([], "member binary, comp binary")
    texts = None
    deep: dict[int, list[DataFrame]] = {}  # members of nodes that go on at DEPTH generations, twice as many, ...
    while True:
        if level is None or not level.take(1):
            if sized not in deep:
                break
            members = written(reduce(DataFrame.unionByName, deep[sized]).dropDuplicates(["class"]), "deep")
            if not members.take(1):
                break
            lost, sized, depth = lost / 2, 2 * sized, 0
            before, trees = trees, trees_for(threshold, 1 - lost, sized)
            grown = written(members.mapInArrow(_more_roots(threshold, before, trees), ENTRY), "more")
            level = _shared(grown)
            continue
        if texts is None:  # at the roots: every class is a component
            placed = level.withColumn("comp", F.col("class"))
        else:
            placed = level.join(comp.withColumnRenamed("member", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
            placed = written(placed.select("node", "class", "sig", "size", "comp"), "placed")
        by_comp = placed.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        nodes = by_comp.groupBy("node").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "comp")).alias("most")).withColumn(
            "outside", F.col("n") - F.col("most.n")).filter("outside > 0")
        exhaustive = (F.col("n") <= FEW) | ((F.col("n") <= SMALL) & (F.col("size") <= MOST_HELD))
        kind = F.when(exhaustive, "small").when(F.col("outside") <= FEW, "few").otherwise("big")
        nodes = written(nodes.select("node", kind.alias("kind"), F.col("most.comp").alias("main")), "nodes")
        kinds = {r["kind"] for r in nodes.select("kind").distinct().collect()}  # three at most
        small = placed.join(nodes.filter("kind = 'small'").select("node"), "node", "left_semi").select("node", "class", "sig", "comp")
        groups = small.repartition("node").sortWithinPartitions("node", "class").mapInArrow(lean(_plausible(least)), GROUP)
        if "few" in kinds:  # of large nodes, the members (FEW at most) outside the main component go to all members
            outside = placed.join(nodes.filter("kind = 'few'").select("node", "main"), "node").filter("comp <> main")
            groups = groups.unionByName(_with_probes(placed, outside).mapInArrow(lean(_close(least)), GROUP))
        groups = written(groups.dropDuplicates(["gid", "class"]), "groups")
        best, live, big = groups.select("class", "partner", "agree"), groups.select("class"), None
        if "big" in kinds:  # of the others, some pivots go to all members, which try the one that agrees most
            big = written(placed.join(nodes.filter("kind = 'big'").select("node"), "node", "left_semi"), "big")
            pivots = big.groupBy("node", F.pmod(F.xxhash64(F.lit(1), "class"), F.lit(PIVOTS)).alias("k")).agg(
                F.min(F.struct(F.xxhash64("class").alias("o"), "class", "sig", "comp", "size")).alias("p")).select("node", "p.class", "p.sig", "p.comp", "p.size")
            best = best.unionByName(_with_probes(big, pivots).mapInArrow(_best_pivot(least), GROUP).select("class", "partner", "agree"))
            live = live.unionByName(big.select("class"))
        if texts is None:  # at the roots: texts of every class that a later comparison can need
            texts = _texts(d, rows, live.distinct())
        if depth == 0 or big is not None:
            best = best.groupBy("class").agg(F.max(F.struct("agree", "partner")).alias("m")).select(F.least("class", "m.partner").alias("a"), F.greatest("class", "m.partner").alias("b"))
            pairs = best.distinct().select(F.xxhash64("a", "b").alias("gid"), F.explode(F.array("a", "b")).alias("class"))
            comp = _confirm(pairs, comp, texts, pct, width)
        comp = _confirm(groups.select("gid", "class"), comp, texts, pct, width)
        if big is None:
            level = None
            continue
        if depth >= sized and depth % DEPTH == 0 and (depth // DEPTH).bit_count() == 1:
            deep.setdefault(depth, []).append(big.select("class", "sig", "size"))
        # two generations at a time
        depth += 2
        level = _shared(written(big.select("node", "class", "sig", "size").mapInArrow(_children(threshold, 2), ENTRY), "children"))
    ids = classes.select("class", "first_id").join(comp.withColumnRenamed("member", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    low = ids.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of = ids.join(low, "comp").select("class", "component_id")
    own = rows.select("doc_id", "tie", "n_shingles", "class")
    full = own.filter("n_shingles > 0").join(of, "class").select("doc_id", "n_shingles", "component_id", "class", "tie")
    out = full.unionByName(own.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "class", "tie"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _shared(grown: DataFrame) -> DataFrame:
    """The rows of ``grown`` whose node has two members at least."""
    alive = grown.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    return written(grown.join(alive, "node"), "level")


def _texts(d: DataFrame, rows: DataFrame, live: DataFrame) -> DataFrame:
    """(class, text) of the classes in ``live``, from one document of each."""
    one = rows.join(live, "class", "left_semi").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tie")).alias("x")).select(
        "class", F.col("x.doc_id").alias("at"), F.col("x.tie").alias("with"))

    def make():
        def step(cols: dict) -> dict:
            return {"class": [hashlib.md5(b" ".join(t.encode("utf-8").lower().split())).digest() for t in cols["text"]], "text": cols["text"], "want": cols["class"]}
        return step

    # an id and the text's hash name a row, whether ids are null or repeated; the class is computed again and has the last word
    own = d.withColumn("tie", F.xxhash64("text"))
    one = written(one, "live")
    if one.count() <= MOST_SHIPPED:  # so few go to the scan; more meet the texts in a shuffle join
        one = F.broadcast(one)
    joined = own.join(one, (own["tie"] == one["with"]) & own["doc_id"].eqNullSafe(one["at"])).select("text", "class")
    got = map_rows(joined, make, "class binary, text string, want binary").filter(F.col("class") == F.col("want")).select("class", "text")
    return written(got.dropDuplicates(["class"]), "texts")


def _with_probes(members: DataFrame, probes: DataFrame) -> DataFrame:
    """The rows of ``members`` with the probes (node, class, sig, comp, size) of their node, as arrays; a node has few."""
    p = probes.groupBy("node").agg(F.collect_list(F.struct("class", "sig", "comp", "size")).alias("p")).select(
        "node", F.col("p.class").alias("probes"), F.col("p.sig").alias("probe_sigs"), F.col("p.comp").alias("probe_comps"), F.col("p.size").alias("probe_sizes"))
    return members.join(p, "node").drop("node")


def _confirm(groups: DataFrame, comp: DataFrame, texts: DataFrame, pct: int, width: int) -> DataFrame:
    """``comp`` (member, comp) with the links within ``groups`` (gid, class) taken in.

    Groups that are in one component by now are left out. The texts of the
    others' members meet in one task for each group, which names links between
    components, and these are merged.
    """
    named = groups.join(comp.withColumnRenamed("member", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    own = Window.partitionBy("gid")  # a group has SMALL members at most
    named = named.withColumn("x", F.min("comp").over(own)).withColumn("y", F.max("comp").over(own))
    open_ = written(named.filter("x <> y").select("gid", "class", "comp"), "open")
    held = open_.join(texts, "class").select("gid", "class", "comp", "text").repartition("gid").sortWithinPartitions("gid")
    links = written(held.mapInArrow(lean(_linked(pct, width)), "a binary, b binary"), "links")
    if not links.take(1):
        return comp
    moved = components(links).select(F.col("member").alias("old"), F.col("comp").alias("new"))
    kept = comp.join(moved, comp["comp"] == moved["old"], "left").select("member", F.coalesce("new", "comp").alias("comp"))
    fresh = moved.join(comp, moved["old"] == comp["member"], "left_anti").select(F.col("old").alias("member"), F.col("new").alias("comp"))
    return written(kept.unionByName(fresh), "comp")
