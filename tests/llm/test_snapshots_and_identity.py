"""Exact dedup through sealed snapshots; null and repeated ids in near-duplicates, archives and the classifier's fit; whole pipeline runs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import exact_dedup, near_dup, pii, quality_crf, warc

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def table(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string")


def groups(result):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows(result)}


def test_dedup_rests_on_the_filters(spark, monkeypatch):
    """Copies across snapshot and batch are found through the filters alone: with filters that let nothing through they stay apart."""
    old, new = table(spark, [(1, "a b"), (2, "c"), (3, "only here")]), table(spark, [(4, "ab"), (5, " c "), (6, "new"), (7, "n e w")])
    snapshot = exact_dedup.seal(old)
    got = groups(exact_dedup.dedup_against(new, [snapshot]))
    assert got == {1: (1, 2, True), 4: (1, 2, False), 2: (5, 2, False), 5: (5, 2, True), 3: (3, 1, True), 6: (7, 2, False), 7: (7, 2, True)}
    monkeypatch.setattr(exact_dedup, "screened", lambda groups, snapshot: groups.select("text_sha256").limit(0))
    blind = groups(exact_dedup.dedup_against(new, [snapshot]))
    assert blind == {1: (1, 1, True), 4: (4, 1, True), 2: (2, 1, True), 5: (5, 1, True), 3: (3, 1, True), 6: (7, 2, False), 7: (7, 2, True)}


def test_filter_gone_wrong_loses_copies(spark, monkeypatch):
    snapshot = exact_dedup.seal(table(spark, [(1, "a"), (2, "b")]))
    new = table(spark, [(3, "a"), (4, "z")])
    assert {r["text_sha256"] for r in rows(exact_dedup.screened(exact_dedup.grouped(exact_dedup.digests(new)), snapshot))} >= {
        r["text_sha256"] for r in rows(exact_dedup.digests(table(spark, [(0, "a")])))}
    empty = exact_dedup.Snapshot(snapshot.rows, snapshot.groups, snapshot.filters.limit(0), snapshot.buckets, snapshot.texts)
    assert groups(exact_dedup.dedup_against(new, [empty]))[3] == (3, 1, True)


@pytest.mark.parametrize("shipped", [0, 500_000])
def test_several_snapshots_and_small_buckets(spark, monkeypatch, shipped):
    """Many buckets and slices, two disjoint snapshots, both ways to fetch the positives' texts: as one grouping of all rows."""
    monkeypatch.setattr(exact_dedup, "KEYS_PER_FILTER", 20)
    monkeypatch.setattr(exact_dedup, "SLICE", 7)
    monkeypatch.setattr(exact_dedup, "MOST_SHIPPED", shipped)
    draw = random.Random(3)
    one = [(i, f"x{i % 70}") for i in range(150)]
    two = [(1000 + i, f"y{i % 50}" + " " * (i % 3)) for i in range(150)]
    new = [(2000 + i, draw.choice(["x", "y", "z"]) + str(draw.randrange(90))) for i in range(300)] + [(3000, None), (3001, "")]
    first = exact_dedup.seal(table(spark, one))
    assert first.buckets == 4
    got = groups(exact_dedup.dedup_against(table(spark, new), [first, exact_dedup.seal(table(spark, two))]))
    sets = {}
    for i, t in one + two + new:
        sets.setdefault((t or "").replace(" ", ""), []).append((-len(t or ""), i))
    want = {i: (min(s)[1], len(s), i == min(s)[1]) for s in sets.values() for _, i in s}
    assert got == want
    assert len(groups(exact_dedup.dedup_against(table(spark, new), []))) == len(new)


def test_near_copies_without_ids_do_not_multiply(spark):
    """300 near copies, all without an id, and repeated ids: one row each, one group each, and texts fetched once a class."""
    draw = np.random.default_rng(1)
    base = [f"t{x}" for x in draw.integers(0, 5000, 80)]
    data = []
    for i in range(300):
        words = list(base)
        words[int(draw.integers(0, 80))] = f"e{i}"
        data.append((None if i < 200 else 7, " ".join(words)))
    df = table(spark, data)
    got = rows(near_dup.near_duplicates(df))
    assert len(got) == 300 and {r["component_id"] for r in got} == {7}
    d = near_dup.docs_view(df)
    keyed = d.withColumn("tie", F.xxhash64("text"))
    sets = near_dup.map_rows(keyed, near_dup._class_rows(0.75, 2, 5), "doc_id long, tie long, class binary, n_shingles long, roots array<long>, sig binary")
    classes = sets.select("class").distinct()
    assert near_dup._texts(d, sets, classes).count() == classes.count() == 300


def test_records_of_repeated_pages_have_their_own_ids(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>"), (1, "http://a", "<p>y</p>"), (1, "http://b", "<p>x</p>"), (2, "http://a", "<p>x</p>")],
                                  "page_id long, url string, html string")
    got = rows(warc.read(warc.write(pages, least=0)))
    assert len(got) == 4 and sum(r["record_type"] == "response" for r in got) == 3  # rows of one page and payload are that page
    def own(record):
        return re.search(rb"WARC-Record-ID: (\S+)", record)[1]
    ids = {own(warc.record(1, "http://a", b"x", 1, "D1", None)), own(warc.record(1, "http://a", b"y", 1, "D2", None)),
           own(warc.record(1, "http://a", None, 1, "D1", 1)), own(warc.record(1, "http://b", None, 1, "D1", 1))}
    assert len(ids) == 4
    refers = re.search(rb"WARC-Refers-To: (\S+)", warc.record(2, "http://a", None, 1, "D1", 1))[1]
    assert refers == own(warc.record(1, "http://a", b"x", 1, "D1", None))


def test_fit_takes_one_text_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_crf, "train", lambda sample: seen.append(len(sample)))
    docs = table(spark, [(3, f"line {i}\nother words {i}") for i in range(50)] + [(4, "good line")])
    ids = [r["doc_id"] for r in spark.range(3, 40).select(F.col("id").alias("doc_id")).filter(~quality_crf.held_out(F.col("doc_id"))).collect()]
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    quality_crf.fit(docs, labels)
    assert seen[0] == len({3, 4} & set(ids)) or seen[0] <= 2


def test_pipeline_run_and_quality_stage(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2)).withColumn("label", F.lit("taken"))
    out = p.quality(spark, odd, SF)
    assert out.columns == odd.columns and out.count() <= 5
    assert p.quality(spark, odd.limit(0), SF).count() == 0
    got = p.run(spark, SF)
    assert {"doc_id", "ids"} <= set(got.columns) and 0 < got.count() < docs.count()


# ---- surrogates ------------------------------------------------------------

def replaced(spark, *texts, key=b"k"):
    return [r["text"] for r in sorted(rows(pii.replace(table(spark, list(enumerate(texts))), key)), key=lambda r: r["doc_id"])]


def test_one_person_keeps_one_name(spark):
    out = replaced(spark, "Herr Karl Meier", "Herr Meier", "Dr Meier", "KARL MEIER", "Karl Meier", "Frau Schmidt", "Dr Schmidt", "Herr Hans Meier", "Frau Xenobia Meier")
    surname = out[0].split()[-1]
    assert surname != "Meier" and out[1] == f"Herr {surname}" and out[2] == f"Dr {surname}"
    given = out[0].split()[1]
    assert given in pii.GIVEN["latin", "m"] and given != "Karl"
    assert out[3] == f"{given} {surname}".upper() and out[4] == f"{given} {surname}"
    assert out[5].split()[-1] == out[6].split()[-1] not in ("Schmidt", surname)
    other, made = out[7].split(), out[8].split()
    assert other[-1] == surname and other[1] in pii.GIVEN["latin", "m"] and other[1] not in (given, "Hans")
    assert made[-1] == surname and made[1].endswith("a") and made[1] != "Xenobia"


def test_domains_and_mailboxes_stay_distinct(spark):
    mails = [f"{b}@{d}.com" for b in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghij"]
    out = replaced(spark, *mails)
    assert len(set(out)) == len(mails) and not set(out) & set(mails)
    domains = {}
    for old, new in zip(mails, out, strict=True):
        domains.setdefault(old.split("@")[1], set()).add(new.split("@")[1])
    assert all(len(v) == 1 for v in domains.values()) and len({min(v) for v in domains.values()}) == 10
    assert all(new.endswith(".com") for new in out)


def test_used_up_range_is_widened(spark, monkeypatch):
    """Half of a private range is taken: surrogates go on in the next one instead of drawing for ever."""
    e = spark.createDataFrame([("IP", f"192.168.{a}.{b}") for a in range(1, 255) for b in range(1, 150)], "kind string, canonical string")
    got = rows(pii.assigned(e, b"k"))
    made = [r["surrogate"] for r in got]
    assert len(set(made)) == len(made) == 254 * 149 and not set(made) & {r["canonical"] for r in got}
    assert all(m.startswith(("192.168.", "172.", "10.")) for m in made)
    monkeypatch.setattr(pii, "MOST_ROUNDS", 2)
    monkeypatch.setattr(pii, "surrogate", lambda *a: "same")
    with pytest.raises(RuntimeError, match="IP"):
        pii.assigned(e.limit(5), b"k")


def test_surrogates_of_all_documents_against_brute_force(spark):
    """Whole table: what is left holds none of the entities, equal canonical forms get equal surrogates, distinct ones distinct."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    after = {r["doc_id"]: r for r in rows(pii.replace(docs, b"k"))}
    seen, owners, n = {}, {}, 0
    for i, text in before.items():
        old, new = pii.find(text), after[i]["text"] or ""
        assert after[i]["n_entities"] == len(old)
        at = shift = 0
        for x in old:
            assert new[at + shift:x["start"] + shift] == text[at:x["start"]]  # what lies between stays
            body = x["body"]
            rest = [y for y in pii.find(new) if y["start"] == x["start"] + shift]
            assert rest and rest[0]["kind"] == x["kind"] and rest[0]["canonical"] != x["canonical"]
            made = rest[0]["canonical"]
            if x["kind"] != "PERSON":
                assert seen.setdefault((x["kind"], x["canonical"]), made) == made
                assert owners.setdefault((x["kind"], made), x["canonical"]) == x["canonical"]
            at, shift, n = x["end"], shift + len(rest[0]["body"]) - len(body), n + 1
        assert new[at + shift:] == text[at:]
    assert n > 0
