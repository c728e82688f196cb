"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import (bpe, centroids, decontaminate, exact_dedup, fingerprint, importance, near_dup, pii, quality_crf, secrets, substring_dedup,
                            token_files, warc)
from ledgerfold.llm.common import docs_view
from ledgerfold.sources.tables import table

#: Stands in for a secret from the cluster's key store; runs with one key agree with one another.
PII_KEY = b"surrogate-key-of-this-run"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BLANK = "[\\x20\\x09-\\x0D]"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with an odd hash are the sealed snapshot, the others the new batch."""
    docs = table(spark, sf_dir, "documents")
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    out = exact_dedup.dedup(docs.filter(~odd), docs.filter(odd))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), PII_KEY)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents"), TOKENIZER, end_id=0)
    files = token_files.read(manifest, manifest.count())
    return files.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"), least=0)
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", *secrets.digest_columns())


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: whether one of their windows matches a benchmark item, which items, and the highest similarity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.transform("matches", lambda m: m["item_id"]).alias("item_ids"),
                      F.round(F.array_max(F.transform("matches", lambda m: m["similarity"])), 6).alias("similarity"))


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    out = quality_crf.score(docs, model)
    return out.select("doc_id", quality_crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_view(table(spark, sf_dir, "documents"))
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, RANKS).select("doc_id", *bpe.digest_columns())


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark texts."""
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    out = rows.join(F.broadcast(centroids.summary(rows, found)), "cluster")  # a row per cluster
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprint.edited_halves(table(spark, sf_dir, "documents"))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return f.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint.text_form(a).alias("fingerprint"),
                    fingerprint.text_form(b).alias("edited_fingerprint"), fingerprint.resemblance(a, b).alias("near_edited"),
                    fingerprint.resemblance(a, c).alias("near_next"), fingerprint.n_distinct(a).alias("shingles"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_exact_dedup, op2_pii_surrogates, op3_token_files, op4_warc, op5_near_dup, op6_substring_dedup, op7_secret_scan, op8_decontaminate, op9_quality_crf, op10_bpe,
    op11_importance, op12_centroids, op13_fingerprints)}



def _clustering_sql(clusters: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS, seed: int = centroids.SEED) -> str:
    """The rounds written out, with every vector compared with every centroid."""
    parts = [f"""v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor({centroids.SCALE} * cast(x as double)) as bigint)) as x from embeddings
        where len(embedding) = {centroids.COMPONENTS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {centroids.COMPONENTS}),
        c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c, x as m from v order by sha256('{seed}:' || vec_id) limit {clusters})"""]
    for r in range(rounds + 1):
        parts.append(f"""d{r} as (select vec_id, x, c, list_sum(list_transform(range({centroids.COMPONENTS}), lambda i: (x[i + 1] - m[i + 1]) * (x[i + 1] - m[i + 1]))) as d from v, c{r}),
        a{r} as materialized (select vec_id, any_value(x) as x, arg_min(c, (d, c)) as c, min(d) as d from d{r} group by vec_id)""")
        if r < rounds:
            parts.append(f"""s{r} as (select c, i, sum(x[i]) as s, count(*) as n from a{r}, range(1, {centroids.COMPONENTS} + 1) as t(i) group by c, i),
        f{r} as (select c, list(cast((s - ((s % n) + n) % n) / n as bigint) order by i) as m from s{r} group by c),
        c{r + 1} as materialized (select c, coalesce(f{r}.m, c{r}.m) as m from c{r} left join f{r} using (c))""")
    return f"""with {", ".join(parts)}
        select vec_id, cast(c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
          cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256 from a{rounds} join c{rounds} using (c)"""


SQL: dict[str, str] = {
    "op11_importance": f"""
        with x as (select 'd' as src, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
        w as (select src, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from x),
        f as materialized (select src, id, f, count(*) as n from (select src, id, unnest([w, w || ' ' || lead(w) over (partition by src, id order by i)]) as f
            from (select src, id, unnest(ws) as w, generate_subscripts(ws, 1) as i from w)) where f is not null group by all),
        h as (select f, hex(encode(f)) as b from (select distinct f from f)),
        b as materialized (select f, xor(list_reduce(list_transform(range(len(b) // 2), lambda i: cast('0x' || b[2 * i + 1:2 * i + 2] as bigint)),
            lambda c, y: list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(c, y)), 4294967295), 4294967295) % {importance.BUCKETS} as bucket from h),
        c as (select bucket, coalesce(sum(n) filter (src = 'd'), 0) as s, coalesce(sum(n) filter (src = 'b'), 0) as t from f join b using (f) group by 1),
        z as (select sum(s) as s, sum(t) as t from c),
        g as materialized (select bucket, cast(floor(1000 * ln((cast(c.t as double) + 1) * (cast(z.s as double) + {importance.BUCKETS}) / ((cast(c.s as double) + 1) * (cast(z.t as double) + {importance.BUCKETS})))) as bigint) as gain from c, z),
        q as (select id as doc_id, sum(n) as k, sum(n * gain) as total from f join b using (f) join g using (bucket) where src = 'd' group by 1),
        p as (select w.id as doc_id, len(ws) as n_words, cast(coalesce(k, 0) as bigint) as n_features, cast(coalesce((total - ((total % k) + k) % k) / k, 0) as bigint) as weight,
            cast('0x' || sha256('{importance.SEED}:' || w.id)[1:8] as bigint) as h from w left join q on q.doc_id = w.id where src = 'd'),
        e as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from p),
        r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from e where n_words >= {importance.LEAST_WORDS})
        select e.doc_id, n_features, weight, score, case when rank <= {importance.PERCENT} * r.n // 100 then rank end as rank from e left join r using (doc_id)""",
    "op12_centroids": _clustering_sql(),
    "op13_fingerprints": f"""
        with d as materialized (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars from documents),
        l as (select *, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as after from d),
        e as materialized (select doc_id, n_chars, text, left(text, n_chars - n_chars // 2) || left(after, n_chars // 2) as edited, after from l),
        s as materialized (select doc_id, kind, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANK}+'), lambda x: x <> '') as ws
            from (select doc_id, 'own' as kind, text as t from e union all select doc_id, 'edited', edited from e union all select doc_id, 'next', after from e)),
        h as (select doc_id, kind, left(md5(array_to_string(ws, ' ')), {fingerprint.DIGITS}) as h from s where len(ws) between 1 and {fingerprint.WIDTH - 1} union
            select doc_id, kind, left(md5({" || ' ' || ".join(["w"] + [f"lead(w, {i}) over o" for i in range(1, fingerprint.WIDTH)])}), {fingerprint.DIGITS})
            from (select doc_id, kind, unnest(ws) as w, generate_subscripts(ws, 1) as i from s) window o as (partition by doc_id, kind order by i)),
        k as (select s.doc_id, s.kind, coalesce(sk, []) as sk from s left join (select doc_id, kind, list(h order by h)[1:{fingerprint.K}] as sk from h where h is not null group by 1, 2) x
            on x.doc_id = s.doc_id and x.kind = s.kind),
        p as (select doc_id, any_value(sk) filter (kind = 'own') as a, any_value(sk) filter (kind = 'edited') as b, any_value(sk) filter (kind = 'next') as c from k group by 1),
        u as (select *, list_sort(list_distinct(list_concat(a, b)))[1:{fingerprint.K}] as ab, list_sort(list_distinct(list_concat(a, c)))[1:{fingerprint.K}] as ac from p)
        select doc_id, n_chars, sha256(edited) as edited_sha256, array_to_string(a, ',') as fingerprint, array_to_string(b, ',') as edited_fingerprint,
          case when len(ab) = 0 then 1.0::double else len(list_intersect(list_intersect(ab, a), b))::double / len(ab) end as near_edited,
          case when len(ac) = 0 then 1.0::double else len(list_intersect(list_intersect(ac, a), c))::double / len(ac) end as near_next,
          case when len(a) < {fingerprint.K} then len(a)::double else {fingerprint.K - 1}::double / (cast('0x' || left(a[-1], 13) as bigint)::double / {16 ** 13}::double) end as shingles
        from u join e using (doc_id)""",
    "op1_exact_dedup": f"""
        with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g')) as text_sha256 from documents),
        g as (select text_sha256, arg_min(doc_id, (-n, doc_id)) as keep_id, count(*) as group_size from d group by 1)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, d.text_sha256 from d join g using (text_sha256)""",
    "op4_warc": """
        with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
        g as (select html, min(page_id) as first_id from p group by 1),
        n as (select p.*, first_id, '0b' || '' as z from p join g using (html)),
        b as (select *, list_transform(range(40), lambda i: instr('0123456789abcdef', h[i + 1]) - 1) as x from n)
        select page_id, payload_bytes,
          array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + cast(
            (((x[1 + (5 * i) // 4] * 16 + coalesce(x[2 + (5 * i) // 4], 0)) >> (3 - (5 * i) % 4)) & 31) as int)]), '') as payload_digest,
          case when page_id = first_id then 'response' else 'revisit' end as record_type,
          case when page_id <> first_id then first_id end as refers_to from b""",
    "op5_near_dup": f"""
        with recursive w as materialized (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANK}+'), lambda x: x <> '') as ws from documents),
        s as materialized (select distinct doc_id, sh from (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
            else list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) end) as sh from w)),
        n as materialized (select w.doc_id, coalesce(c, 0) as n_shingles from w left join (select doc_id, count(*) as c from s group by 1) using (doc_id)),
        l as materialized (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
        e as materialized (select x, y from l join n p on p.doc_id = x join n q on q.doc_id = y where 100 * shared >= 75 * (p.n_shingles + q.n_shingles - shared)),
        e2 as materialized (select x, y from e union all select y, x from e),
        r(doc_id, c) as (select doc_id, doc_id from documents union select e2.y, r.c from r join e2 on e2.x = r.doc_id where r.c < e2.y)
        select n.doc_id, n.n_shingles, min(r.c) as component_id, n.doc_id = min(r.c) as kept from n join r on r.doc_id = n.doc_id group by 1, 2""",
    "op6_substring_dedup": f"""
        with w as materialized (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '') as ws from documents),
        s as materialized (select doc_id, i, array_to_string(ws[i + 1:i + 50], ' ') as win from (select doc_id, ws, unnest(range(len(ws) - 49)) as i from w)),
        f as (select win, min(doc_id) as low from s group by 1),
        hit as (select distinct doc_id, i + k as p from (select s.doc_id, i, unnest(range(50)) as k from s join f using (win) where low < doc_id)),
        gone as materialized (select doc_id, list(p) as ps from hit group by 1)
        select w.doc_id, len(ws) as n_words, coalesce(len(ps), 0) as n_removed,
          sha256(array_to_string(case when ps is null then ws else list_transform(list_filter(range(len(ws)), lambda i: not list_contains(ps, i)), lambda i: ws[i + 1]) end, ' ')) as kept_sha256
        from w left join gone using (doc_id)""",
}
