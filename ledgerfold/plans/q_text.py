"""Catalogue: text tracks, vocabularies, bag of words, TF-IDF, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions import text as tx
from ledgerfold.operators import text as ot
from ledgerfold.plans.common import rounded
from ledgerfold.plans.registry import query
from ledgerfold.session import materialize
from ledgerfold.sources import bindings
from ledgerfold.sources.tables import spread


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


EN = _sql_list(tx.ENGLISH_STOP_WORDS)
TOPIC = _sql_list(tx.TOPIC_STOP_WORDS)


def LT(x):
    return (f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(COALESCE({x}, '')), '[^a-z\\s]', ' ', 'g'), "
            f"'\\s+', ' ', 'g')), ' '), lambda t: length(t) > 2)")


def TT(x):
    s = f"trim(regexp_replace(regexp_replace(lower(COALESCE({x}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return (f"CASE WHEN length({s}) < 3 THEN []::VARCHAR[] ELSE list_filter(string_split({s}, ' '), "
            f"lambda t: length(t) > 2 AND regexp_full_match(t, '[a-z]+') AND NOT list_contains({TOPIC}, t)) END")


def docs(spark, sf_dir):
    return spread(bindings.table(spark, sf_dir, "documents").select("doc_id", "text"))


def track_a(spark, sf_dir, min_len: int = 100):
    """F7 + T3/T5 + F8: documents ≥ 100 chars, topic tokens, non-empty."""
    return track_a_of(docs(spark, sf_dir), min_len=min_len)


def track_a_of(d, *more: str, min_len: int = 100):
    d = d.filter(F.length("text") >= min_len)
    return (d.select("doc_id", *more, tx.once("tokens", tx.topic_tokens("text")))
             .withColumn("token_count", F.size("tokens")).filter(F.col("token_count") > 0))


_TRACK_A_SQL = (f"(SELECT doc_id, tokens, len(tokens) AS token_count FROM (SELECT doc_id, {TT('text')} AS tokens "
                f"FROM documents WHERE length(text) >= 100) x WHERE len(tokens) > 0)")


@query("light_clean", f"""
SELECT doc_id, array_to_string(tk, ' ') AS tfidf_text, CAST(len(tk) AS INTEGER) AS tfidf_word_count
FROM (SELECT doc_id, {LT('text')} AS tk FROM documents) x""")
def light_clean(spark, sf_dir):
    """Track B light cleaning of every document."""
    d = docs(spark, sf_dir).select("doc_id", tx.light_tokens("text").alias("tk"))
    return d.select("doc_id", F.array_join("tk", " ").alias("tfidf_text"), F.size("tk").alias("tfidf_word_count"))


@query("light_clean_alpha", """
SELECT doc_id, array_to_string(tk, ' ') AS tokens_text, CAST(len(tk) AS INTEGER) AS n_tokens
FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '\\s+'),
                                 lambda t: length(t) > 2 AND regexp_full_match(t, '\\p{L}+')) AS tk FROM documents) x""")
def light_clean_alpha(spark, sf_dir):
    """Whitespace tokens kept only when purely alphabetic (any script) and longer than 2."""
    d = docs(spark, sf_dir).select("doc_id", tx.alpha_tokens("text").alias("tk"))
    return d.select("doc_id", F.array_join("tk", " ").alias("tokens_text"), F.size("tk").alias("n_tokens"))


@query("topic_tokens", f"""
SELECT doc_id, array_to_string(tokens, ' ') AS tokens_text, CAST(token_count AS INTEGER) AS token_count FROM {_TRACK_A_SQL} a""")
def topic_tokens(spark, sf_dir):
    """Track A topic tokens (stop list = English ∪ domain; no lemma lexicon)."""
    return track_a(spark, sf_dir).select("doc_id", F.array_join("tokens", " ").alias("tokens_text"), "token_count")


@query("token_frequency", f"""
SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS rank FROM (
  SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(tokens) AS token FROM {_TRACK_A_SQL} a) u
  GROUP BY token ORDER BY n DESC, token LIMIT 20) t""")
def token_frequency(spark, sf_dir):
    """The 20 most frequent Track A tokens."""
    return ot.token_frequency(track_a(spark, sf_dir), "tokens", 20)


@query("vocabulary_profile", f"""
SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(count(*) FILTER (WHERE len(tokens) = 0) AS BIGINT) AS n_empty,
  CAST(sum(len(tokens)) AS BIGINT) AS n_tokens, round(sum(len(tokens)) * 1.0 / count(*), 6) AS avg_tokens,
  (SELECT CAST(count(DISTINCT token) AS BIGINT) FROM (SELECT unnest(tokens) AS token FROM {_TRACK_A_SQL} b) u) AS n_vocabulary
FROM {_TRACK_A_SQL} a""")
def vocabulary_profile(spark, sf_dir):
    """Vocabulary size, average tokens and empty documents of Track A."""
    return rounded(ot.vocabulary_profile(track_a(spark, sf_dir), "tokens"))


def _bigram_sql():
    u = f"list_filter({LT('text')}, lambda t: NOT list_contains({EN}, t))"
    return (f"(SELECT doc_id, list_transform(range(0, len(u) - 1), lambda i: u[i + 1] || ' ' || u[i + 2]) AS bi "
            f"FROM (SELECT doc_id, {u} AS u FROM documents) x)")


@query("bigrams", f"""
SELECT term, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS df
FROM (SELECT doc_id, unnest(bi) AS term FROM {_bigram_sql()} b) u GROUP BY term""")
def bigrams(spark, sf_dir):
    """Bigrams formed after English stop removal, with corpus count and df."""
    d = docs(spark, sf_dir).select("doc_id", tx.remove_stops(tx.light_tokens("text")).alias("u"))
    bi = d.select("doc_id", tx.bigrams_only(F.col("u")).alias("bi"))
    tc = ot.term_counts(bi, "doc_id", "bi")
    return ot.doc_frequency(tc, "doc_id").select(
        "term", F.col("cf").cast("bigint").alias("n"), F.col("df").cast("bigint").alias("df"))


_VOCAB_SQL = f"""(SELECT term, df FROM (
  SELECT term, CAST(count(*) AS BIGINT) AS df FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM {_TRACK_A_SQL} a) u GROUP BY term) d,
  (SELECT count(*) AS n_docs FROM {_TRACK_A_SQL} a2) n
  WHERE df >= 15 AND df <= floor(n_docs * 0.5) ORDER BY df DESC, term LIMIT 100000)"""


@query("vocab_filter", f"SELECT term, df FROM {_VOCAB_SQL} v")
def vocab_filter(spark, sf_dir):
    """Topic vocabulary, df ≥ 15 and df ≤ int(0.5·N)."""
    return ot.vocab_filter(track_a(spark, sf_dir), "doc_id", "tokens", 15, 0.5)


@query("bag_of_words", f"""
SELECT doc_id, term, CAST(count(*) AS BIGINT) AS count
FROM (SELECT doc_id, unnest(tokens) AS term FROM {_TRACK_A_SQL} a) u SEMI JOIN {_VOCAB_SQL} v USING (term)
GROUP BY doc_id, term""")
def bag_of_words(spark, sf_dir):
    """(doc, term, count) over the filtered topic vocabulary."""
    ta = materialize(track_a(spark, sf_dir).select("doc_id", "tokens"))  # two consumers: vocabulary and counts
    vocab = ot.vocab_filter(ta, "doc_id", "tokens", 15, 0.5)
    return ot.bag_of_words(ta, "doc_id", "tokens", vocab) \
        .select("doc_id", "term", F.col("count").cast("bigint").alias("count"))


_TFIDF_SQL = f"""
WITH c AS (SELECT doc_id, tk FROM (SELECT doc_id, {LT('text')} AS tk FROM documents) x WHERE len(tk) > 0),
u AS (SELECT doc_id, list_filter(tk, lambda t: NOT list_contains({EN}, t)) AS u FROM c),
g AS (SELECT doc_id, u || list_transform(range(0, len(u) - 1), lambda i: u[i + 1] || ' ' || u[i + 2]) AS terms FROM u),
tc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM g) e GROUP BY doc_id, term),
n AS (SELECT count(*) AS n_docs FROM c),
d AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tc GROUP BY term),
v AS (SELECT term, df, n_docs FROM d, n WHERE df >= 10 AND df <= n_docs * 0.5 ORDER BY cf DESC, term LIMIT 500),
w AS (SELECT doc_id, term, tf, tf * (ln((1 + n_docs) / (1 + df)) + 1) AS raw FROM tc JOIN v USING (term))"""


def _tfidf(spark, sf_dir):
    d = docs(spark, sf_dir)
    corpus = ot.tfidf_corpus(d, "doc_id", "text")
    n = ot.corpus_size(d, "text")
    return n, ot.tfidf(corpus, "doc_id", "tokens", max_features=500, min_df=10, max_df=0.5, n_docs=n)


@query("tfidf_sql", _TFIDF_SQL + """
SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_sql(spark, sf_dir):
    """Smooth-idf TF-IDF with +1, L2 rows, 500 uni+bigram features (df 10..0.5·N)."""
    _, w = _tfidf(spark, sf_dir)
    return rounded(w.select("doc_id", "term", F.col("tf").cast("bigint").alias("tf"), "weight"))


@query("tfidf_top_terms", _TFIDF_SQL + """,
nw AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w)
SELECT term, round(sum(weight) / max(n_docs), 6) AS mean_weight FROM nw, n GROUP BY term
ORDER BY sum(weight) / max(n_docs) DESC, term LIMIT 20""")
def tfidf_top_terms(spark, sf_dir):
    """Top 20 terms by mean TF-IDF weight over the corpus."""
    n, w = _tfidf(spark, sf_dir)
    return rounded(ot.tfidf_top_terms(w, n, 20))


@query("tfidf_density", _TFIDF_SQL + """
SELECT CAST((SELECT n_docs FROM n) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS nnz,
       round(count(*) * 1.0 / (SELECT n_docs FROM n), 6) AS avg_nnz_per_doc FROM w""")
def tfidf_density(spark, sf_dir):
    """Average non-zero features per document."""
    n, w = _tfidf(spark, sf_dir)
    nd = n.select("n_docs").scalar()
    return rounded(w.agg(F.count(F.lit(1)).alias("nnz")).select(
        nd.alias("n_docs"), "nnz", (F.col("nnz") * 1.0 / nd).alias("avg_nnz_per_doc")))


@query("overlap_chunks", """
SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_idx, array_to_string(words[s + 1 : s + 80], ' ') AS chunk_text,
       CAST(len(words[s + 1 : s + 80]) AS INTEGER) AS n_words
FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 8 - 1, 0) + 1, 72)) AS s,
             generate_subscripts(range(0, greatest(len(words) - 8 - 1, 0) + 1, 72), 1) AS k
      FROM (SELECT doc_id, list_filter(regexp_split_to_array(trim(COALESCE(text, '')), '\\s+'), lambda w: length(w) > 0) AS words
            FROM documents) d WHERE len(words) > 0) x""")
def overlap_chunks(spark, sf_dir):
    """80-word windows with 10 % overlap over every document."""
    return ot.chunks(docs(spark, sf_dir), "doc_id", "text", 80, 8).select("doc_id", "chunk_idx", "chunk_text", "n_words")
