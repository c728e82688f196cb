"""Corpus operators: vocabularies, bag of words, TF-IDF, token statistics, chunks.

Documents are exploded to (doc, term) rows and counted with partial
aggregation; vocabularies are bounded (``max_features``) before they are
broadcast. No corpus-wide array is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions import text as tx
from ledgerfold.session import materialize


def term_counts(docs: DataFrame, key: str, terms_col: str) -> DataFrame:
    """(key, term, tf) from an array column of terms."""
    return (docs.select(key, F.explode(terms_col).alias("term"))
                .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))


def doc_frequency(tc: DataFrame, key: str) -> DataFrame:
    """(term, df, cf): documents containing the term and corpus count."""
    return tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def vocab_filter(docs: DataFrame, key: str, tokens_col: str, no_below: int = 15, no_above: float = 0.5,
                 keep_n: int = 100_000) -> DataFrame:
    """Keep tokens with df ≥ no_below and df ≤ int(no_above·N); at most keep_n by df. One partial-aggregated pass
    over each document's distinct tokens; no (document, token) row is shuffled."""
    d = docs.select(F.explode(F.array_distinct(tokens_col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    d = d.withColumn("n_docs", docs.agg(F.count(F.lit(1))).scalar())
    kept = d.filter((F.col("df") >= no_below) & (F.col("df") <= F.floor(F.col("n_docs") * no_above)))
    return kept.orderBy(F.desc("df"), "term").limit(keep_n).select("term", "df")


def bag_of_words(docs: DataFrame, key: str, tokens_col: str, vocab: DataFrame) -> DataFrame:
    """(key, term, count) restricted to the vocabulary (broadcast: size ≤ keep_n) before anything is shuffled."""
    own = docs.select(key, F.explode(tokens_col).alias("term")).join(F.broadcast(vocab.select("term")), "term", "left_semi")
    return own.groupBy(key, "term").agg(F.count(F.lit(1)).alias("count"))


def tfidf_corpus(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """Track B corpus: light-cleaned text, word count, non-empty docs only (F8)."""
    return (docs.select(key, tx.once("tokens", tx.light_tokens(text_col)))
                .withColumn("tfidf_word_count", F.size("tokens"))
                .filter(F.col("tfidf_word_count") > 0))


def top_terms(terms: DataFrame, key: str, terms_col: str, max_features: int, min_df: int, max_df: float, n_docs) -> DataFrame:
    """(term, df, n_docs) of the ``max_features`` terms of largest corpus count with min_df ≤ df ≤ max_df·N (ties by term).

    Vocabulary first: corpus counts alone cover all terms (one partial-aggregated pass of (term, count), no document
    keys); document frequencies are counted for the most frequent terms only, twice as many whenever the
    filter left too few. So (document, term) rows exist for candidates alone.
    """
    cf = materialize(terms.select(F.explode(terms_col).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cf")).filter(F.col("cf") >= min_df))
    n_terms, take = cf.count(), 2 * max_features
    while True:
        first = F.broadcast(materialize(cf.orderBy(F.desc("cf"), "term").limit(take)))  # take rows
        df = terms.select(F.explode(F.array_distinct(terms_col)).alias("term")).join(first, "term").groupBy("term", "cf").agg(F.count(F.lit(1)).alias("df"))
        d = df.withColumn("n_docs", n_docs)
        kept = materialize(d.filter((F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * max_df)))
        if take >= n_terms or kept.count() >= max_features:
            return kept.orderBy(F.desc("cf"), "term").limit(max_features).select("term", "df", "n_docs")
        take *= 2


def tfidf(corpus: DataFrame, key: str, tokens_col: str = "tokens", max_features: int = 500, min_df: int = 10,
          max_df: float = 0.5, stop_words=tx.ENGLISH_STOP_WORDS, n_docs: DataFrame | None = None) -> DataFrame:
    """(key, term, weight) with weight = tf·(ln((1+N)/(1+df))+1), rows L2-normalised.

    Terms: uni+bigrams after stop removal; vocabulary: min_df ≤ df ≤ max_df·N,
    then the ``max_features`` most frequent by corpus count (ties by term).
    The vocabulary (≤ max_features rows) is the only broadcast side; (document,
    term) rows are made for its terms alone.
    """
    kept = corpus.select(key, tx.once("u", tx.remove_stops(tokens_col, stop_words)))
    terms = materialize(kept.select(key, tx.uni_bigrams(F.col("u")).alias("terms")))  # read by three passes
    n_docs = n_docs if n_docs is not None else corpus.agg(F.count(F.lit(1)).alias("n_docs"))
    vocab = materialize(top_terms(terms, key, "terms", max_features, min_df, max_df, n_docs.select("n_docs").scalar()))
    own = terms.select(key, F.explode("terms").alias("term")).join(F.broadcast(vocab), "term")
    w = own.groupBy(key, "term", "df", "n_docs").agg(F.count(F.lit(1)).alias("tf")).withColumn(
        "raw", F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))  # ≤ max_features rows per doc
    return w.select(key, "term", "tf", (F.col("raw") / norm).alias("weight"))


def corpus_size(docs: DataFrame, text_col: str) -> DataFrame:
    """N of the Track B corpus (documents with a light token) without tokenising: one row."""
    return docs.filter(tx.has_light_token(text_col)).agg(F.count(F.lit(1)).alias("n_docs"))


def tfidf_top_terms(weights: DataFrame, n_docs: DataFrame, k: int = 20) -> DataFrame:
    """Mean weight per term over all corpus documents (absent = 0), top k."""
    return (weights.groupBy("term").agg(F.sum("weight").alias("s"))
                   .select("term", (F.col("s") / n_docs.select("n_docs").scalar()).alias("mean_weight"))
                   .orderBy(F.desc("mean_weight"), "term").limit(k))


def token_frequency(docs: DataFrame, tokens_col: str, k: int = 20) -> DataFrame:
    """The k most frequent tokens (ties by token) with their rank."""
    counts = docs.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")))  # k rows


def vocabulary_profile(docs: DataFrame, tokens_col: str) -> DataFrame:
    """Documents, empty ones (NULL too), tokens, tokens a document and vocabulary size.

    The vocabulary is counted as distinct tokens, each reduced before it is shuffled.
    """
    per = docs.select(F.coalesce(F.size(tokens_col), F.lit(0)).alias("k"))
    sizes = per.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("k") <= 0).alias("n_empty"),
                    F.sum(F.greatest("k", F.lit(0))).cast("bigint").alias("n_tokens"))
    words = docs.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("n_vocabulary"))
    return sizes.withColumn("n_vocabulary", words.scalar()).withColumn("avg_tokens", F.try_divide("n_tokens", "n_docs"))


def chunks(docs: DataFrame, key: str, text_col: str, size: int = 80, overlap: int = 8) -> DataFrame:
    """(key, chunk_idx, n_words, chunk_text) overlapping word windows."""
    return (docs.select(key, F.posexplode(tx.word_windows(text_col, size, overlap)).alias("chunk_idx", "chunk_text"))
                .withColumn("n_words", F.size(F.split("chunk_text", " "))))
