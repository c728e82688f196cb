"""Record linkage of program records to contract/document texts.

Every link type is an equi-join on a blocking key followed by an exact check,
so no side is broadcast unless its size is fixed, and no all-pairs product
is formed:

* substring (J9): if a name occurs in a text, the name's interior
  whitespace tokens occur there as whole tokens; each name is joined on its
  *rarest* interior token bigram, then ``contains`` verifies. Names with
  fewer than four tokens have one anchor: the middle token of three, the longer
  of two, a single one. Anchors meet the distinct tokens of all texts (the
  vocabulary, not the texts) through an index of character 3-grams, again by
  the anchor's rarest gram, and the tokens that hold an anchor lead to texts.
* token (J8/G3): distinctive tokens (parenthesised acronyms, tokens mixing
  letters and digits) joined on equality; or the k best documents of each
  program by inverse document frequency, which stays small however many
  documents share a token.
* fuzzy (J10): token-set Jaccard ≥ t found with the exact prefix filter:
  tokens ordered by (document frequency, token); two sets with Jaccard ≥ t
  share a token within their first |s| − ceil(t·|s|) + 1 tokens. Tokens that
  the left side lacks come first and are only counted, so of the right side its
  known tokens are shuffled once, and the similarity follows from them and the
  sets' sizes.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions import text as tx
from ledgerfold.session import materialize

ACRONYM = r"\(([A-Z0-9 -]+)\)"
MODEL_NUMBER = r"^([A-Za-z]+-?[0-9][A-Za-z0-9-]*|[0-9]+-?[A-Za-z][A-Za-z0-9-]*)$"

GRAM = 3
BROADCAST_ROWS = 200_000  # a counted table of at most this many short rows goes to all tasks
RARE = 1000  # a token of more documents is common: it is scored, but leads to documents by their classes alone


def _tokens(col):
    return F.filter(F.split(F.coalesce(F.col(col), F.lit("")), r"\s+"), lambda t: F.length(t) > 0)


def distinctive_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token) for parenthesised acronyms and letter+digit tokens (upper-cased, distinct)."""
    acr = F.regexp_extract_all(F.col(text), F.lit(ACRONYM), 1)
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"[^A-Za-z0-9-]+")
    mdl = F.filter(words, lambda t: t.rlike(MODEL_NUMBER))
    toks = F.array_union(F.transform(acr, lambda t: F.upper(F.trim(t))), F.transform(mdl, lambda t: F.upper(t)))
    return df.select(key, F.explode(F.array_distinct(toks)).alias("token")).filter(F.length("token") > 0)


def link_token(programs: DataFrame, p_key: str, p_name: str, docs: DataFrame, d_key: str, d_text: str) -> DataFrame:
    """Pairs sharing a distinctive token; score 100, token_match."""
    pt = distinctive_tokens(programs, p_key, p_name)
    dt = distinctive_tokens(docs, d_key, d_text)
    return (pt.join(dt, "token").select(p_key, d_key).distinct()
              .withColumn("match_score", F.lit(100)).withColumn("match_type", F.lit("token_match")))


def token_weights(doc_tokens: DataFrame, d_key: str, docs: DataFrame) -> DataFrame:
    """(token, df, weight): inverse document frequency in thousandths, 1000 ln(1 + N / df) floored, so that sums are exact."""
    n = docs.select(d_key).distinct().agg(F.count(F.lit(1))).scalar()
    df = doc_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("weight", F.floor(1000 * F.log(1 + n / F.col("df"))).cast("bigint"))


def link_token_top(programs: DataFrame, p_key: str, p_name: str, docs: DataFrame, d_key: str, d_text: str, k: int = 5, rare: int = RARE) -> DataFrame:
    """J8, weighted: the k documents that share the most weight of distinctive tokens with each program (ties to the
    smaller document key) -> (p_key, d_key, weight, n_shared, rank).

    Two phases. Documents that share a rare token are scored on those alone; where a program's k-th best such score
    beats the sum of all its common tokens, no other document can be among its k best. The other programs also meet, of
    each set of common tokens that documents have, the k documents of smallest key: documents without a shared rare
    token score by that set alone. Common tokens are then added to the candidates' scores. So a token that all
    documents hold costs k rows a set, not a row a document.
    """
    pt = materialize(distinctive_tokens(programs, p_key, p_name).select(F.col(p_key).alias("_p"), "token").filter(F.col("_p").isNotNull()).distinct())
    dt = distinctive_tokens(docs, d_key, d_text).select(F.col(d_key).alias("_d"), "token").filter(F.col("_d").isNotNull()).distinct()
    weights = token_weights(dt, "_d", docs.filter(F.col(d_key).isNotNull()).select(F.col(d_key).alias("_d")))
    known = materialize(weights.join(pt.select("token").distinct(), "token", "left_semi"))  # tokens of both sides
    dt = materialize(dt.join(known, "token"))
    pt = materialize(pt.join(known, "token"))
    first = pt.filter(F.col("df") <= rare).select("_p", "token", "weight").join(dt.select("_d", "token"), "token").groupBy("_p", "_d").agg(
        F.sum("weight").alias("low"))
    w = Window.partitionBy("_p").orderBy(F.desc("low"), "_d")
    kth = first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).groupBy("_p").agg(F.min("low").alias("kth"), F.max("_r").alias("n"))
    reach = pt.groupBy("_p").agg(F.sum(F.when(F.col("df") > rare, F.col("weight")).otherwise(0)).alias("more"))
    reach = materialize(reach.join(kth, "_p", "left").withColumn("sure", F.coalesce((F.col("n") >= k) & (F.col("kth") > F.col("more")), F.lit(False))))
    # a candidate that its program's common tokens can't lift to the k-th best score is dropped
    near = first.join(reach, "_p").filter(~F.col("sure") | (F.col("low") + F.col("more") >= F.col("kth"))).select("_p", "_d")
    common = dt.filter(F.col("df") > rare)
    kinds = common.groupBy("_d").agg(F.array_sort(F.collect_list("token")).alias("kind"))  # one document's tokens
    w = Window.partitionBy("kind").orderBy("_d")
    heads = kinds.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("_d", F.explode("kind").alias("token"))
    open_ = pt.filter(F.col("df") > rare).join(reach.filter(~F.col("sure")).select("_p"), "_p", "left_semi")
    candidates = near.unionByName(open_.select("_p", "token").join(heads, "token").select("_p", "_d")).distinct()
    scores = candidates.join(dt.select("_d", "token", "weight"), "_d").join(pt.select("_p", "token"), ["_p", "token"]).groupBy("_p", "_d").agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_shared"))
    w = Window.partitionBy("_p").orderBy(F.desc("weight"), "_d")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        F.col("_p").alias(p_key), F.col("_d").alias(d_key), "weight", "n_shared", "rank")


def _rarest_key_links(names: DataFrame, p_key: str, doc_keys: DataFrame, d_key: str) -> DataFrame:
    """Candidates: each name's keys (p_key, bg) against the documents' (d_key, bg), by the name's rarest key alone."""
    # document keys that are some name's key, before anything is shuffled twice
    known = doc_keys.join(names.select("bg").distinct(), "bg", "left_semi").distinct()
    df_bg = known.groupBy("bg").agg(F.count(F.lit(1)).alias("df"))
    rare = names.join(df_bg, "bg").groupBy(p_key).agg(F.min_by("bg", F.struct("df", "bg")).alias("bg"))
    return rare.join(known, "bg").select(p_key, d_key).distinct()


def _grams(col: str):
    """The distinct character 3-grams of a string, and those of one and two characters."""
    def of(size: int):
        last = F.length(col) - (size - 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(F.col(col), i, F.lit(size)))).otherwise(
            F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(size) for size in range(1, GRAM + 1)]))


def tokens_holding(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(part, token): the tokens of ``vocabulary`` (token) that contain each of ``parts`` (part), which are not empty."""
    size = F.least(F.length("part"), F.lit(GRAM))
    keyed = parts.select("part", F.explode(F.filter(_grams("part"), lambda g: F.length(g) == size)).alias("bg"))
    at = vocabulary.filter(F.length("token") > 0).select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("_i"))
    of = at.select("token", F.explode(F.array(*[F.substring("token", F.col("_i"), F.lit(size)) for size in range(1, GRAM + 1)])).alias("bg"))
    return _rarest_key_links(keyed, "part", of, "token").filter(F.col("token").contains(F.col("part")))


def _short_candidates(short: DataFrame, p_key: str, p_name: str, docs: DataFrame, d_key: str, d_text: str) -> DataFrame:
    """(p_key, d_key) of the texts that can hold a name (p_key, p_name, _t, _n) of three tokens at most."""
    one, two = F.col("_t")[0], F.get("_t", F.lit(1))
    anchor = (F.when(F.col("_n") == 3, two).when(F.col("_n") == 1, one)
              .when(F.col("_n") == 2, F.when(F.length(one) >= F.length(two), one).otherwise(two)).otherwise(F.col(p_name)))
    whole, blank = F.col("_n") == 3, F.col("_n") == 0
    docs = docs.filter(F.col(d_key).isNotNull())  # a null key is linked with nothing
    anchors = materialize(short.select(p_key, anchor.alias("part"), whole.alias("whole"), blank.alias("blank")))
    tokens = docs.select(d_key, F.explode(F.array_distinct(_tokens(d_text))).alias("token"))
    found = anchors.filter("whole").join(tokens, F.col("part") == F.col("token")).select(p_key, d_key)
    # a name of blanks alone lies in a run of blanks, any other anchor in a token
    for runs, which in ((tokens, ~F.col("whole") & ~F.col("blank")), (docs.select(d_key, F.explode(F.array_distinct(
            F.regexp_extract_all(F.coalesce(F.col(d_text), F.lit("")), F.lit(r"(\s+)"), 1))).alias("token")), F.col("blank"))):
        mine = anchors.filter(which)
        if mine.isEmpty():
            continue
        parts = materialize(mine.select("part").distinct().withColumn("no", F.monotonically_increasing_id()))
        holding = tokens_holding(parts.select("part"), runs.select("token").distinct()).join(F.broadcast(parts), "part")
        # a row a token and document with the numbers of all parts that the token holds: neither parts nor names multiply the texts' tokens
        held = holding.groupBy("token").agg(F.collect_set("no").alias("held"))
        of = runs.join(held, "token").groupBy(d_key).agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
        found = found.unionByName(of.select(d_key, F.explode("held").alias("no")).join(F.broadcast(mine.join(parts, "part").select(p_key, "no")), "no").select(p_key, d_key))
    return found.distinct()


def link_substring(programs: DataFrame, p_key: str, p_name: str, docs: DataFrame, d_key: str, d_text: str) -> DataFrame:
    """(program, document) where the document text contains the program name exactly."""
    pn = programs.select(p_key, p_name).filter(F.col(p_name).isNotNull() & (F.length(p_name) > 0))
    pt = pn.withColumn("_t", _tokens(p_name)).withColumn("_n", F.size("_t"))
    # interior bigrams of each name (positions 2..n-1 are whole tokens in any containing text)
    keyed = pt.filter(F.col("_n") >= 4).select(
        p_key, F.explode(F.zip_with(F.slice("_t", 2, F.col("_n") - 3), F.slice("_t", 3, F.col("_n") - 3),
                                    lambda a, b: F.concat_ws(" ", a, b))).alias("bg"))
    dt = docs.select(d_key, _tokens(d_text).alias("_t"))
    doc_bg = dt.select(d_key, F.explode(F.zip_with(F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0))), F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))),
                                                   lambda a, b: F.concat_ws(" ", a, b))).alias("bg"))
    cand = _rarest_key_links(keyed, p_key, doc_bg, d_key)
    short = pt.filter(F.col("_n") < 4)
    if not short.isEmpty():
        cand = cand.unionByName(_short_candidates(short, p_key, p_name, docs, d_key, d_text))
    cand = materialize(cand)
    few = F.broadcast if cand.count() <= BROADCAST_ROWS else (lambda d: d)  # few candidates travel, not all texts
    links = (docs.select(d_key, d_text).join(few(cand.join(pn, p_key)), d_key)
                 .filter(F.col(d_text).contains(F.col(p_name))).select(p_key, d_key))
    return links.withColumn("match_score", F.lit(100)).withColumn("match_type", F.lit("substring_match"))


def _token_set(col):
    t = F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(t, lambda x: F.length(x) > 0))


def link_fuzzy(left: DataFrame, l_key: str, l_text: str, right: DataFrame, r_key: str, r_text: str,
               threshold: float = 0.85) -> DataFrame:
    """(l_key, r_key, similarity) with token-set Jaccard ≥ threshold (exact prefix-filter join)."""
    up, down = Fraction(str(threshold)).limit_denominator(10**6).as_integer_ratio()
    # one row a key and set: a key that occurs twice with different texts has two sets
    ls = materialize(left.select(F.col(l_key).alias("_lk"), tx.once("_s", _token_set(l_text))).filter(F.size("_s") > 0).distinct())
    lt = materialize(ls.select("_lk", F.size("_s").alias("_n"), F.xxhash64("_s").alias("_h"), F.explode("_s").alias("tok")))
    few = F.broadcast if lt.count() <= BROADCAST_ROWS else (lambda d: d)  # the left side travels if it is small, whatever the right one's size
    words = materialize(lt.select("tok").distinct())
    rs = right.select(F.col(r_key).alias("_rk"), tx.once("_s", _token_set(r_text)))
    rt = rs.select("_rk", F.size("_s").alias("_n"), F.xxhash64("_s").alias("_h"), F.explode("_s").alias("tok")).join(few(words), "tok", "left_semi")
    # a right token that no left set has matches nothing: such tokens come first in the order and are only counted
    dfreq = materialize(lt.select("tok").unionAll(rt.select("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df")))

    def ordered(t: DataFrame, k: str) -> DataFrame:
        """A row a set: its tokens that the left side knows, rarest first, and how many of those its prefix holds."""
        o = t.join(few(dfreq), "tok").groupBy(k, "_n", "_h").agg(F.array_sort(F.collect_set(F.struct("df", "tok"))).alias("_o"))  # one set
        p = F.col("_n") - F.expr(f"(_n * {up}L + {down - 1}L) div {down}L") + 1  # whole numbers: no token short
        return o.withColumn("_p", p - (F.col("_n") - F.size("_o")))

    def prefixes(o: DataFrame, *keys: str) -> DataFrame:
        return o.select(*keys, F.explode(F.slice("_o", 1, F.greatest("_p", F.lit(0)).cast("int"))).alias("x")).select(*keys, F.col("x.tok").alias("tok"))

    of_left = materialize(ordered(lt, "_lk").withColumnRenamed("_h", "_lh"))
    of_right = ordered(rt, "_rk").filter("_p > 0")
    cand = prefixes(of_right, "_rk", "_n", "_h").join(few(prefixes(of_left, "_lk", "_lh")), "tok").select("_rk", "_n", "_h", "_lk", "_lh").distinct()
    sets = of_left.select("_lk", "_lh", F.col("_n").alias("_ln"), F.col("_o.tok").alias("_ls"))
    j = cand.join(of_right.select("_rk", "_n", "_h", F.col("_o.tok").alias("_rs")), ["_rk", "_n", "_h"]).join(few(sets), ["_lk", "_lh"])
    inter = F.size(F.array_intersect("_ls", "_rs")).cast("bigint")  # what the left side doesn't know is in no intersection
    union = F.col("_ln") + F.col("_n") - inter
    return (j.select(F.col("_lk").alias(l_key), F.col("_rk").alias(r_key), (inter / union).alias("similarity"), (inter * down >= union * up).alias("_ok"))
             .filter("_ok").drop("_ok"))


# Preference among link types for the same pair (exact first).
MATCH_PRIORITY = {"substring_match": 0, "token_match": 1, "fuzzy_match": 2}


def best_links(links: DataFrame, programs: DataFrame, p_key: str, d_key: str) -> DataFrame:
    """Best link per (program, document) by score then type; unlinked programs → no_match."""
    prio = F.create_map(*[x for kv in MATCH_PRIORITY.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    best = (links.groupBy(p_key, d_key)
                 .agg(F.max_by(F.struct("match_score", "match_type"),
                               F.struct(F.col("match_score"), -prio[F.col("match_type")])).alias("b"))
                 .select(p_key, d_key, "b.match_score", "b.match_type"))
    unmatched = (programs.select(p_key).join(best.select(p_key), p_key, "left_anti")
                 .select(p_key, F.lit(None).cast(dict(links.dtypes)[d_key]).alias(d_key),
                         F.lit(0).alias("match_score"), F.lit("no_match").alias("match_type")))
    return best.unionByName(unmatched)


def match_type_summary(links: DataFrame) -> DataFrame:
    """Per match type the number of links and their score's mean, deviation, least and highest value."""
    x = F.col("match_score")
    return links.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_score"), F.stddev_samp(x).alias("std_score"),
                                           F.min(x).alias("min_score"), F.max(x).alias("max_score"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement rate, each side's positive rate and the confusion counts on rows with both."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"),
        F.avg(F.col(a).cast("double")).alias(f"{a}_rate"), F.avg(F.col(b).cast("double")).alias(f"{b}_rate"),
        F.count_if((F.col(a) == 0) & (F.col(b) == 0)).alias("tn"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("fp"),
        F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("fn"), F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("tp"))
