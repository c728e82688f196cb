"""Document fingerprints: mergeable bottom-k sketches, DataFrame functions only.

A text's sketch is the K smallest distinct hashes (the first 16 hex digits of
md5) of its runs of WIDTH words, in ascending order. A sketch of fewer than K
hashes is the whole set. From sketches alone follow

* the sketch of the texts' union (:func:`merged`, or :func:`merge` over rows),
* resemblance: of the union's K smallest hashes, the share that both sets have,
* the number of distinct shingles: exact under K, else (K - 1) over the K-th
  smallest hash as a share of the hash range,
* the share of one set that the other contains, from these.

``merge`` takes the distinct (group, hash) rows and keeps each group's K smallest
through a rank limit, which Spark applies in every task before the shuffle: a
group with a third of all rows sends K rows a task.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; fewer words
than WIDTH are one shingle; a text without words (a null one too) has the empty
sketch, which resembles and is contained in the empty sketch only. Equal texts
have equal sketches. Columns with clashing names are no matter: expressions
name only the columns that they are given.

:func:`with_next` finds each document's successor in ascending id (null ids
first; rows that repeat an id go by their texts' hashes; rows with equal id and text are one
document). Ids, hashes and lengths alone are sorted, by range, and numbered;
texts are shuffled by id once, and of the successor only the characters asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.llm.common import docs_view, written

K, WIDTH, DIGITS = 96, 5, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, lower case, in order."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """Hashes of the runs of ``width`` words (all of them as one if there are fewer), repeats and all."""
    def hashed(run: Column) -> Column:
        return F.substring(F.md5(F.array_join(run, " ").cast("binary")), 1, DIGITS)

    def runs(w: Column) -> Column:
        n = F.size(w)
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= width, F.array(hashed(w))).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: hashed(F.slice(w, i, width))))

    return once(w, runs)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bottom(hashes: Column, k: int = K) -> Column:
    """The sketch of a set of hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return bottom(shingle_hashes(words(text), width), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets, from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge(parts: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """(by, sketch_col): the sketch of the union of each group's sketches; a group of empty sketches has the empty one."""
    rows = parts.select(*[F.col(f"`{c}`").alias(f"g{n}") for n, c in enumerate(by)], F.explode_outer(F.col(f"`{sketch_col}`")).alias("h")).distinct()
    groups = [f"g{n}" for n in range(len(by))]
    low = rows.withColumn("r", F.row_number().over(Window.partitionBy(*groups).orderBy(F.asc_nulls_last("h")))).filter(F.col("r") <= k)
    out = low.groupBy(*groups).agg(F.sort_array(F.collect_list("h")).alias("h"))  # k a group at most
    return out.select(*[F.col(g).alias(c) for g, c in zip(groups, by, strict=True)], F.col("h").alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sets (0 to 1), exact while their union has at most ``k`` shingles."""
    return once(merged(a, b, k), lambda union: F.when(F.size(union) == 0, 1.0).otherwise(
        F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)))


def n_distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, exact under ``k``."""
    share = F.conv(F.substring(F.element_at(a, -1), 1, 13), 16, 10).cast("double") / float(16 ** 13)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of set ``a`` that set ``b`` has (0 to 1)."""
    shared = resemblance(a, b, k) * n_distinct(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), shared / n_distinct(a, k)))


def text_form(a: Column) -> Column:
    """A sketch as one string."""
    return F.array_join(a, ",")


def from_text(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ","))


def packed(a: Column) -> Column:
    """A sketch as 8 bytes a hash, for a shuffle."""
    return F.unhex(F.array_join(a, ""))


def unpacked(b: Column) -> Column:
    def parts(digits: Column) -> Column:
        n = F.length(digits) / DIGITS
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), lambda i: F.substring(digits, i * DIGITS + 1, F.lit(DIGITS))))

    return once(F.lower(F.hex(b)), parts)


def key(doc_id: str, tie: str) -> Column:
    """A document's identity as one value that is never null."""
    return F.struct(F.coalesce(F.col(doc_id), F.lit(0)).alias("i"), F.col(doc_id).isNull().alias("no"), F.col(tie).alias("t"))


def with_next(docs: DataFrame, need: Column, of: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text) of every row, and for each expression over the text in ``of`` its value (name) and that of
    the next document's text (next_name). next_text holds the first characters of the next document, as many as ``need``
    (an expression over this document's n_chars) says; the first document follows the last."""
    d = docs_view(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ids = d.select("doc_id", "tie", F.length("text").cast("long").alias("n_chars")).distinct()
    dealt = ids.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), "ids")  # range number << 33 | position
    sizes = dealt.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # a row per range
    starts, total = [], 0
    for r in sizes:
        starts.append((r["range"], total))
        total += r["n"]
    start = docs.sparkSession.createDataFrame(starts, "range long, before long")
    numbered = dealt.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(start), "range").select(
        key("doc_id", "tie").alias("k"), "n_chars", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"))
    # for each document: its predecessor and how many characters that one asks for
    asks = numbered.select(((F.col("number") + 1) % F.lit(max(total, 1))).alias("number"), F.col("k").alias("to"), need.cast("int").alias("need"))
    asks = written(numbered.select("number", "k").join(asks, "number").select("k", "to", "need"), "asks")
    names = list(of or {})
    own = d.select(key("doc_id", "tie").alias("k"), "text", *[c.alias(n) for n, c in (of or {}).items()])  # one shuffle serves both sides
    sent = own.join(asks, "k").select(F.col("to").alias("k"), F.expr("left(text, need)").alias("next_text"), *[F.col(n).alias(f"next_{n}") for n in names])
    out = own.join(sent.dropDuplicates(["k"]), "k")
    return out.select(F.when(~F.col("k.no"), F.col("k.i")).alias("doc_id"), "text", "next_text", *names, *[f"next_{n}" for n in names])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, sketch, shingles): every row's sketch and estimated number of distinct shingles."""
    d = docs_view(docs, id_col, text_col).withColumn("sketch", sketch(F.col("text"), k, width))
    return d.withColumn("shingles", n_distinct(F.col("sketch"), k))


def edited_halves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_chars, edited, sketch, edited_sketch, next_sketch) of every row: ``edited`` is the text whose last
    floor(n_chars / 2) characters are replaced by the first as many (or all) of the next document."""
    d = with_next(docs, F.floor(F.col("n_chars") / 2), {"packed": packed(sketch(F.col("text"), k, width))}, id_col, text_col)
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.col("next_text")))
    return d.select("doc_id", "n_chars", "edited", unpacked(F.col("packed")).alias("sketch"), sketch(F.col("edited"), k, width).alias("edited_sketch"),
                    unpacked(F.col("next_packed")).alias("next_sketch"))
