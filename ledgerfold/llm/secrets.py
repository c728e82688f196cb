"""Secret scan: three base patterns and a battery of randomness tests, in DataFrame functions only.

Base spans: assignments to password-like names, access key ids, and long
lower-case hex runs. The method adds spans: every maximal run of 20 or more
characters of the base64 alphabets gets an inferred encoding (the narrowest
alphabet that holds it), and three tests of it:

* chi-squared of its symbols against the uniform alphabet,
* runs of its character classes (letters' case and digits; vowels, if all are
  letters of one case),
* serial correlation of neighbouring symbols' ranks in the alphabet.

A structured string is made of words (skewed symbols, few changes of class) or
of a sequence (counters, repeats, alternations: neighbours go together). The
p-values of chi-squared and runs, the chances that words of that length look as
random (the reference figures are in ``ENCODINGS``), are combined by Fisher's
method: neither alone can be small at 20 to 40 characters, and the neighbours'
ranks say nothing about words. The serial test's p-value is the chance that a
sequence (correlation ``SEQUENCE`` or more, either sign) shows so little. A
secret must be neither, so the larger of the two counts (an intersection-union
test); and it must look random in every respect, so a string that one of the
three tests tells from a uniformly random one (``APART``, about one random
string in 200; the serial test also looks at the steps between neighbours, as
counters may start again) gets the p-value 1. Within each band of
lengths, a step-up procedure over all strings of the corpus holds the expected
share of false discoveries at ``FDR``; it needs the counts of p-values on a
fixed grid alone. Runs of digits alone are never called random: they are
numbers of something.

Positions are code points, end exclusive. They come from the lengths of the
matches and of the pieces between them, so they need no user function.

Defined results: a null text is empty and has no spans; texts of any length are
scanned whole; rows repeat with their own results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import docs_view, written

# fixed values: kind, pattern, least length (of group 2 for assign, of the match for the others)
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 12), ("access", r"AKIA[A-Z0-9]{14,}", 18), ("hex", r"[0-9a-f]{16,}", 16)]
RANDOM = r"[A-Za-z0-9+/_-]{20,}={0,2}"
FDR = 0.01
BANDS = [20, 28, 40, 64, 128, 512]  # lower ends of the bands of lengths
SEQUENCE = 0.9
APART = {"chi": 4.0, "runs": 3.5, "serial": 3.3, "steps": 6.9}  # the last: the squared resultant over the number of steps (chance 0.001)
GRID = 20  # steps of -log10(p)
MOST = 400

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: encoding, pattern, alphabet, sum of squared symbol shares of structured strings,
# share of class changes between neighbours in structured strings (0.40 where camel case, paths and snake case
# of short words are possible), and whether random strings change more often
ENCODINGS = [
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.12, 0.15, True),
    ("lower", r"^[a-z]+$", LOWER, 0.07, 0.60, False),
    ("upper", r"^[A-Z]+$", UPPER, 0.07, 0.60, False),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567", 0.07, 0.10, True),
    ("base62", r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER, 0.06, 0.40, True),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", DIGITS + UPPER + LOWER + "+/-_", 0.06, 0.40, True),
]


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,body>> of the leftmost non-overlapping matches; ``body`` is the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    zipped = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,body:string>>)").alias("out"))
    walked = F.aggregate(zipped, start, lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.length(x["body"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["body"])).alias("end"), x["body"].alias("body")))).alias("out")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,body:string>>)")
    return F.when(text.rlike(pattern), walked["out"]).otherwise(none)


def normal_cdf(z: Column) -> Column:
    """Logistic form of the normal distribution function (within 2e-4; falls off too slowly in the tails, never too fast)."""
    z = F.greatest(F.least(z, F.lit(9.0)), F.lit(-9.0))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def symbols(x: Column, alphabet: str) -> Column:
    """Sums over the string x.f that the tests need: struct<n, squares, runs, s, ss, lag, first, last>."""
    f, n = x["f"], F.length(x["f"]).cast("double")
    squares = F.aggregate(F.array_distinct(F.split(f, "")), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(f) - F.length(F.replace(f, c, F.lit(""))), F.lit(2.0)))
    if alphabet in (LOWER, UPPER):
        kinds = F.translate(F.lower(f), LOWER, "".join("v" if c in "aeiou" else "c" for c in LOWER))
        runs = F.length(F.regexp_replace(kinds, "v+|c+", "x"))
    else:
        kinds = F.translate(f, DIGITS + UPPER + LOWER + "+/-_", "d" * 10 + "u" * 26 + "l" * 26 + "ssss")
        runs = F.length(F.regexp_replace(kinds, "d+|u+|l+|s+", "x"))
    ranks = F.transform(F.split(f, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("s", "ss", "lag", "cos", "sin", "before")])
    turn = 2 * math.pi / len(alphabet)
    sums = F.aggregate(ranks, zero, lambda acc, r: F.struct(
        (acc["s"] + r).alias("s"), (acc["ss"] + r * r).alias("ss"), (acc["lag"] + acc["before"] * r).alias("lag"),
        (acc["cos"] + F.cos((r - acc["before"]) * turn)).alias("cos"), (acc["sin"] + F.sin((r - acc["before"]) * turn)).alias("sin"), r.alias("before")))
    rank = lambda c: F.instr(F.lit(alphabet), c).cast("double")
    return F.struct(n.alias("n"), squares.alias("squares"), runs.cast("double").alias("runs"), sums.alias("sums"),
                    rank(F.substring(f, 1, 1)).alias("first"), rank(F.substring(f, -1, 1)).alias("last"))


def change_share(alphabet: str) -> float:
    """Chance that neighbours in a uniformly random string are of different classes (those of ``symbols``)."""
    if alphabet in (LOWER, UPPER):
        kinds = [sum(c in "aeiou" for c in alphabet.lower())]
        kinds.append(len(alphabet) - kinds[0])
    else:
        kinds = [sum(c in kind for c in alphabet) for kind in (DIGITS, UPPER, LOWER, "+/-_")]
    return 1 - sum((x / len(alphabet)) ** 2 for x in kinds)


def battery(x: Column, alphabet: str, share: float, change: float, more: bool) -> Column:
    """The p-value of a string from its sums ``x``."""
    k, n = len(alphabet), x["n"]
    chi = x["squares"] * k / n - n
    delta = k * share - 1
    p_chi = normal_cdf((chi - (k - 1) - n * delta) / F.sqrt(2.0 * (k - 1) + 4 * n * delta))
    changes, most = x["runs"] - 1, n - 1
    z = (changes - most * change) / F.sqrt(most * change * (1 - change))
    p_runs = normal_cdf(-z) if more else normal_cdf(z)
    s, ss, lag = (x["sums"][c] for c in ("s", "ss", "lag"))
    mean = s / n
    var = ss - n * mean * mean
    r = F.when(var > 1e-9, (lag - mean * (2 * s - x["first"] - x["last"]) + most * mean * mean) / var).otherwise(1.0)
    # both signs are held against it: neighbours of a sequence go together or alternate
    p_serial = normal_cdf((F.atanh(F.least(F.abs(r), F.lit(0.9999))) - math.atanh(SEQUENCE)) * F.sqrt(n - 3))
    p_words = p_chi * p_runs * (1 - F.log(p_chi * p_runs))  # Fisher's method for two
    # steps from rank to rank as turns round the alphabet: a counter's agree, also where it starts again
    turn = 2 * math.pi / k
    steps = F.pow(x["sums"]["cos"] - F.cos(x["first"] * turn), F.lit(2.0)) + F.pow(x["sums"]["sin"] - F.sin(x["first"] * turn), F.lit(2.0))
    q = change_share(alphabet)
    uniform = ((chi - (k - 1) <= APART["chi"] * math.sqrt(2 * (k - 1)))
               & (F.abs(changes - most * q) <= APART["runs"] * F.sqrt(most * q * (1 - q)))
               & (F.abs(r + 1 / n) <= APART["serial"] / F.sqrt(n)) & (steps <= APART["steps"] * most))
    return F.when(uniform, F.greatest(p_words, p_serial)).otherwise(1.0)


def tested(runs: Column) -> Column:
    """array<struct<start,end,n,p>> of the strings of an encoding (digits and separators alone are none).

    Each ``transform`` binds what the next one uses, so nothing is worked out again inside a lambda.
    """
    def encoding(body: Column) -> Column:
        out = F.when(body.rlike(r"^[0-9+/_-]+=*$"), F.lit(-1))
        for i, (_, pattern, *_rest) in enumerate(ENCODINGS):
            out = out.when(body.rlike(pattern), F.lit(i))
        return out.otherwise(F.lit(-1))

    with_code = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["body"].alias("body"), encoding(x["body"]).alias("code")))
    known = F.filter(with_code, lambda x: x["code"] >= 0)
    folded = F.transform(known, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["code"].alias("code"), F.when(x["code"] == 0, F.lower(
        F.regexp_replace(x["body"], "=+$", ""))).otherwise(F.regexp_replace(x["body"], "=+$", "")).alias("f")))

    def per_code(x: Column, make) -> Column:
        out = None
        for i, spec in enumerate(ENCODINGS):
            out = F.when(x["code"] == i, make(spec)) if out is None else out.when(x["code"] == i, make(spec))
        return out

    summed = F.transform(folded, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["code"].alias("code"),
                                                    per_code(x, lambda e: symbols(x, e[2])).alias("x")))
    return F.transform(summed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["x"]["n"].cast("int").alias("n"),
                                                  per_code(x, lambda e: battery(x["x"], *e[2:])).alias("p")))


def band(n: Column) -> Column:
    return sum(((n >= b).cast("int") for b in BANDS[1:]), F.lit(0))


def step(p: Column) -> Column:
    """Place on the grid of -log10(p), rounded toward larger p."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * GRID), F.lit(MOST)).cast("int")


def thresholds(found: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each band of lengths, the first step of the grid at which a string is a discovery (none: no entry)."""
    from pyspark.sql import Window
    cand = found.select(F.explode("candidates").alias("c")).select(band(F.col("c.n")).alias("band"), step(F.col("c.p")).alias("step"))
    counts = cand.groupBy("band", "step").agg(F.count(F.lit(1)).alias("n"))  # bands x steps rows at any size
    w = Window.partitionBy("band")
    ranked = counts.withColumn("rank", F.sum("n").over(w.orderBy(F.desc("step")))).withColumn("all", F.sum("n").over(w))
    ok = ranked.filter(F.pow(F.lit(10.0), -F.col("step") / GRID) <= fdr * F.col("rank") / F.col("all"))
    return {r["band"]: r["first"] for r in ok.groupBy("band").agg(F.min("step").alias("first")).collect()}


def _long_enough(pattern: str, least: int):
    return lambda x: F.length(F.regexp_extract(x["body"], pattern, 2)) >= least


def _placed(order: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """doc_id and ``spans``: array<struct<kind, start, end>> by start, then kind (assign, access, hex, random)."""
    d = docs_view(docs, id_col, text_col)
    text = F.col("text")
    cols = []
    for kind, pattern, least in BASE:
        m = matches(text, pattern)
        if kind == "assign":
            m = F.filter(m, _long_enough(pattern, least))
        cols.append(F.transform(m, lambda x: F.struct(x["start"], x["end"])).alias(kind))
    found = written(d.select("doc_id", *cols, matches(text, RANDOM).alias("runs")).select(
        "doc_id", *[k for k, *_ in BASE], tested(F.col("runs")).alias("candidates")), "secrets")
    first = thresholds(found, fdr)
    at = F.create_map(*[F.lit(v) for kv in first.items() for v in kv]) if first else F.expr("cast(map() as map<int,int>)")
    passed = F.filter("candidates", lambda x: F.coalesce(step(x["p"]) >= F.try_element_at(at, band(x["n"])), F.lit(False)))
    parts = []
    for order, (kind, _, _) in enumerate(BASE):
        parts.append(F.transform(kind, _placed(order, kind)))
    parts.append(F.transform(passed, _placed(len(BASE), "random")))
    merged = F.array_sort(F.concat(*parts))
    return found.select("doc_id", F.transform(merged, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest_columns() -> list[Column]:
    """The contract's columns from ``spans``."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return [count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
            F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")]
