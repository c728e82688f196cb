"""Text-cleaning column expressions (T1–T7). Built-in regex/array functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop list (Apache Spark's StopWordsRemover default
# list for "english", 181 words). Tokens reaching the filters are alphabetic,
# so the entries with apostrophes never match but are kept as published.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own same "
    "so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd "
    "you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've "
    "isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't "
    "shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's "
    "when's where's who's why's would"
).split()

# Domain stop words of the procurement corpus (47 words).
DOMAIN_STOP_WORDS = (
    "far dfars iaw sow pws clin ffp cpff mod piid fy tbd niin nsn cage uei duns "
    "contract agreement purchase order procurement government federal agency department "
    "section attachment exhibit appendix shall will must may hereby herein "
    "provide perform deliver supply furnish service services item items product products"
).split()

# U4: the topic-track stop list is the union of both.
TOPIC_STOP_WORDS = tuple(dict.fromkeys(ENGLISH_STOP_WORDS + DOMAIN_STOP_WORDS))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(name: str, c: Column) -> Column:
    """``c`` as a column that is computed once a row: a plain column is computed again in every filter on it and, in
    array functions, at every place that names it. It is a generator of one row, so one of them fits in a select."""
    return F.explode(F.array(c)).alias(name)


def light_tokens(text) -> Column:
    """Lower, [^a-z\\s]→space, collapse, words longer than 2 letters; NULL→[]."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z]{3,}"), 0)  # what is left between the spaces: one pass


def light_clean(text) -> Column:
    """T1 as text (the TF-IDF track input)."""
    return F.array_join(light_tokens(text), " ")


def alpha_tokens(text) -> Column:
    """Lower, whitespace split, keep purely alphabetic (any script) words longer than 2."""
    parts = F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"\s+")
    return F.filter(parts, lambda t: (F.length(t) > 2) & t.rlike(r"^\p{L}+$"))


def topic_tokens(text, stop_words=TOPIC_STOP_WORDS) -> Column:
    """T3+T5: lower, [^a-z0-9\\s]→space, collapse; keep alphabetic tokens longer than 2
    that are not stop words (tokens with digits – number-like – are dropped).

    The reference's "< 3 characters → []" rule needs no branch: a shorter
    string has no token longer than 2. The lemmatiser of the reference is not
    rebuilt (no lexicon): forms stay as they are.
    """
    whole = F.lit("(?<![a-z0-9])[a-z]{3,}+(?![0-9])")  # a run of letters and digits that holds no digit: one pass
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), whole, 0), lambda t: ~t.isin(*stop_words))


def has_light_token(text) -> Column:
    """True when ``light_tokens(text)`` is non-empty: a run of 3+ a–z letters after lower-casing
    (one regex find, no tokenisation)."""
    return F.coalesce(F.lower(_c(text)).rlike("[a-z]{3}"), F.lit(False))


def remove_stops(tokens, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """Stop-word removal keeping order and duplicates."""
    return F.filter(_c(tokens), lambda t: ~t.isin(*stop_words))


def uni_bigrams(tokens) -> Column:
    """Unigrams followed by adjacent bigrams ('a b').

    ``zip_with`` over two shifted slices evaluates the token array a constant
    number of times (an index lambda would re-evaluate it per element).
    """
    t = _c(tokens)
    n = F.size(t)
    bi = F.when(n >= 2, F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1),
                                   lambda a, b: F.concat_ws(" ", a, b))
                ).otherwise(F.array().cast("array<string>"))
    return F.concat(t, bi)


def bigrams_only(tokens) -> Column:
    t = _c(tokens)
    n = F.size(t)
    return F.when(n >= 2, F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1),
                                     lambda a, b: F.concat_ws(" ", a, b))
                  ).otherwise(F.array().cast("array<string>"))


def word_windows(text, size: int = 80, overlap: int = 8) -> Column:
    """Overlapping windows of ``size`` words (step size-overlap) as an array of texts."""
    words = F.filter(F.split(F.trim(F.coalesce(_c(text), F.lit(""))), r"\s+"), lambda w: F.length(w) > 0)
    n = F.size(words)
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " ")))
