"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is good or bad. The emission scores come from the
line's own features and those of its two neighbours, the chain's transitions
couple neighbouring labels; forward-backward gives each line's marginal. The
marginals, weighted by the lines' lengths, make a document's share of good
text, and a logistic link fitted on the training documents turns it into a
score from 0 to 1.

Labels belong to documents, not lines: lines of good documents are good; lines
of bad documents start as bad and are labelled again by the model between
rounds, the worst line staying bad.

``fit`` learns from a bounded sample: at most FIT_DOCS labelled documents (those
with the smallest hash of their doc_id) of at most FIT_LINES lines each. Only
line features of that sample come to the driver. Scoring covers whole texts of
any length, document by document.

Defined results: a null or blank text has no lines and gets the share 0.5 of
good text through the same link, as does any text when no labelled rows of both
kinds are there to learn from (score: the share itself); lines without
characters other than blanks are skipped; null labels are left out; of
contradicting labels of one doc_id the smaller holds; other columns pass
through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.llm.common import docs_view, lean, map_rows, slices

FIT_DOCS, FIT_LINES = 4000, 400
SYMBOLS = b"%$#&*|<>{}[]~^_=+@\\/"
FEATURES = 18

_KIND = np.zeros(256, dtype=np.int64)
for _c in range(256):
    _b = bytes([_c])
    _KIND[_c] = 1 if _b.isupper() else 2 if _b.islower() or _c >= 0x80 else 3 if _b.isdigit() else 4 if _b in SYMBOLS else 5 if _b in b"!?" else 6 if _b in b".,;:'\"-()" else 0 if _b.isspace() else 7


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES) and the lengths of the lines that aren't blank."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    n = len(lines)
    out = np.zeros((n, FEATURES), dtype=np.float32)
    if not n:
        return out, np.zeros(0)
    raw = [x.encode("utf-8") for x in lines]
    size = np.array([len(x) for x in raw])
    kinds = _KIND[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    counts = np.bincount(np.repeat(np.arange(n), size) * 8 + kinds, minlength=n * 8).reshape(n, 8).astype(np.float64)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    before: dict[bytes, int] = {}
    for i, line in enumerate(raw):
        words = line.split()
        m = max(len(words), 1)
        out[i, 0] = math.log1p(len(words))
        out[i, 1] = len(line) / m / 10
        out[i, 2] = len(set(words)) / m
        out[i, 3] = sum(map(bytes.__eq__, words, words[1:])) / m
        out[i, 4] = sum(len(w) == 1 for w in words) / m
        out[i, 5] = max(map(len, words), default=0) > 40
        out[i, 6] = words[-1][-1:] in b".!?:;\"" if words else 0
        out[i, 7] = before.get(line, 0) > 0
        before[line] = 1
    total = np.maximum(counts[:, 1:].sum(axis=1), 1)
    out[:, 8] = np.log1p(size) / 2
    out[:, 9] = counts[:, 1] / letters
    out[:, 10] = counts[:, 3] / total
    out[:, 11] = counts[:, 4] / total
    out[:, 12] = counts[:, 5] / total
    out[:, 13] = counts[:, 6] / total
    out[:, 14] = counts[:, 7] / total
    out[:, 15] = counts[:, 4] > 0
    out[:, 16] = counts[:, 1] > 0.6 * letters
    out[:, 17] = 1
    return out, size.astype(np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after (zeros at the ends)."""
    z = np.zeros((1, x.shape[1]), dtype=x.dtype)
    return np.concatenate([x, np.concatenate([z, x[:-1]]), np.concatenate([x[1:], z])], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # score of label good against bad
    trans: np.ndarray  # 2 x 2
    start: np.ndarray  # 2
    link: tuple[float, float]  # intercept and slope on the logit of the share of good text

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((with_neighbours(x) - self.mean) / self.scale) @ self.weights

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """P(good) of every line."""
        if not len(x):
            return np.zeros(0)
        e = np.clip(self.emissions(x), -30, 30)
        good = np.exp(np.minimum(e, 0)).tolist()
        bad = np.exp(-np.maximum(e, 0)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.trans).tolist()
        sb, sg = np.exp(self.start).tolist()
        n = len(good)
        fb, fg = [0.0] * n, [0.0] * n
        b, g = sb * bad[0], sg * good[0]
        for i in range(n):
            if i:
                b, g = (b * bb + g * gb) * bad[i], (b * bg + g * gg) * good[i]
            t = b + g
            b, g = b / t, g / t
            fb[i], fg[i] = b, g
        out = np.empty(n)
        b = g = 1.0
        for i in range(n - 1, -1, -1):
            p, q = fb[i] * b, fg[i] * g
            out[i] = q / (p + q)
            b, g = b * bad[i], g * good[i]
            b, g = bb * b + bg * g, gb * b + gg * g
            t = b + g
            b, g = b / t, g / t
        return out

    def share(self, text: str | None) -> float:
        x, size = line_features(text)
        return float((self.marginals(x) * size).sum() / size.sum()) if len(x) else 0.5

    def score(self, text: str | None) -> float:
        a, b = self.link
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * logit(self.share(text))))))


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def _gradient(e: np.ndarray, mask: np.ndarray, y: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Of a padded batch (documents, lines): observed less expected, for emissions, transitions and the start."""
    n, length = e.shape
    emit = np.stack([np.zeros_like(e), e], axis=2)
    alpha = np.empty((n, length, 2))
    alpha[:, 0] = start + emit[:, 0]
    for t in range(1, length):
        a = alpha[:, t - 1, :, None] + trans
        now = np.logaddexp(a[:, 0], a[:, 1]) + emit[:, t]
        alpha[:, t] = np.where(mask[:, t, None], now, alpha[:, t - 1])
    beta = np.zeros((n, length, 2))
    for t in range(length - 2, -1, -1):
        a = trans + (emit[:, t + 1] + beta[:, t + 1])[:, None, :]
        beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(a[:, :, 0], a[:, :, 1]), 0.0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha + beta - z[:, None, None])
    g_e = np.where(mask, y - p[:, :, 1], 0.0)
    pair = np.exp(alpha[:, :-1, :, None] + trans + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
    seen = np.zeros((2, 2))
    both = mask[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum()
    g_s = np.array([(y[:, 0] == 0).sum(), (y[:, 0] == 1).sum()]) - p[:, 0].sum(axis=0)
    return g_e, seen - pair.sum(axis=(0, 1)), g_s


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 3, epochs: int = 8, rate: float = 0.05, decay: float = 1e-3) -> Model | None:
    """Fit on (line features, line lengths, label) of documents; None unless both labels occur."""
    docs = [d for d in docs if len(d[0])]
    labels = np.array([y for *_, y in docs], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return None
    docs = sorted(docs, key=lambda d: len(d[0]))
    labels = np.array([y for *_, y in docs])
    wide = [with_neighbours(x) for x, *_ in docs]
    every = np.concatenate(wide)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    mean[FEATURES - 1], scale[FEATURES - 1] = 0, 1  # the constant
    wide = [(x - mean) / scale for x in wide]
    line_y = [np.full(len(x), y, dtype=np.int64) for x, y in zip(wide, labels, strict=True)]
    dims = every.shape[1]
    model = Model(mean, scale, np.zeros(dims), np.zeros((2, 2)), np.zeros(2), (0.0, 1.0))
    rng = np.random.default_rng(7)
    batches = [list(range(a, min(a + 128, len(docs)))) for a in range(0, len(docs), 128)]
    parts = ("weights", "trans", "start")
    m1, m2, t = {k: 0.0 for k in parts}, {k: 0.0 for k in parts}, 0
    for round_ in range(rounds):
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                own = batches[k]
                length = max(len(wide[i]) for i in own)
                x, y, mask = np.zeros((len(own), length, dims)), np.zeros((len(own), length), np.int64), np.zeros((len(own), length), bool)
                for r, i in enumerate(own):
                    x[r, :len(wide[i])], y[r, :len(wide[i])], mask[r, :len(wide[i])] = wide[i], line_y[i], True
                g_e, g_t, g_s = _gradient(x @ model.weights, mask, y, model.trans, model.start)
                lines = mask.sum()
                grads = {"weights": np.tensordot(g_e, x, axes=2) / lines, "trans": g_t / lines, "start": g_s / len(own)}
                t += 1
                for name in parts:
                    g = grads[name] - decay * getattr(model, name)
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.999 * m2[name] + 0.001 * g * g
                    setattr(model, name, getattr(model, name) + rate * (m1[name] / (1 - 0.9 ** t)) / (np.sqrt(m2[name] / (1 - 0.999 ** t)) + 1e-8))
        if round_ < rounds - 1:
            for i, (x, _, y) in enumerate(docs):
                if y == 0:
                    p = model.marginals(x)
                    new = (p > 0.5).astype(np.int64)
                    new[int(p.argmin())] = 0
                    line_y[i] = new
    shares = np.array([logit(float((model.marginals(x) * size).sum() / size.sum())) for x, size, _ in docs])
    model.link = fit_link(shares, labels)
    return model


def fit_link(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Intercept and slope of a logistic regression on one variable, by Newton steps with a weak prior."""
    a = b = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum() - 0.01 * a, ((y - p) * x).sum() - 0.01 * b])
        h = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -2, 2)), b + float(np.clip(d[1], -2, 2))
        if abs(d).max() < 1e-9:
            break
    return a, max(b, 0.0)


def held_out(doc_id: F.Column) -> F.Column:
    """Documents whose labels are never learned from; those without an id too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES) -> Model | None:
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y is not null")
    one = one.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)  # at most fit_docs rows
    d = docs_view(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    d = d.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one text an id, so fit_docs bounds what the driver gets

    def make():
        def step(cols: dict) -> dict:
            out = {"doc_id": [], "x": [], "size": [], "y": []}
            for i, text, y in zip(cols["doc_id"], cols["text"], cols["y"], strict=True):
                x, size = line_features(text)
                if 0 < len(x) <= fit_lines:
                    for k, v in (("doc_id", i), ("x", x.tobytes()), ("size", size.astype(np.float32).tobytes()), ("y", y)):
                        out[k].append(v)
            return out
        return step

    rows = map_rows(d, make, "doc_id long, x binary, size binary, y int").orderBy("doc_id", "x").collect()
    return train([(np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES).astype(np.float64), np.frombuffer(r["size"], np.float32).astype(np.float64), r["y"]) for r in rows])


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, from the text alone."""
    model = model or untrained()
    schema = T.StructType([f for f in docs.schema.fields if f.name != out_col] + [T.StructField(out_col, T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = [model.score(x) for x in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names[:-1]), pa.array(made, pa.float64())], names=names)

    return docs.mapInArrow(lean(run), schema)


def untrained() -> Model:
    d = 3 * FEATURES
    return Model(np.zeros(d), np.ones(d), np.zeros(d), np.zeros((2, 2)), np.zeros(2), (0.0, 1.0))
