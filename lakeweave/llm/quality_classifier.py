"""Positive-unlabelled quality classifier.

A linear model on text features is fitted by minimising the non-negative
unbiased risk of positive-unlabelled learning with logistic loss: with class
prior pi, trusted positives P and unlabelled documents U,

    pi E_P[loss(g)] + max(0, E_U[loss(-g)] - pi E_P[loss(-g)]).

For logistic loss the unbiased risk is convex, so Newton steps are used; each
step's gradient and Hessian are sums over all documents, computed where the
documents are and of a size fixed by the number of features. A step that would
make the negative-class part of the risk negative is halved, and fitting stops
at that boundary. The prior is the share of label 1 among the training labels,
or, where there are positives only, the least ratio of unlabelled to positive
mass above a score of a positives-against-unlabelled model.

Features are shares, so that length cancels: hashed shapes of three characters
(letters and digits by class, other characters as they are), shares of
character kinds, and repetition of words and lines.

Defined results: null and empty texts have features of zero but for a flag and
are scored like any; without any positive every score is 0.5; labels, lang,
source and doc_id are never inputs of a score; a doc_id labelled twice counts
as positive if any label is 1; repeated rows are scored each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import cut, pick
from lakeweave.llm.language_id import held_out

SHAPES = 96
STEPS = 12
#: Weight of the squared weights against the mean risk, for standardised features.
RIDGE = 0.05
#: Most standard deviations that a feature counts for.
CLIP = 3.0
#: Tasks that add up partial sums before the driver does.
GATHER = 8
#: Bins of the score histogram from which a prior is estimated without negative labels.
BINS = 200

_KIND = None
_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP = range(6)


def _kinds() -> np.ndarray:
    """A small code for each code point: 0 to 5 by class, else 6 to 63 by value."""
    global _KIND
    if _KIND is None:
        kind = np.empty(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c == "\n":
                kind[i] = _LINE
            elif c.isspace():
                kind[i] = _SPACE
            elif c.isdigit():
                kind[i] = _DIGIT
            elif c.isupper():
                kind[i] = _UPPER
            elif c.isalpha():
                kind[i] = _LOWER
            elif c in ".,;:'-?":
                kind[i] = _STOP
            else:
                kind[i] = 6 + i % 58
        _KIND = kind
    return _KIND


def features(text: str | None) -> np.ndarray:
    """Shares and their square roots; the first feature is 1."""
    out = np.zeros(SHAPES + 12)
    out[0] = 1.0
    if not text:
        out[1] = 1.0
        return out
    kind = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.uint32)
    n = len(kind)
    by = np.bincount(kind, minlength=64) / n
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(words))
    pairs = set(zip(words, words[1:], strict=False))
    out[2:8] = by[:6]
    out[8] = by[6:].sum()
    out[9] = 1 - len(set(words)) / m
    out[10] = 1 - len(pairs) / max(1, m - 1) if m > 1 else 0.0
    out[11] = 1 - len(set(lines)) / max(1, len(lines))
    if n >= 3:
        mixed = (kind[:-2] * np.uint32(4096) + kind[1:-1] * np.uint32(64) + kind[2:]) * np.uint32(0x9E3779B1)
        out[12:] = np.sqrt(np.bincount((mixed >> np.uint32(8)) % SHAPES, minlength=SHAPES) / (n - 2))
    return out


def _featured(docs: DataFrame) -> DataFrame:
    """doc_id, x (features packed as float32 bytes)."""
    d = pick(docs, "doc_id", "text")
    d = d.select(d["doc_id"].cast("long"), d["text"].cast("string"))

    def run(batches):
        for batch in batches:
            packed = [features(t.as_py()).astype("<f4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "x"])

    return d.mapInArrow(run, "doc_id long, x binary")


def _rows(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = SHAPES + 12
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, width).astype(np.float64)


def _total(rows: DataFrame, columns: list[str], partial, kind: str = "<f8") -> np.ndarray | None:
    """The sum of one array a partition, made by ``partial`` from its batches; None without partitions.

    Partial sums are added up in ``GATHER`` tasks first, so that what the
    driver gets does not grow with the number of partitions.
    """

    def each(batches):
        yield pa.RecordBatch.from_arrays([pa.array([partial(batches).astype(kind).tobytes()], pa.binary())], ["s"])

    def add(batches):
        total = None
        for batch in batches:
            for packed in batch.column("s").to_pylist():
                found = np.frombuffer(packed, kind)
                total = found.copy() if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], ["s"])

    parts = rows.select(*columns).mapInArrow(each, "s binary").repartition(GATHER).mapInArrow(add, "s binary")
    found = [np.frombuffer(b, kind) for b in parts.toArrow().column("s").to_pylist()]
    return np.sum(found, axis=0) if found else None


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, clipped so that one odd share cannot decide alone."""
    x = np.clip((x - mean) / scale, -CLIP, CLIP)
    x[:, 0] = 1.0
    return x


def _sums(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> dict[str, np.ndarray]:
    """Counts, losses, gradients and the unlabelled Hessian at ``weights``, summed over all rows (x, positive)."""
    width = len(weights)
    sent = rows.sparkSession.sparkContext.broadcast((weights, mean, scale))

    def partial(batches):
        w, mu, sd = sent.value
        total = np.zeros(5 + 2 * width + width * width)
        for batch in batches:
            x = _standard(_rows(batch.column("x")), mu, sd)
            p = np.asarray(batch.column("positive").to_pylist(), bool)
            g = x @ w
            sigma = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
            as_negative = np.logaddexp(0, g)
            total[:5] += len(g), p.sum(), as_negative.sum(), as_negative[p].sum(), np.logaddexp(0, -g[p]).sum()
            total[5 : 5 + width] += x.T @ sigma
            total[5 + width : 5 + 2 * width] += x[p].sum(0)
            total[5 + 2 * width :] += (x.T @ (x * (sigma * (1 - sigma))[:, None])).ravel()
        return total

    t = _total(rows, ["x", "positive"], partial)
    return {"n": t[0], "p": t[1], "u_neg": t[2], "p_neg": t[3], "p_pos": t[4], "u_grad": t[5 : 5 + width], "p_sum": t[5 + width : 5 + 2 * width], "hess": t[5 + 2 * width :].reshape(width, width)}


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    width = SHAPES + 12

    def partial(batches):
        total = np.zeros(1 + 2 * width)
        for batch in batches:
            x = _rows(batch.column("x"))
            total += np.concatenate(([len(x)], x.sum(0), (x**2).sum(0)))
        return total

    t = _total(rows, ["x"], partial)
    n = max(1.0, t[0])
    mean = t[1 : 1 + width] / n
    scale = np.sqrt(np.maximum(t[1 + width :] / n - mean**2, 0))
    return mean, np.where(scale > 1e-6, scale, 1.0)


def fit(rows: DataFrame, prior: float, mean: np.ndarray, scale: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk over ``rows`` (x, positive)."""
    width = SHAPES + 12
    ridge = np.full(width, RIDGE)
    ridge[0] = 0.0

    def risk(s, w):
        positive = prior * s["p_pos"] / s["p"]
        negative = s["u_neg"] / s["n"] - prior * s["p_neg"] / s["p"]
        return positive + max(0.0, negative) + 0.5 * (ridge * w * w).sum(), negative >= 0

    w = np.zeros(width)
    w[0] = np.log(prior / (1 - prior))
    s = _sums(rows, w, mean, scale)
    value, _ = risk(s, w)
    for _ in range(steps):
        # logistic loss: loss(g) - loss(-g) = -g, so the positives enter by their mean only
        grad = s["u_grad"] / s["n"] - prior * s["p_sum"] / s["p"] + ridge * w
        step = np.linalg.solve(s["hess"] / s["n"] + np.diag(ridge + 1e-6), grad)
        size, moved = 1.0, False
        while size > 1 / 32:
            tried = w - size * step
            found = _sums(rows, tried, mean, scale)
            new, allowed = risk(found, tried)
            if allowed and new < value:
                moved = True
                break
            size /= 2
        if not moved:
            break
        gained, w, s, value = value - new, tried, found, new
        if gained < 1e-6:
            break
    return w


def _mixture_prior(rows: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> float:
    """The least ratio of unlabelled to positive mass above a score."""
    sent = rows.sparkSession.sparkContext.broadcast((w, mean, scale))

    def partial(batches):
        w, mu, sd = sent.value
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            x = _standard(_rows(batch.column("x")), mu, sd)
            at = np.minimum((BINS / (1 + np.exp(-np.clip(x @ w, -500, 500)))).astype(int), BINS - 1)
            p = np.asarray(batch.column("positive").to_pylist(), bool)
            total[0] += np.bincount(at, minlength=BINS)
            total[1] += np.bincount(at[p], minlength=BINS)
        return total.ravel()

    t = _total(rows, ["x", "positive"], partial, "<i8").reshape(2, BINS)
    above = np.cumsum(t[:, ::-1], axis=1) / np.maximum(1, t.sum(1, keepdims=True))
    enough = above[1] >= 0.3
    return float(np.clip((above[0][enough] / above[1][enough]).min(), 0.05, 0.95))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels of held-out rows are never read."""
    marks = pick(labels, "doc_id", "quality")
    marks = marks.select(marks["doc_id"].cast("long").alias("doc_id"), "quality").filter(~held_out(3, 1)).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    marks = marks.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.col("quality") == 1).alias("good"))
    x = cut(_featured(docs))
    rows = cut(x.join(marks, x["doc_id"] == marks["l_id"], "left").select("x", F.coalesce("good", F.lit(False)).alias("positive"), F.col("good").isNotNull().alias("known")))
    n, positives, known = rows.agg(F.count(F.lit(1)), F.coalesce(F.count_if("positive"), F.lit(0)), F.coalesce(F.count_if("known"), F.lit(0))).first()
    sent = None
    if positives:
        mean, scale = _moments(rows)
        if known > positives:
            prior = positives / known
        else:
            prior = _mixture_prior(rows, fit(rows, 0.5, mean, scale, 4), mean, scale)
        sent = docs.sparkSession.sparkContext.broadcast((fit(rows, prior, mean, scale), mean, scale))

    def run(batches):
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if sent is not None and batch.num_rows:
                w, mu, sd = sent.value
                g = _standard(_rows(batch.column("x")), mu, sd) @ w
                score = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
