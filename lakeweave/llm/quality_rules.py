"""Quality rules: hashed n-gram log-likelihood ratio with a fixed threshold.

Two multinomials over hashed 4-grams of a text's UTF-8 bytes are counted over
all documents: the trusted target's (labels of quality 1) and the raw
corpus's. A document's ratio is the mean over its n-grams of log target minus
log raw, so that length cancels; every document is kept or dropped by the same
threshold, after two base rules on word count and repetition.

Defined results: a null text counts as empty; texts under four bytes have
ratio 0; without trusted documents the ratio is 0 for all; a label that is
null is not trusted; repeated rows are judged each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import pick

BUCKETS = 1 << 16
#: Weight of the raw corpus in the target's multinomial, against 1 for the trusted documents.
SMOOTHING = 0.5
#: Least mean log ratio that is kept.
THRESHOLD = -0.15
LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Most trusted ids that are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


def ngrams(raw: bytes) -> np.ndarray:
    """Hashed 4-grams of bytes."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(a) < 4:
        return np.empty(0, np.uint16)
    packed = a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16) | a[3:] << np.uint32(24)
    packed = packed * np.uint32(0x9E3779B1)
    packed ^= packed >> np.uint32(15)
    return ((packed * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    m = n - window + 1
    rng = np.random.default_rng(5)
    keys = np.zeros(m, np.uint64)
    code = rng.integers(0, 1 << 63, len(ids), np.uint64)[a]
    for k in range(window):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + code[k : k + m]
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    if not len(same):
        return 0
    x, y = order[same], order[same + 1]
    exact = np.ones(len(x), bool)
    for k in range(window):
        exact &= a[x + k] == a[y + k]
    hit = np.zeros(n + 1, np.int64)
    begins = np.unique(np.concatenate((x[exact], y[exact])))
    np.add.at(hit, begins, 1)
    np.add.at(hit, begins + window, -1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


def base_figures(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = raw.split()
    chars = np.frombuffer(b"".join(words), np.uint8)
    lines, seen = 0, set()
    for line in raw.split(b"\n"):
        if line.strip():
            if line in seen:
                lines += 1
            seen.add(line)
    return len(words), int(((chars & 0xC0) != 0x80).sum()), sum(raw.count(s) for s in (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))), lines, repeated_words(words)


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of each bucket, counted over all of ``docs`` (doc_id, text)."""
    marks = pick(labels, "doc_id", "quality")
    trusted = marks.filter(marks["quality"] == 1).select(marks["doc_id"].cast("long").alias("t_id")).distinct()
    few = trusted.count() <= BROADCAST_IDS
    d = pick(docs, "doc_id", "text")
    d = d.select(d["doc_id"].cast("long"), d["text"].cast("string")).filter("text IS NOT NULL")
    d = d.join(F.broadcast(trusted) if few else trusted.hint("shuffle_hash"), d["doc_id"] == trusted["t_id"], "left")
    d = d.select("text", F.col("t_id").isNotNull().alias("trusted"))

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, t in zip(batch.column("text"), batch.column("trusted").to_pylist(), strict=True):
                found = np.bincount(ngrams(text.as_py().encode("utf-8", "surrogatepass")), minlength=BUCKETS)
                raw += found
                if t:
                    target += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counts = d.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table = counts.toArrow()  # at most BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[table.column("bucket").to_numpy()] = table.column("raw").to_numpy()
    target[table.column("bucket").to_numpy()] = table.column("target").to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS, np.float32)
    # The target is a mixture with the raw corpus: n-grams that a small target lacks are weak evidence.
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(raw > 0, np.log((target / target.sum() / (raw / raw.sum()) + SMOOTHING) / (1 + SMOOTHING)), 0.0)
    return ratio.astype(np.float32)


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base figures, llr, base_failed and kept of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    d = pick(docs, "doc_id", "text")
    d = d.select(d["doc_id"].cast("long"), d["text"].cast("string"))

    def run(batches):
        table = shared.value
        for batch in batches:
            figures, llr = [], []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                grams = ngrams(raw)
                figures.append(base_figures(raw))
                llr.append(float(table[grams].mean(dtype=np.float64)) if len(grams) else 0.0)
            f = np.array(figures, np.int64).reshape(-1, 5)
            llr = np.array(llr)
            failed = (f[:, 0] < LEAST_WORDS) | (100 * f[:, 4] > MOST_REPEATED * f[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(f[:, k]) for k in range(5)], pa.array(llr), pa.array(failed), pa.array(~failed & (llr >= threshold))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"],
            )

    return d.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean")


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learn the ratio from all documents and judge every one."""
    return judge(docs, learn(docs, labels), threshold)
