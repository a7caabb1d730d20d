"""Multilingual mixture inference for language identification.

Training counts hashed character trigrams of every labelled training text per
language, over all of them. A document is a mixture of languages: with trigram
counts c_b and models p_l(b) its log likelihood is sum_b c_b log sum_l pi_l
p_l(b). Expectation-maximisation estimates the proportions pi. The language
set is chosen by penalised likelihood: from the best single language on, the
language of steepest ascent joins while the likelihood gains more than half a
log(n) for it (BIC), or in place of the weakest if that gains. The likelihood is concave in pi, so at any mixture m the
largest slope, max_k sum_b c_b p_k(b) / m(b) - n, bounds what any other mixture
gains; where that is below the penalty the set is settled without more EM.

The models are dense blocks of ``BLOCK`` languages, and only ``RESIDENT``
blocks are held by a worker at a time, so any number of languages will do.

Defined results: a text that is null or has no letter is ``und`` with score 0
and no proportions; if nothing can be learned every text is ``und``; equal
likelihoods go to the smaller name; labels, source and ids are never inputs of
a prediction; extra columns are ignored; repeated rows are predicted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import cut, pick

#: Hash buckets of trigrams.
BUCKETS = 1 << 16
#: Added to each bucket's count, as a share of a language's mean count.
SMOOTHING = 0.05
EM_ROUNDS = 24
#: Least mean log likelihood a trigram of a text that the pipeline keeps: what a model that knows no language gives.
LEAST_FIT = -float(np.log(BUCKETS))
#: Languages of a block of the model: 16 MB, sent to the executors that work with it.
BLOCK = 64
#: Blocks that a worker holds; further ones are read again for each chunk of documents.
RESIDENT = 4
#: Trigrams times languages of a block, and documents times languages, of a chunk worked on at once.
CHUNK = 500_000

_ALPHA = None


def _alphabet() -> np.ndarray:
    """Whether each code point is a letter; made once a worker."""
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _ALPHA


def trigrams(text: str | None) -> np.ndarray | None:
    """The hashed trigrams of a text's letters in lower case, other runs being one gap; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _alphabet()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.uint32)
    gap = ~letter
    points = points[~(gap & np.concatenate(([True], gap[:-1])))]
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)]) if points[-1] != 32 else ([np.uint32(32)], points)).astype(np.uint32)
    mixed = points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA6B) ^ points[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.uint16)


class Model:
    """Log probabilities of the buckets by language: ``names`` in order, and blocks of up to ``BLOCK`` of them."""

    def __init__(self, names: list[str], blocks: list):
        self.names, self.blocks = names, blocks
        self.held: list[int] = []

    def __len__(self) -> int:
        return len(self.blocks)

    def __getitem__(self, i: int) -> np.ndarray:
        """Block ``i`` (buckets x languages) on a worker."""
        if i >= len(self.blocks):
            raise IndexError(i)
        if i not in self.held:
            self.held.append(i)
        found = self.blocks[i].value
        if len(self.held) > RESIDENT:
            old = self.blocks[self.held.pop(0)]
            if getattr(old, "_path", None) and hasattr(old, "_value"):
                del old._value  # the worker reads it again from the executor's file when it is next asked for
        return found


def learn(docs: DataFrame, training: Column) -> Model:
    """The model of every language, from all rows of ``docs`` (doc_id, text, lang) that are ``training``."""
    d = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def count(batches):
        totals: dict[str, np.ndarray] = {}

        def settle():
            for name, found in totals.items():
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], ["lang", "bucket", "n"])
            totals.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                if (grams := trigrams(text.as_py())) is not None:
                    name = lang.as_py()
                    if name not in totals:
                        if len(totals) >= BLOCK:
                            yield from settle()
                        totals[name] = np.zeros(BUCKETS, np.int64)
                    totals[name] += np.bincount(grams, minlength=BUCKETS)
        yield from settle()

    counts = cut(d.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    names = sorted(r[0] for r in counts.select("lang").distinct().collect())
    blocks = []
    for a in range(0, len(names), BLOCK):
        own = names[a : a + BLOCK]
        table = counts.filter(F.col("lang").isin(own)).toArrow()  # at most BLOCK * BUCKETS rows
        found = np.zeros((BUCKETS, len(own)))
        place = pa.compute.index_in(table.column("lang"), pa.array(own)).to_numpy()
        found[table.column("bucket").to_numpy(), place] = table.column("n").to_numpy()
        found += SMOOTHING * found.sum(0) / BUCKETS
        blocks.append(docs.sparkSession.sparkContext.broadcast(np.log(found / found.sum(0)).astype(np.float32)))
    return Model(names, blocks)


def _at(blocks, buckets: np.ndarray, language: np.ndarray) -> np.ndarray:
    """The log probability of each bucket in its own language."""
    out, before = np.zeros(len(buckets)), 0
    for block in blocks:
        rows = np.flatnonzero((language >= before) & (language < before + block.shape[1]))
        if len(rows):
            out[rows] = block[buckets[rows], language[rows] - before]
        before += block.shape[1]
    return out


def _em(ratio: np.ndarray, share: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) after EM from ``share``, by document, for documents of ``sizes`` different trigrams."""
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    local, n = np.repeat(np.arange(len(sizes)), sizes), np.add.reduceat(counts, at)[:, None]
    for _ in range(EM_ROUNDS):
        mixed = np.einsum("ij,ij->i", ratio, share[local])
        share = share * np.add.reduceat(ratio * (counts / mixed)[:, None], at) / n
    return share, np.add.reduceat(counts * np.log(np.einsum("ij,ij->i", ratio, share[local])), at)


def _infer(documents: list[tuple[np.ndarray, np.ndarray]], blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions, certainty) by document x language and the mixture's mean log likelihood, for (buckets, counts) pairs."""
    sizes = np.array([len(b) for b, _ in documents])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    of = np.repeat(np.arange(len(documents)), sizes)
    buckets = np.concatenate([b for b, _ in documents])
    counts = np.concatenate([c for _, c in documents]).astype(np.float64)
    n = np.add.reduceat(counts, starts)
    single = np.concatenate([np.add.reduceat(counts[:, None] * block[buckets], starts) for block in blocks], axis=1)
    best = single.argmax(1)
    value = single.max(1)
    tempered = np.exp((single - value[:, None]) / 3)
    certainty = tempered / tempered.sum(1, keepdims=True)
    pi = np.zeros_like(single)
    pi[np.arange(len(pi)), best] = 1.0
    if single.shape[1] == 1:
        return pi, certainty, value / n
    penalty = 0.5 * np.log(np.maximum(n, 2))
    gained = np.zeros(len(n))
    # Documents whose set may grow still, their trigrams, and these trigrams' probabilities against the best language's.
    alive, sets, share = np.arange(len(n)), best[:, None], np.ones((len(n), 1))
    own = _at(blocks, buckets, best[of])
    ratio = np.ones((len(of), 1))
    while True:
        at = np.concatenate(([0], np.cumsum(sizes[alive])[:-1]))
        local = np.repeat(np.arange(len(alive)), sizes[alive])
        pull = counts / np.einsum("ij,ij->i", ratio, share[local])
        slope = np.concatenate([np.add.reduceat(pull[:, None] * np.exp(block[buckets] - own[:, None]), at) for block in blocks], axis=1) - n[alive][:, None]
        np.put_along_axis(slope, sets, -np.inf, axis=1)
        next_ = slope.argmax(1)
        grows = slope.max(1) > penalty[alive]
        if not grows.any():
            break
        rows = grows[local]
        buckets, counts, own, ratio = buckets[rows], counts[rows], own[rows], ratio[rows]
        alive, sets, share, next_ = alive[grows], sets[grows], share[grows], next_[grows]
        local = np.repeat(np.arange(len(alive)), sizes[alive])
        ratio = np.concatenate((ratio, np.exp(_at(blocks, buckets, next_[local]) - own)[:, None]), axis=1)
        sets = np.concatenate((sets, next_[:, None]), axis=1)
        k = sets.shape[1]
        share = np.concatenate((share * (1 - 1 / k), np.full((len(alive), 1), 1 / k)), axis=1)
        share, gain = _em(ratio, share, counts, sizes[alive])
        better = gain - gained[alive] > penalty[alive]
        if k > 2 and not better.all():
            # Not worth a language more, but perhaps one instead of the weakest, whose share then stays zero.
            rest = np.flatnonzero(~better)
            other = share[rest]
            weakest = np.where(other[:, :-1] > 0, other[:, :-1], np.inf).argmin(1)
            other[np.arange(len(rest)), weakest] = 0
            rows = ~better[local]
            other, instead = _em(ratio[rows], other / other.sum(1, keepdims=True), counts[rows], sizes[alive[rest]])
            swapped = instead > gained[alive[rest]] + 0.01
            share[rest[swapped]], gain[rest[swapped]], better[rest[swapped]] = other[swapped], instead[swapped], True
        rows = better[local]
        buckets, counts, own, ratio = buckets[rows], counts[rows], own[rows], ratio[rows]
        alive, sets, share = alive[better], sets[better], share[better]
        if not len(alive):
            break
        gained[alive] = gain[better]
        pi[alive] = 0
        pi[alive[:, None], sets] = share
        if k == single.shape[1]:
            break
    return pi, certainty, (value + gained) / n


def infer(documents: list[tuple[np.ndarray, np.ndarray]], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, certainty) by document x language, for (buckets, counts) pairs and log probabilities (buckets x languages).

    certainty is the share of each single language's likelihood, tempered for
    the dependence of overlapping trigrams.
    """
    return _infer(documents, [logs])[:2]


def _inferred(texts, model: Model):
    """Yield (indexes, proportions, certainty, fit) for chunks of the texts that have a letter."""
    chunk, where, size = [], [], 0
    most = CHUNK // max(1, min(BLOCK, len(model.names)))
    for i, text in enumerate(texts):
        if not model.names or (grams := trigrams(text.as_py())) is None:
            continue
        pair = np.unique(grams, return_counts=True)
        if chunk and (size + len(pair[0]) > most or len(chunk) * len(model.names) > CHUNK):
            yield where, *_infer(chunk, model)
            chunk, where, size = [], [], 0
        chunk.append(pair)
        where.append(i)
        size += len(pair[0])
    if chunk:
        yield where, *_infer(chunk, model)


def _score(pi: np.ndarray, certainty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each document: the largest proportion, or for a single language its certainty."""
    top = pi.argmax(1)
    rows = np.arange(len(pi))
    most = pi[rows, top]
    return top, np.clip(np.where(most >= 1, certainty[rows, top], most), 0.0, 1.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, languages (name -> proportion), for every row of ``docs`` (doc_id, text)."""
    names = model.names

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            pred, score, found = ["und"] * m, np.zeros(m), [[] for _ in range(m)]
            for where, pi, certainty, _ in _inferred(batch.column("text"), model):
                top, scores = _score(pi, certainty)
                score[where] = scores
                for j, i in enumerate(where):
                    pred[i] = names[top[j]]
                    found[i] = [(names[k], float(pi[j, k])) for k in np.flatnonzero(pi[j] > 0)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred), pa.array(score), pa.array(found, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "languages"])

    d = pick(docs, "doc_id", "text")
    d = d.select(d["doc_id"].cast("long"), d["text"].cast("string"))
    return d.mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string,double>")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves ``remainder``; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages: learned from the rows that are not held out."""
    d = pick(docs, "doc_id", "text", "lang")
    found = identify(d, learn(d, ~held_out(5, 0)))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame, least_score: float = 0.0, least_fit: float = LEAST_FIT) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is identified: not ``und``, of score over ``least_score``, and
    whose best mixture has a mean log likelihood of ``least_fit`` or more a trigram."""
    d = pick(docs, "doc_id", "text", "lang")
    model = learn(d, ~held_out(5, 0))
    names = docs.columns
    text_at = names.index("text")
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for where, pi, certainty, fit in _inferred(batch.column(text_at), model):
                keep[where] = (_score(pi, certainty)[1] > least_score) & (fit >= least_fit)
            yield batch.filter(pa.array(keep))

    return flat.mapInArrow(run, flat.schema).toDF(*names)
