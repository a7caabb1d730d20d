"""Exact links between texts by the Jaccard similarity of their word shingle sets.

Words are runs between white space, with A-Z in lower case; a text's set holds
the 64-bit hashes of its shingles, or of its whole sequence if it has fewer
words. In one order of all shingles, two sets of similarity tenths / 10 or more
share one of the first 1 - tenths / 10 of theirs, which loses no pair.
Shingles frequent in a sample come late in the order, which steers cost only.

The first shingles travel as packed arrays, dealt out by their lower bits;
those met in one set only end there. In each, every set meets the least set of
each shingle; what those pairs share bounds their similarity, and whole texts
decide. Then all pairs that share a first shingle and are not linked yet are
decided likewise, so that a large group of near copies costs no pair
enumeration. For these pairs a set's first shingles are put in order once more,
by the exact number of sets that each is met in: two sets share no more of them
than the lesser has from the first common one on, and meet in that one only
(``BEFORE``), so that a pair makes few rows however much it shares. Each set has a parity sketch, in which a bit tells whether an odd
number of its shingles fall there: the bits in which two sketches differ are
no more than the shingles in which the sets differ, so that most pairs that
are not similar enough make no row. Before that, the sets of a shingle that many
share meet a few of them, drawn by hash, which links most that can be linked at
a cost in proportion to the sets; and shingles met in the same sets are taken
as one with a weight. A shingle frequent in the sample is dealt out by set as well
(``HOT_ROWS``), and its parts' least sets meet again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm import common
from lakeweave.llm.common import cut, in_one_task, join_small, pick, release

SHINGLE = 5
TENTHS = 8
#: Documents sampled for frequent shingles, and most of these that are told apart.
SAMPLED_DOCS = 8_192
FREQUENT = 65_536
#: First shingles that one task should meet at once, and those of one shingle beyond which it is dealt out by set.
TASK_TOKENS = 2_000_000
HOT_ROWS = 1_000_000
#: Texts of so many bytes, or 256 texts, are worked on at once; first shingles packed at once; longer words are hashed one by one.
CHUNK_BYTES = 1 << 19
FLUSH_TOKENS = 4_000_000
LONG_WORD = 64
#: Most narrow rows (16 bytes each) that are broadcast, and most sketches (8 bytes and PARITY words each).
BROADCAST_ROWS = 200_000
BROADCAST_SKETCHES = 100_000
#: 64-bit words of a parity sketch.
PARITY = 8
#: Sets of one shingle beyond which each meets this many drawn ones before all pairs are looked at.
CROWD = 8
DRAWN = 3
#: Rounds of naming the sets so linked.
NAMINGS = 3
#: Shingles before one that are looked at to tell whether two sets have met already.
BEFORE = 4

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = bytes(b in b"\t\n\v\f\r " for b in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)
_OCTETS = 256 * np.arange(8)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_PLACES = np.random.default_rng(20).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(words: np.ndarray, shingle: int) -> np.ndarray:
    """The hash of each ``shingle`` words in a row."""
    out = np.zeros(max(0, len(words) - shingle + 1), np.uint64)
    for k in range(shingle):
        out += words[k : k + len(out)] * _PLACES[k]
    return _mix(out)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(begin, hash) of each word of ``raw``, which has a space at either end."""
    space = np.frombuffer(raw.translate(_SPACE), np.uint8)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begins, sizes = edges[0::2], edges[1::2] - edges[0::2]
    padded = raw + bytes(8)
    octets = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    hashes = _mix((octets[begins] & _MASKS[np.minimum(sizes, 8)]) * _PLACES[0] + sizes.astype(np.uint64))
    for k in range(1, LONG_WORD // 8):
        more = np.flatnonzero(sizes > 8 * k)
        if not len(more):
            break
        hashes[more] += _mix((octets[begins[more] + 8 * k] & _MASKS[np.minimum(sizes[more] - 8 * k, 8)]) * _PLACES[k])
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh64_intdigest(raw[begins[i] : begins[i] + sizes[i]], 7)
    return begins, hashes


def unique(tokens: np.ndarray) -> np.ndarray:
    """The sorted different tokens."""
    tokens = np.sort(tokens)
    return tokens[np.concatenate(([True], tokens[1:] != tokens[:-1]))] if len(tokens) else tokens


def shingle_sets(texts, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text (an Arrow array or scalars); null texts have none."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def settle():
        ends = np.cumsum([len(x) + 1 for x in held]) + 1
        begins, words = _words(b" " + b" ".join(held).translate(_LOWER) + b" ")
        spread = _shingles(words, shingle)
        at = np.searchsorted(begins, ends).tolist()
        for a, b in zip([0, *at], at, strict=False):
            if b - a >= shingle:
                out.append(unique(spread[a : b - shingle + 1]))
            elif b > a:
                out.append(_mix((words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
        held.clear()

    for text in texts:
        text = text.as_py()
        held.append(text.encode("utf-8", "surrogatepass") if text else b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES or len(held) >= 256:
            settle()
            size = 0
    if held:
        settle()
    return out


def set_hash(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes(), 42)


def simhash(tokens: np.ndarray) -> int:
    """The unsigned SimHash of a set of shingles: a bit is 1 if set in over half of them; zero if there is none."""
    octets = tokens.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8) + _OCTETS
    ones = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(2 * ones.ravel() > len(tokens), bitorder="little").view("<u8")[0])


def parity(tokens: np.ndarray, bits: int = 64 * PARITY) -> np.ndarray:
    """The parity sketch of a set of shingles, of a power of two of bits."""
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parity(tokens: np.ndarray) -> np.ndarray:
    """A parity sketch of at least four bits a shingle."""
    return parity(tokens, max(64 * PARITY, 1 << (4 * len(tokens)).bit_length()))


def _differing(a: bytes, b: bytes) -> int:
    """The bits in which two wide sketches differ; the longer one is folded first, as the parity of a place is the sum of those it is folded from."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _typed(docs: DataFrame) -> DataFrame:
    d = pick(docs, "doc_id", "text")
    return d.select(d["doc_id"].cast("long"), F.xxhash64(d["text"].cast("string")).alias("text_hash"), d["text"].cast("string"))


def set_prints(docs: DataFrame, shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """doc_id, fp (hash of the set of shingles), text_hash, n (its size), wide (its wide parity sketch), p0, p1 and so on (its parity sketch): one row per row of ``docs``.

    ``hashed``: and simhash, the 64 bits of the set's SimHash as a signed long.
    """
    sketch = [f"p{i}" for i in range(PARITY)]
    more = ["simhash"] if hashed else []

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), shingle)
            fps = pa.array(np.array([set_hash(s) for s in sets], np.uint64).view(np.int64))
            words = np.array([parity(s) for s in sets], np.int64).reshape(-1, PARITY)
            columns = [batch.column("doc_id"), fps, batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int32()), pa.array([wide_parity(s).tobytes() for s in sets], pa.binary()), *[pa.array(words[:, i].copy()) for i in range(PARITY)]]
            if hashed:
                columns.append(pa.array(np.array([simhash(s) for s in sets], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "text_hash", "n", "wide", *sketch, *more])

    return _typed(docs).mapInArrow(run, "doc_id long, fp long, text_hash long, n int, wide binary, " + ", ".join(f"{p} long" for p in [*sketch, *more]))


def _frequent(docs: DataFrame, rows: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that recur in a bounded hash sample of the texts, sorted, and their share of its texts."""
    step = max(1, -(-rows // SAMPLED_DOCS))
    texts = _typed(docs).filter(F.pmod("text_hash", F.lit(step)) == 0).select("text").distinct()

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), shingle)
            tokens = np.concatenate([*sets, np.empty(0, np.uint64)])
            part = (tokens >> np.uint64(59)).astype(np.int32)
            for p in np.unique(part).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(sets)]), pa.array([tokens[part == p].tobytes()], pa.binary())], ["part", "n", "tokens"])

    def count(table: pa.Table) -> pa.Table:
        tokens, times = np.unique(np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint64), return_counts=True)
        keep = times > 2
        return pa.table({"token": tokens[keep].view(np.int64), "times": times[keep]})

    counted = texts.mapInArrow(run, "part int, n long, tokens binary").groupBy("part").applyInArrow(count, "token long, times long")
    top = counted.orderBy(F.desc("times"), "token").limit(FREQUENT).toArrow()
    tokens, times = top.column("token").to_numpy().view(np.uint64), top.column("times").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], times[order] / max(1, min(rows, SAMPLED_DOCS))


def _meetings(docs: DataFrame, rows: int, total: int, shingle: int, tenths: int, task_tokens: int, hot_rows: int) -> DataFrame:
    """What sets share of their first shingles.

    kind 0: sets a and b, of sizes n and m, share ``count`` shingles of which a is the least set. kind 1: ``token`` is
    a first shingle of set a, of size n, and of another set. kind 2: set a is the least of a part of a frequent one.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, total / task_tokens)))))
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, rows, shingle))

    def deal(batches):
        frequent, share = shared.value
        parts = np.maximum(1, np.ceil(share * rows / hot_rows)).astype(np.int64)
        seen: set[int] = set()
        tokens, fps, sizes, counts = [], [], [], []
        held = 0

        def settle():
            t = np.concatenate(tokens)
            own = np.repeat(np.arange(len(fps)), counts)
            fp, size = np.array(fps, np.uint64), np.array(sizes, np.int32)
            bucket = (t & np.uint64((1 << bits) - 1)).astype(np.int64)  # equal ranks go by hash, so the upper bits of first shingles are mostly zero
            salt = np.zeros(len(t), np.int64)
            if len(frequent) and parts.max() > 1:
                at = np.minimum(np.searchsorted(frequent, t), len(frequent) - 1)
                hot = (frequent[at] == t) & (parts[at] > 1)
                salt[hot] = 1 + (fp[own[hot]] % parts[at[hot]].astype(np.uint64)).astype(np.int64)
            key = bucket << 24 | salt
            low = (t >> np.uint64(bits)).astype(np.uint32)
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                docs_here, n_here = np.unique(own[order[a:b]], return_counts=True)
                arrays = (fp[docs_here], size[docs_here], n_here.astype(np.int32), low[order[a:b]])
                yield pa.RecordBatch.from_arrays([pa.array([int(key[order[a]])]), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], ["key", "fps", "sizes", "counts", "tokens"])
            for x in (tokens, fps, sizes, counts):
                x.clear()

        for batch in batches:
            for s in shingle_sets(batch.column("text"), shingle):
                fp, n = set_hash(s), len(s)
                if not n or fp in seen:
                    continue
                seen.add(fp)
                rank = np.zeros(n)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    rank = np.where(frequent[at] == s, share[at], 0)
                # Sets that share at least ceil(n * tenths / 10) shingles meet in one of these; equal ranks go by hash.
                first = s[np.argsort(rank, kind="stable")[: n + (-n * tenths) // 10 + 1]]
                tokens.append(first)
                fps.append(fp)
                sizes.append(n)
                counts.append(len(first))
                held += len(first)
                if held >= FLUSH_TOKENS:
                    yield from settle()
                    held = 0
        if fps:
            yield from settle()

    schema = "kind int, token long, a long, b long, n int, m int, count int"

    def meet(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        read = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        fps, of = np.unique(read("fps", np.uint64), return_inverse=True)
        sizes = np.zeros(len(fps), np.int32)
        sizes[of] = read("sizes", np.int32)
        # Sorted by token, then set; a set met in two blocks counts once.
        pair = read("tokens", np.uint32).astype(np.uint64) << np.uint64(32) | np.repeat(of, read("counts", np.int32)).astype(np.uint64)
        pair = np.unique(pair)
        token, own = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], np.diff(token) != 0)))
        lengths = np.diff(np.concatenate((starts, [len(token)])))
        several = np.repeat(lengths > 1, lengths)
        least = np.repeat(own[starts], lengths)
        name = (np.int64(key >> 24) << np.int64(32)) + token
        signed = fps.view(np.int64)
        star = several & (own != least) & (10 * sizes[own] >= tenths * sizes[least]) & (10 * sizes[least] >= tenths * sizes[own])
        linked, times = np.unique(least[star] * len(fps) + own[star], return_counts=True)
        a, b = linked // max(1, len(fps)), linked % max(1, len(fps))
        centre = np.zeros(len(token), bool)
        if key & 0xFFFFFF:  # a part of a frequent shingle: other parts may hold its other sets
            several = np.ones(len(token), bool)
            centre[starts] = True
        c, s = np.flatnonzero(centre), np.flatnonzero(several)
        empty = lambda k: np.zeros(k, np.int64)
        columns = {
            "kind": np.concatenate((empty(len(a)), empty(len(s)) + 1, empty(len(c)) + 2)).astype(np.int32),
            "token": np.concatenate((empty(len(a)), name[s], name[c])),
            "a": signed[np.concatenate((a, own[s], own[c]))],
            "b": signed[np.concatenate((b, own[s], own[c]))],
            "n": sizes[np.concatenate((a, own[s], own[c]))],
            "m": sizes[np.concatenate((b, own[s], own[c]))],
            "count": np.concatenate((times, empty(len(s)), empty(len(c)))).astype(np.int32),
        }
        return pa.table(columns)

    blocks = _typed(docs).select("text").mapInArrow(deal, "key long, fps binary, sizes binary, counts binary, tokens binary")
    return blocks.groupBy("key").applyInArrow(meet, schema)


def _similar(pairs: DataFrame, prints: DataFrame, docs: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """Those of ``pairs`` (a, b: set hashes) whose whole sets of shingles are similar enough.

    Pairs whose wide sketches differ in more bits than similar sets can are left out before texts are met.
    """
    release(docs.sparkSession)
    members = pairs.select(F.col("a").alias("m")).union(pairs.select(F.col("b").alias("m"))).distinct()
    met = join_small(prints, members, prints["fp"] == members["m"], "left_semi", 2 * pairs.count(), BROADCAST_ROWS)
    hashes = cut(met.groupBy("fp").agg(F.min("text_hash").alias("h"), F.min("n").alias("n"), F.min("wide").alias("wide")))
    wa, wb = (hashes.select(F.col("fp").alias(f"{x}_fp"), F.col("n").alias(f"{x}_n"), F.col("wide").alias(f"{x}_wide")) for x in "ab")
    sketched = pairs.join(wa, pairs["a"] == wa["a_fp"]).join(wb, pairs["b"] == wb["b_fp"]).select("a", "b", "a_n", "b_n", "a_wide", "b_wide")

    def sift(batches):
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            keep = [_differing(*w) * (10 + tenths) <= (i + j) * (10 - tenths) for i, j, w in zip(n, m, zip(x, y, strict=True), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = cut(sketched.mapInArrow(sift, "a long, b long"))
    members = pairs.select(F.col("a").alias("m")).union(pairs.select(F.col("b").alias("m"))).distinct()
    hashes = cut(hashes.join(members, hashes["fp"] == members["m"], "left_semi").select("fp", "h"))
    texts = _typed(docs).select("text", "text_hash")
    met = join_small(texts, hashes, texts["text_hash"] == hashes["h"], "inner", hashes.count(), BROADCAST_ROWS)
    met = met.groupBy("fp").agg(F.first("text").alias("text"))
    left, right = (met.select(F.col("fp").alias(f"{x}_fp"), F.col("text").alias(f"{x}_text")) for x in "ab")
    joined = pairs.join(left, pairs["a"] == left["a_fp"]).join(right, pairs["b"] == right["b_fp"]).select("a", "b", "a_text", "b_text")

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            of = dict(zip(a, batch.column("a_text"), strict=True)) | dict(zip(b, batch.column("b_text"), strict=True))
            sets = dict(zip(of, shingle_sets(of.values(), shingle), strict=True))
            both = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)]
            keep = [n * (10 + tenths) >= (len(sets[x]) + len(sets[y])) * tenths for n, x, y in zip(both, a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(joined.mapInArrow(run, "a long, b long"))


def _contracted(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (u, v): nodes of one root are of one component.

    One task names the nodes of few edges. Of more, each round names a node after the least node within two steps,
    and goes on with the edges between names; a long chain keeps several roots after ``NAMINGS`` rounds, which costs its sets a comparison and changes no link.
    """
    edges = cut(edges.filter("u <> v").select("u", "v").distinct())
    if edges.count() <= common.ONE_TASK:
        return cut(in_one_task(edges))
    found = None
    for _ in range(NAMINGS):
        release(edges.sparkSession)
        both = cut(edges.filter("u <> v").select(F.explode(F.expr("array(struct(u, v), struct(v as u, u as v))")).alias("e")).select("e.u", "e.v").distinct())
        if found is not None and both.isEmpty():
            break
        step = both.groupBy(F.col("u").alias("w")).agg(F.min(F.least("u", "v")).alias("l"))
        names = cut(both.join(step, both["v"] == step["w"]).groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "l")).alias("root")))
        size = names.count()

        def renamed(rows: DataFrame, column: str) -> DataFrame:
            to = names.select(F.col("node").alias("t_node"), F.col("root").alias("t_root"))
            return join_small(rows, to, F.col(column) == F.col("t_node"), "left", size, BROADCAST_ROWS).withColumn(column, F.coalesce("t_root", column)).drop("t_node", "t_root")

        found = names if found is None else cut(renamed(found, "root"))
        edges = renamed(renamed(both, "u"), "v")
    return found


def similar_links(prints: DataFrame, docs: DataFrame, components, shingle: int = SHINGLE, tenths: int = TENTHS, task_tokens: int = TASK_TOKENS, hot_rows: int = HOT_ROWS, candidates: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between the set hashes of ``prints`` whose closure is that of all pairs of Jaccard similarity ``tenths`` / 10 or more.

    ``components`` gives (node, root) of links. ``candidates`` (a, b; a < b) are pairs found by other means, which are decided first.
    """
    rows, total = prints.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    met = cut(_meetings(docs, rows, total * (10 - tenths) / 10, shingle, tenths, task_tokens, hot_rows))
    alike = f"10 * least(n, m) >= {tenths} * greatest(n, m)"

    def enough(count: str) -> str:
        # Beyond the first shingles that meet, two texts share at most what follows the first ones of the larger.
        return f"({count} + ({tenths} * greatest(n, m) + 9) div 10 - 1) * {10 + tenths} >= (n + m) * {tenths}"

    def possible(shared: DataFrame) -> DataFrame:
        counted = shared.groupBy("a", "b", "n", "m").agg(F.sum("count").alias("count"))
        return cut(counted.filter(enough("count")).select("a", "b"))

    centres = met.filter("kind = 2").select("token", "a", "n")
    least = centres.groupBy("token").agg(F.min(F.struct("a", "n")).alias("s")).select(F.col("token").alias("s_token"), F.col("s.a").alias("s_a"), F.col("s.n").alias("s_n"))
    between = centres.join(least, F.col("token") == F.col("s_token")).filter("a <> s_a")
    between = between.select(F.col("s_a").alias("a"), F.col("a").alias("b"), F.col("s_n").alias("n"), F.col("n").alias("m"), F.lit(1).alias("count")).filter(alike)
    stars = possible(met.filter("kind = 0").select("a", "b", "n", "m", "count").union(between))
    if candidates is not None:
        stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        stars = cut(stars.union(candidates.select("a", "b")).distinct())
    stars = _similar(stars, prints, docs, shingle, tenths)
    sketch = [f"p{i}" for i in range(PARITY)]
    # Sets of similarity t differ in at most (n + m) * (1 - t) / (1 + t) shingles.
    near = f"({' + '.join(f'bit_count({p} ^ o_{p})' for p in sketch)}) * {10 + tenths} <= (n + m) * {10 - tenths}"

    def still_apart(tokens: DataFrame, groups: DataFrame) -> DataFrame:
        """token, fp, n, group, sets, weight: the first shingles whose sets have several labels by ``groups`` (node, root); those met in the same sets are one, of their summed weight."""
        tokens = join_small(tokens, groups, tokens["group"] == groups["node"], "left", groups.count(), BROADCAST_ROWS).select("token", "fp", "n", "weight", F.coalesce("root", "group").alias("group"))
        same = [F.bit_xor(F.xxhash64("fp", F.lit(i))).alias(f"x{i}") for i in range(2)]
        apart = tokens.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("sets"), F.max("weight").alias("weight"), *same)
        apart = apart.filter("low <> high").groupBy("x0", "x1", "sets").agg(F.min("token").alias("t"), F.sum("weight").alias("weight")).select("t", "sets", "weight")
        return cut(tokens.drop("weight").join(apart, tokens["token"] == apart["t"]).drop("t"))

    def in_order(tokens: DataFrame, before: int = 0) -> DataFrame:
        """And rest: the weight of the set's shingles from this one on, those of the fewest sets coming first; b0 and so on: the ones right before it."""
        order = Window.partitionBy("fp").orderBy("sets", "token")
        rest = F.sum("weight").over(Window.partitionBy("fp")) - F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight")
        return tokens.select("*", rest.alias("rest"), *[F.lag("token", i + 1).over(order).alias(f"b{i}") for i in range(before)])

    roots = components(stars)
    roots = cut(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()))
    tokens = still_apart(met.filter("kind = 1").select("token", F.col("a").alias("fp"), "n", F.lit(1).cast("long").alias("weight"), F.col("a").alias("group")), roots)
    sketches = prints.join(tokens.select(F.col("fp").alias("t_fp")).distinct(), F.col("fp") == F.col("t_fp"), "left_semi")
    sketches = cut(sketches.groupBy(F.col("fp").alias("s_fp")).agg(*[F.min(p).alias(p) for p in sketch]))
    many = sketches.count()

    def sketched(tokens: DataFrame, fp: str = "fp") -> DataFrame:
        return join_small(tokens, sketches, tokens[fp] == sketches["s_fp"], "inner", many, BROADCAST_SKETCHES).drop("s_fp")

    # Where many sets share a shingle, each meets some drawn for that shingle first, which links most of those that can be.
    crowd = in_order(tokens).filter(F.col("sets") > CROWD)
    draws = [F.xxhash64("fp", "token", F.lit(i)) for i in range(DRAWN)]
    least = crowd.groupBy(F.col("token").alias("o_token")).agg(*[F.min(d).alias(f"l{i}") for i, d in enumerate(draws)])
    of_draw = F.coalesce(*[F.when(d == F.col(f"l{i}"), True) for i, d in enumerate(draws)])
    drawn = crowd.join(least, F.col("token") == F.col("o_token")).filter(of_draw)
    drawn = sketched(drawn.select("o_token", F.col("fp").alias("b"), F.col("n").alias("m"), F.col("group").alias("o_group"), F.col("rest").alias("o_rest")), "b")
    drawn = drawn.select("o_token", "b", "m", "o_group", "o_rest", *[F.col(p).alias(f"o_{p}") for p in sketch])
    pairs = sketched(crowd).join(drawn, (F.col("token") == F.col("o_token")) & (F.col("group") != F.col("o_group"))).filter(alike).filter(enough("least(rest, o_rest)")).filter(near)
    pairs = cut(pairs.select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct())
    met_here = _similar(pairs, prints, docs, shingle, tenths)
    links = stars.union(met_here)
    many_roots = roots.count()
    named = met_here
    for x in "ab":
        side = roots.select(F.col("node").alias(f"{x}_node"), F.col("root").alias(f"{x}_root"))
        named = join_small(named, side, F.col(x) == F.col(f"{x}_node"), "left", many_roots, BROADCAST_ROWS).withColumn(f"{x}_group", F.coalesce(f"{x}_root", x))
    labels = _contracted(named.select(F.col("a_group").alias("u"), F.col("b_group").alias("v")))
    tokens = sketched(in_order(still_apart(tokens.select("token", "fp", "n", "weight", "group"), labels), BEFORE)).drop("sets", "weight")

    # Sets of whose last shingles before this one two are the same have met there, and had more left to share.
    befores = [f"b{i}" for i in range(BEFORE)]
    met_before = " OR ".join(f"{x} <=> o_{y} AND {x} IS NOT NULL" for x in befores for y in befores)
    other = {"token": "o_token", "fp": "b", "n": "m"} | {c: f"o_{c}" for c in ["group", "rest", *befores, *sketch]}
    other = tokens.select(*[F.col(c).alias(name) for c, name in other.items()])
    pairs = tokens.join(other, (F.col("token") == F.col("o_token")) & (F.col("fp") < F.col("b")) & (F.col("group") != F.col("o_group")))
    pairs = pairs.filter(alike).filter(enough("least(rest, o_rest)")).filter(f"NOT ({met_before})").filter(near)
    pairs = cut(pairs.select(F.col("fp").alias("a"), "b").distinct())
    return links.union(_similar(pairs, prints, docs, shingle, tenths))
