"""SimHash near-duplicates by vantage-point trees over Hamming space.

Every text becomes a 64-bit SimHash of its word shingles. Distinct
fingerprints are partitioned by vantage-point trees: a node holds a vantage
point v and a bound m; fingerprints at distance at most m + r from v go
inside, those beyond m outside, so that the shell (m, m + r] is in both. By
the triangle inequality any two fingerprints within r of each other share at
least one leaf, and whole branches are pruned for all others.

The trees measure distance on a third of the bits each: two fingerprints that
differ in at most k bits differ in at most r = k // parts bits on one of the
parts, so the union over the parts' trees loses no pair, while a smaller r
keeps the shells thin. Leaves compare the full 64 bits exactly. Inside a leaf
a vantage point with a dense ball resolves the ball against its shell only,
so a large group of near copies costs no pair enumeration; a leaf that is
still overfull is dealt out by equal parts of the bits. The leaf emits a
spanning forest of its links, and alternating large-star / small-star rounds
join the forests into components.

The trees' shape comes from a bounded hash sample of the fingerprints
(``SAMPLE``); it steers cost only, never which links are found.

``keep_one_by_jaccard`` is the pipeline's stage. The trees link the SimHashes of
the texts' sets of 5-word shingles, and the sets themselves decide which of
those links are of Jaccard similarity 0.8 or more. Texts that similar differ in
up to a dozen or more bits and no useful radius holds them all, so the links
that the SimHashes miss are then found from the sets, exactly (module
``shingle_sets``).

Defined results: null, empty and wordless texts have fingerprint zero and are
linked like any other; repeated rows give repeated result rows; a null doc_id
never is a component's name unless the component has no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm import common, shingle_sets
from lakeweave.llm.common import cut, in_one_task, join_keyed, join_small, pick, release

SHINGLE = 4
DIFFER = 4
SEED = 42
SAMPLE = 65_536
LEAF = 3_072
#: Fewest sampled fingerprints in a node that is split.
LEAST_SAMPLED = 24
#: Rows of a leaf compared at once.
BLOCK = 256
#: Columns of such a comparison, and fingerprints of a leaf beyond which it is dealt out again by equal parts.
TILE = 65_536
OVERFULL = 8_192
#: Vantage points tried at a node of a tree.
TRIED = 6
#: Most dropped ids that are broadcast (16 bytes each, some 100 on the driver's heap); more are joined by shuffle.
BROADCAST_IDS = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's word shingles, in their order; the whole text's if it has fewer words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    whole, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(begins[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(whole[a:b], seed) for a, b in spans), np.uint64, n - shingle + 1)


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text; zero if it has no word."""
    hashes = shingle_hashes(text, shingle, seed)
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), text_hash; one row per row of ``docs``."""
    d = pick(docs, "doc_id", "text")
    d = d.select(d["doc_id"].cast("long"), F.xxhash64("text").alias("text_hash"), d["text"].cast("string"))

    def run(batches):
        for batch in batches:
            fps = [simhash(x.as_py(), shingle, seed) for x in batch.column("text")]
            fps = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

    return d.mapInArrow(run, "doc_id long, fp long, text_hash long")


def _parts(differ: int) -> list[tuple[int, int]]:
    """(shift, width) of each tree's bits; differ // parts is 1, or 0 for exact search."""
    n = differ // 2 + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _project(fps: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    shift, width = part
    return (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def build_tree(points: np.ndarray, radius: int, scale: float, leaf: int = LEAF) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, bound, inside, outside) over projected sample points; a child below 0 is leaf -1 - child.

    ``scale`` is how many fingerprints a sampled one stands for.
    """
    rng = np.random.default_rng(7)
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0
    pending: list[tuple[np.ndarray, int, int]] = [(points, -1, 0)]
    while pending:
        pts, parent, side = pending.pop()
        best = None
        if len(pts) * scale > leaf and len(pts) >= LEAST_SAMPLED:
            for v in pts[rng.integers(0, len(pts), TRIED)]:
                counts = np.bincount(np.bitwise_count(pts ^ v), minlength=66)
                below = np.cumsum(counts)
                inner = below[np.minimum(np.arange(66) + radius, 65)]
                outer = len(pts) - below
                cost = inner.astype(float) ** 2 + outer.astype(float) ** 2
                m = int(np.argmin(cost))
                if max(inner[m], outer[m]) <= 0.9 * len(pts) and (best is None or cost[m] < best[0]):
                    best = (cost[m], int(v), m)
        if best is None:
            me, leaves = -1 - leaves, leaves + 1
        else:
            me = len(nodes)
            nodes.append((best[1], best[2], 0, 0))
            d = np.bitwise_count(pts ^ np.uint64(best[1]))
            pending.append((pts[d <= best[2] + radius], me, 2))
            pending.append((pts[d > best[2]], me, 3))
        if parent >= 0:
            node = list(nodes[parent])
            node[side] = me
            nodes[parent] = tuple(node)
    return nodes


def _route(nodes, points: np.ndarray, radius: int):
    """Yield (leaf, indexes of the points in it)."""
    if not nodes:
        yield 0, np.arange(len(points))
        return
    pending = [(0, np.arange(len(points)))]
    while pending:
        at, idx = pending.pop()
        if not len(idx):
            continue
        if at < 0:
            yield -1 - at, idx
            continue
        vantage, bound, inside, outside = nodes[at]
        d = np.bitwise_count(points[idx] ^ np.uint64(vantage))
        pending.append((inside, idx[d <= bound + radius]))
        pending.append((outside, idx[d > bound]))


def leaf_links(fps: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: (from, to) indexes, each to its group's first."""
    n = len(fps)
    label = np.arange(n)

    def unite(members: np.ndarray) -> None:
        roots = np.unique(label[members])
        if len(roots) > 1:
            label[np.isin(label, roots[1:])] = roots[0]

    left = np.arange(n)
    rng = np.random.default_rng(11)
    tries = 0
    while len(left) > BLOCK and tries < 16:  # dense balls first: members need their shell only
        p = left[int(rng.integers(0, len(left)))]
        d = np.bitwise_count(fps[left] ^ fps[p])
        ball, shell = left[d <= differ], left[(d > differ) & (d <= 2 * differ)]
        if len(ball) < max(32, len(left) // 50):
            tries += 1
            continue
        unite(ball)
        for x in ball:
            if len(near := shell[np.bitwise_count(fps[shell] ^ fps[x]) <= differ]):
                unite(np.append(near, x))
        left = left[d > differ]
        tries = 0

    def compare(members: np.ndarray) -> None:
        rest = fps[members]
        for a in range(0, len(members), BLOCK):
            for b in range(a, len(members), TILE):
                close = np.bitwise_count(rest[a : a + BLOCK, None] ^ rest[None, b : b + TILE]) <= differ
                rows, cols = np.nonzero(close)
                keep = cols + b > rows + a
                rows, cols = members[a + rows[keep]], members[b + cols[keep]]
                while len(rows):  # links inside one group drop out as groups grow
                    apart = label[rows] != label[cols]
                    rows, cols = rows[apart], cols[apart]
                    if len(rows):
                        unite(np.append(cols[rows == rows[0]], rows[0]))

    if len(left) <= OVERFULL:
        compare(left)
    else:  # an overfull leaf is dealt out again: of differ + 1 parts of the bits, linked fingerprints share one
        edges = [round(64 * i / (differ + 1)) for i in range(differ + 2)]
        for a, b in zip(edges, edges[1:], strict=False):
            part = _project(fps[left], (a, b - a))
            order = np.argsort(part, kind="stable")
            bounds = np.flatnonzero(np.diff(part[order])) + 1
            for members in np.split(left[order], bounds):
                if len(members) > 1:
                    compare(members)
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def links(distinct: DataFrame, differ: int = DIFFER, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose closure is that of all pairs within ``differ`` bits."""
    spark = distinct.sparkSession
    total = distinct.count()
    step = max(1, -(-total // sample))
    drawn = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0) if step > 1 else distinct
    drawn = np.array([r[0] for r in drawn.collect()], np.int64).view(np.uint64)  # about `sample` of them
    parts = _parts(differ)
    radius = differ // len(parts)
    trees = [(p, build_tree(np.unique(_project(drawn, p)) if radius == 0 else _project(drawn, p), radius, step, leaf)) for p in parts]
    shared = spark.sparkContext.broadcast(trees)

    def deal(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t, (part, nodes) in enumerate(shared.value):
                for cell, idx in _route(nodes, _project(fps, part), radius):
                    cells = np.full(len(idx), (t << 40) | cell, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(fps[idx].view(np.int64))], ["cell", "fp"])

    def resolve(table: pa.Table) -> pa.Table:
        fps = np.sort(table.column("fp").to_numpy()).view(np.uint64)
        a, b = leaf_links(fps, differ)
        return pa.table({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    cells = distinct.select("fp").mapInArrow(deal, "cell long, fp long")
    return cells.groupBy("cell").applyInArrow(resolve, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the undirected ``edges`` (a, b) but the roots; root is the least node of its component.

    Up to ``ONE_TASK`` edges are joined by one task: a round is a dozen jobs,
    whose plans and threads are what fills the driver. More go by alternating
    large-star and small-star rounds until nothing changes; every
    round is one table in the checkpoint folder. The neighbourhood's least node
    is a map-side combined aggregate, never a collected list, and hubs meet
    theirs by broadcast.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    if edges.count() <= common.ONE_TASK:
        return cut(in_one_task(edges).filter("node <> root"))
    seen = None
    while True:
        release(edges.sparkSession)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "rows"))
        large = join_keyed(both, least, "u", "w", "inner", "rows").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo <> hi").distinct()
        large = cut(large)
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("rows")).select(F.col("hi").alias("w"), "m", "rows"))
        small = join_keyed(large, least, "hi", "w", "inner", "rows")
        small = small.select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).filter("lo <> hi").distinct()
        edges = cut(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = state


def _named(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """class_fp, class_id, component_id for every row of ``distinct`` (fp, first_id) by its links ``edges``."""
    roots = components(edges)
    roots = cut(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()))
    named = distinct.join(roots, distinct["fp"] == roots["node"])
    named = named.groupBy("root").agg(F.min("first_id").alias("least_id")).select(F.col("root").alias("r"), "least_id")
    per_node = roots.join(named, roots["root"] == named["r"]).select("node", "root", "least_id")
    joined = distinct.join(per_node, distinct["fp"] == per_node["node"], "left")
    return joined.select(F.col("fp").alias("class_fp"), F.coalesce("root", "fp").alias("class_id"), F.coalesce("least_id", "first_id").alias("component_id"))


def _classed(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``prints`` with class_id and component_id; fingerprints of very many rows are met by broadcast."""
    classes = cut(_named(distinct, edges).join(distinct.select(F.col("fp").alias("d_fp"), "rows"), F.col("class_fp") == F.col("d_fp")).drop("d_fp"))
    return join_keyed(prints, classes, "fp", "class_fp", "inner", "rows").drop("class_fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, differ: int = DIFFER, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """doc_id, fp, text_hash, class_id (a fingerprint), component_id: one row per row of ``docs``."""
    prints = cut(fingerprints(docs, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")))
    return _classed(prints, distinct, links(distinct, differ, sample, leaf))


def near_duplicates_by_jaccard(docs: DataFrame, shingle: int = shingle_sets.SHINGLE, tenths: int = shingle_sets.TENTHS) -> DataFrame:
    """doc_id, fp (hash of the set of shingles), text_hash, class_id, component_id: one row per row of ``docs``."""
    return _by_jaccard(docs, cut(shingle_sets.set_prints(docs, shingle)), None, shingle, tenths)


def _by_jaccard(docs: DataFrame, prints: DataFrame, candidates: DataFrame | None, shingle: int, tenths: int) -> DataFrame:
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")))
    edges = shingle_sets.similar_links(prints, docs, components, shingle, tenths, candidates=candidates)
    return _classed(prints.select("doc_id", "fp", "text_hash"), distinct, edges)


def simhash_candidates(prints: DataFrame, differ: int = DIFFER, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """a, b (a < b): pairs of the set hashes ``fp`` whose closure is that of all pairs with ``simhash`` within ``differ`` bits, by the vantage-point trees."""
    sets = prints.groupBy("fp").agg(F.min("simhash").alias("simhash"))
    sets = cut(sets)
    centres = cut(sets.groupBy("simhash").agg(F.min("fp").alias("centre"), F.count(F.lit(1)).alias("rows")))
    near = links(centres.select(F.col("simhash").alias("fp")), differ, sample, leaf)
    a, b = (centres.select(F.col("simhash").alias(f"{x}_hash"), F.col("centre").alias(x)) for x in "ab")
    between = near.toDF("x", "y").join(a, F.col("x") == F.col("a_hash")).join(b, F.col("y") == F.col("b_hash")).select("a", "b")
    several = cut(centres.filter("rows > 1").select(F.col("simhash").alias("c_hash"), "centre", "rows"))
    equal = join_keyed(sets, several, "simhash", "c_hash", "inner", "rows").filter("fp <> centre").select(F.col("centre").alias("a"), F.col("fp").alias("b"))
    return cut(between.union(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def with_clusters(docs: DataFrame) -> DataFrame:
    """doc_id, source, text of every row of ``docs``, and cluster: its near-duplicate class, or its text's hash where the class has one text only."""
    d = pick(docs, "doc_id", "source", "text")
    found = near_duplicates_by_jaccard(d)
    found = cut(found.groupBy("text_hash").agg(F.min("class_id").alias("class_id")))
    several = found.groupBy("class_id").count().filter("count > 1").select(F.col("class_id").alias("cluster"))
    classes = cut(found.join(several, found["class_id"] == several["cluster"]).select("text_hash", "cluster"))
    d = d.withColumn("k_hash", F.xxhash64(d["text"].cast("string")))
    joined = join_small(d, classes, d["k_hash"] == classes["text_hash"], "left", classes.count(), BROADCAST_IDS)
    return joined.select("doc_id", "source", "text", F.coalesce("cluster", "k_hash").alias("cluster"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, differ: int = DIFFER, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """One row of each near-duplicate group, with all columns of ``docs``: the one of smallest doc_id.

    Rows without doc_id stand after all others of their group; ties are broken
    by the text's hash, and rows that repeat in doc_id and text are one.
    """
    return _first_rows(docs, near_duplicates(docs, shingle, differ, sample, leaf))


def keep_one_by_jaccard(docs: DataFrame, shingle: int = shingle_sets.SHINGLE, tenths: int = shingle_sets.TENTHS) -> DataFrame:
    """As ``keep_one``, with groups of texts linked by Jaccard similarity ``tenths`` / 10 or more; texts without a word are one group.

    SimHashes within ``DIFFER`` bits, found by the vantage-point trees, are the first candidates; whole sets of shingles decide.
    """
    prints = cut(shingle_sets.set_prints(docs, shingle, hashed=True))
    found = _by_jaccard(docs, prints, simhash_candidates(prints), shingle, tenths)
    return _first_rows(docs, found)


def _first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The first row of each class of ``found``."""
    names = docs.columns
    release(docs.sparkSession)
    # A row's key is its doc_id and text hash; the first key of each group stays.
    keys = cut(found.groupBy("class_id", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    first = keys.groupBy("class_id").agg(F.min(order).alias("o"))
    first = first.select(F.col("o.doc_id").alias("f_id"), F.col("o.text_hash").alias("f_hash")).distinct()
    met = keys.join(first, keys["doc_id"].eqNullSafe(first["f_id"]) & (keys["text_hash"] == first["f_hash"]), "left")
    met = cut(met.select("doc_id", "text_hash", "rows", F.col("f_hash").isNotNull().alias("stays")))
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (flat[f"c{names.index(n)}"] for n in ("doc_id", "text"))
    flat = flat.withColumns({"k_id": doc_id.cast("long"), "k_hash": F.xxhash64(text)})

    def meet(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"))
        right = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
        return flat.join(right, flat["k_id"].eqNullSafe(keys["g_id"]) & (flat["k_hash"] == keys["g_hash"]), how)

    once = meet(met.filter("NOT stays OR rows > 1"), "left_anti")
    repeated = meet(met.filter("stays AND rows > 1"), "left_semi").dropDuplicates(["k_id", "k_hash"])
    return once.unionByName(repeated).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
