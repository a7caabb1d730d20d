"""Conflict-constrained best-fit packing of documents into sequences.

Documents are measured in words and packed into bins of ``capacity`` words. A
bin never holds two documents of one source or of one duplicate cluster. Each
packing shard is a hash share of all documents, of about ``shard_rows`` rows;
within it documents go in by falling size, each into the tightest bin that has
room and no conflict: bins are kept in order of residual capacity, carry a
bitmap of sources and one of clusters, and the search walks on from the
successor of the document's size until a compatible bin is found. A source or
cluster with over ``HOT`` of a shard's rows has a residual-ordered list of its
own of the bins that are free of it, so that a hot source costs no long walks.

A document longer than a bin is cut into full bins and a rest, which is packed
like a document.

Defined results: null, empty and wordless texts have size 0 and are returned
with bin and start null (they take no room); a null source is a source of its
own; copies of a row are packed apart, as they are of one cluster; an empty
table gives an empty result; extra columns are ignored, one called ``cluster``
too unless it is named as such.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import n_words, pick

CAPACITY = 2_048
SHARD_ROWS = 8_192
HOT = 0.05

SCHEMA = "doc_id long, source string, size long, cluster long, piece long, words long, bin string, start long"


class Bins:
    """Open bins of one shard, in order of residual capacity."""

    def __init__(self, capacity: int, hot: set):
        self.capacity = capacity
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.views: dict = {None: []} | {k: [] for k in hot}

    def _entry(self, b: int) -> int:
        return self.room[b] << 32 | b

    def _holds(self, b: int, key) -> bool:
        return key is not None and bool((self.sources if key[0] == "s" else self.clusters)[b] >> key[1] & 1)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, start) of the tightest compatible bin, a new one if there is none. cluster -1: of no cluster."""
        s, c = 1 << source, 1 << cluster if cluster >= 0 else 0
        keys = [k for k in (("s", source), ("c", cluster)) if k in self.views]
        view = min((self.views[k] for k in keys), key=len) if keys else self.views[None]
        for i in range(bisect_left(view, size << 32), len(view)):
            b = view[i] & 0xFFFFFFFF
            if not (self.sources[b] & s or self.clusters[b] & c):
                for key, entries in self.views.items():
                    if not self._holds(b, key):
                        del entries[bisect_left(entries, self._entry(b))]
                break
        else:
            b = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        start = self.capacity - self.room[b]
        self.room[b] -= size
        self.sources[b] |= s
        self.clusters[b] |= c
        for key, entries in self.views.items():
            if self.room[b] and not self._holds(b, key):
                insort(entries, self._entry(b))
        if not self.room[b]:
            self.sources[b] = self.clusters[b] = -1
        return b, start


def pack_shard(rows: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """(row, piece, words, bin, start) of each piece; rows are (size, source, cluster), row is an index."""
    sources: dict = {}
    times: dict = {}
    many: dict = {}
    for size, source, cluster in rows:
        if size:
            times[("s", source)] = times.get(("s", source), 0) + 1
            many[cluster] = many.get(cluster, 0) + 1
    clusters = {c: i for i, c in enumerate(k for k, n in many.items() if n > 1)}
    for _, source, _ in rows:
        sources.setdefault(source, len(sources))
    least = HOT * len(rows)
    hot = {("s", sources[k[1]]) for k, n in times.items() if n > least} | {("c", i) for c, i in clusters.items() if many[c] > least}
    bins, out = Bins(capacity, hot), []
    pieces = []
    for i, (size, _, _) in enumerate(rows):
        full, rest = divmod(size, capacity)
        pieces += [(capacity, i, k) for k in range(full)]
        if rest:
            pieces.append((rest, i, full))
        elif not full:
            out.append((i, 0, 0, None, None))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    for words, i, k in pieces:
        b, start = bins.place(words, sources[rows[i][1]], clusters.get(rows[i][2], -1))
        out.append((i, k, words, b, start))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, cluster: str | None = None) -> DataFrame:
    """One row per piece: doc_id, source, size, cluster, piece, words, bin, start.

    ``cluster`` names a column of ``docs`` (long) with duplicate clusters; where it is null, or none is named,
    the cluster is the hash of the text in lower case with white space made single spaces. The result is a
    function of the table's rows alone, not of their order or partitioning.
    """
    d = pick(docs, "doc_id", "source", "text", *([cluster] if cluster else []))
    plain = F.xxhash64(F.regexp_replace(F.lower(F.trim(d["text"])), r"[\x20\x09-\x0D]+", " "))
    d = d.select(
        d["doc_id"].cast("long"), d["source"].cast("string"), n_words(d["text"]).alias("size"),
        (F.coalesce(d[cluster].cast("long"), plain) if cluster else plain).alias("cluster"),
    )
    # Rows equal in all of this are numbered, so that a hot row's copies go to shards of their own.
    d = d.groupBy("doc_id", "source", "size", "cluster").count()
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("count")
    shards = max(1, -(-docs.count() // shard_rows))
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(shards)).cast("int")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("cluster", "doc_id", "source", "size")])
        columns = {c: table.column(c).to_pylist() for c in ("doc_id", "source", "size", "cluster", "shard")}
        rows = list(zip(columns["size"], columns["source"], columns["cluster"], strict=True))
        got = pack_shard(rows, capacity)
        at = [g[0] for g in got]
        of = lambda c: [columns[c][i] for i in at]
        names = [None if g[3] is None else f"{columns['shard'][g[0]]}-{g[3]}" for g in got]
        arrays = [pa.array(of("doc_id"), pa.int64()), pa.array(of("source"), pa.string()), pa.array(of("size"), pa.int64()), pa.array(of("cluster"), pa.int64())]
        arrays += [pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array(names, pa.string()), pa.array([g[4] for g in got], pa.int64())]
        return pa.Table.from_arrays(arrays, ["doc_id", "source", "size", "cluster", "piece", "words", "bin", "start"])

    return d.withColumn("shard", shard).drop("copy").groupBy("shard").applyInArrow(run, SCHEMA)
