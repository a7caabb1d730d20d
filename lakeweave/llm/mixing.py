"""Mixing sources to target weights by repetition rates.

Aggregate the words of each source, share a budget over the sources by weight
(no source beyond ``most`` times its size), derive each source's repetition
rate target / size, and emit every document floor(rate) times plus one more
copy if a hash-seeded uniform number lies below the rate's fraction.

Defined results: a null source is a source of its own, ordered last; null,
empty and wordless texts have size 0 and follow their source's rate; an empty
table gives an empty result; repeated rows of one doc_id draw the same number;
rows without a doc_id draw by their text. Extra columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import cut, join_small, n_words, pick

#: Most sources whose table (about 60 bytes a row) is broadcast.
BROADCAST_SOURCES = 100_000
#: A hot source's rows spread over so many keys where the table of sources is shuffled.
SALTS = 64


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from 52 bits of an MD5 of seed and document."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(text)), F.lit("null"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0
) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    ``sizes`` has source and size. Sources in code point order, null last, take
    ``weights`` in turn. The targets are min(most * size, weight * level) for the
    level at which they add up to ``budget`` times all sizes: what re-sharing the
    excess of capped sources by weight converges to. Sources ordered by
    size / weight are capped as a prefix, so running sums find the level. The
    windows order one narrow row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1))
    per = per.withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(whole)
    left = F.lit(budget) * total - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left)
    place = F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last()))
    per = per.withColumn("place", place)  # the first source below its cap has the level
    per = per.withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(whole)["level"])
    target = F.least(F.lit(most) * F.col("source_size"), F.coalesce(F.col("weight") * F.col("level"), F.lit(float("inf"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def with_copies(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Add source_size, target and copies to rows that have source and draw."""
    count = targets.count()
    if count <= BROADCAST_SOURCES:
        s = targets.select(F.col("source").alias("s_source"), "source_size", "target", "rate")
        joined = docs.join(F.broadcast(s), docs["source"].eqNullSafe(s["s_source"]), "left")
    else:
        s = targets.select(F.col("source").alias("s_source"), "source_size", "target", "rate")
        s = s.withColumn("s_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = docs.withColumn("d_salt", (F.col("draw") * SALTS).cast("int"))
        joined = d.join(s, d["source"].eqNullSafe(s["s_source"]) & (d["d_salt"] == s["s_salt"]), "left").drop("s_salt", "d_salt")
    whole = F.floor("rate")
    copies = whole + F.when(F.col("draw") < F.col("rate") - whole, 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).drop("s_source", "rate")


def mix_plan(docs: DataFrame, seed: int = 20, weights=(5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies."""
    d = pick(docs, "doc_id", "source", "text")
    d = cut(d.select("doc_id", "source", n_words(d["text"]).alias("size"), draw(d["doc_id"], d["text"], seed).alias("draw")))
    return with_copies(d, cut(source_targets(d, weights, budget, most)), seed).drop("draw")


def mix(docs: DataFrame, seed: int = 20, weights=(5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed corpus: each row of ``docs``, all columns, as often as its source's rate and its draw say."""
    d = pick(docs, "source", "text")
    sizes = d.select("source", n_words(d["text"]).alias("size"))
    targets = cut(source_targets(sizes, weights, budget, most))
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: flat[f"c{i}"] for i, n in reversed(list(enumerate(names)))}
    doc_id = at.get("doc_id", F.lit(None).cast("long"))
    rows = flat.select("*", at.get("source", F.lit(None).cast("string")).alias("source"), draw(doc_id, at["text"], seed).alias("draw"))
    rows = with_copies(rows, targets, seed).filter("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
