"""Line dedup by a log-template tree.

A line's words descend a tree of fixed depth: first by their count, then by
``DEPTH`` leading words (a word with a digit is a variable field, ``<*>``). At
a leaf the lines themselves say which fields vary: a word is constant at its
place if ``least_docs`` documents have it there (counted once for each
different line), else it is a variable field. A line of which ``CONSTANT``
tenths of the words, the leading ones included, are constant, one beyond those
at least, belongs to the generalised template of its constant words; and every line belongs to its exact
template, all of its words. A template met in ``least_docs`` or more documents
recurs: its lines are dropped everywhere but in its first document, the one of
smallest doc_id. Lines of fewer than ``least_words`` words are left alone; an
exact template of ``LONG_WORDS`` words or more recurs from ``long_docs`` on.

Texts are masked as wholes and hashed line by line; what is counted is a narrow
table of hashes. Only lines of leaves that hold different lines of
``least_docs`` or more documents are taken apart into words. Every count is a
map-side combined aggregate, so a line held by a third of all documents is not
a hot group; texts are shuffled once, by document, to meet the list of lines
they lose (and their lines once more by leaf, if the leaves are too many to
broadcast).

Templates are told apart by 63 bits of a hash; the last bit says whether a line is long.

Defined results: a null text stays null; empty texts and blank lines stay as
they are; documents are told apart by doc_id and text, so repeated rows are
one document and share one fate; all documents of the smallest doc_id are
first, rows without doc_id come after all others;
an empty table gives an empty result; extra columns pass through, those called
n_lines or n_dropped (in any case) giving way to the two that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import WORD, cut, pick

DEPTH = 3
CONSTANT = 7
LEAST_DOCS = 3
LEAST_WORDS = 1
LONG_WORDS = 50
LONG_DOCS = 2
#: Most narrow rows (under 100 bytes) that are broadcast.
BROADCAST_ROWS = 200_000
#: Lost lines of a document beyond which they are searched by halves.
FEW = 64


def masked_lines(text: Column) -> Column:
    """The text's lines with single spaces, none at the ends, and words that hold a digit masked."""
    odd = text.contains("  ")
    for space in "\t\v\f\r":
        odd = odd | text.contains(space)
    plain = F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", "<*>")).otherwise(plain)
    return F.transform(F.split(masked, "\n", -1), lambda line: F.trim(line))


def _exact(line: Column, least_words: int) -> Column:
    """The hash of a masked line, odd for a long one; null for a blank or short one."""
    n = F.when(line != "", F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
    marked = F.xxhash64(line).bitwiseAND(F.lit(-2)).bitwiseOR((n >= LONG_WORDS).cast("long"))
    return F.when(n >= least_words, marked)


def _leaf(line: Column) -> Column:
    """The leaf of a masked line; null for one that the leading words make up."""
    n = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.when(n > DEPTH, F.xxhash64(n, F.substring_index(line, " ", DEPTH)))


def _lines(docs: DataFrame, least_words: int, whole: bool = False) -> DataFrame:
    """id, hash, lines: (exact, leaf) of each document's lines; if ``whole``, id, hash, exact, leaf, line (masked): a row for each line."""
    d = pick(docs, "doc_id", "text")

    def keys(line: Column) -> Column:
        return F.struct(_exact(line, least_words).alias("exact"), _leaf(line).alias("leaf"), *([line.alias("line")] if whole else []))

    lines = F.filter(F.transform(masked_lines(d["text"]), keys), lambda x: x["exact"].isNotNull())
    row = [d["doc_id"].cast("long").alias("id"), F.xxhash64("text").alias("hash")]
    if whole:  # exploded as an expression: of a named column a filter on its size would be pushed down and mask the texts twice
        return d.select(*row, F.explode(lines).alias("x")).select("id", "hash", "x.*")
    return d.select(*row, lines.alias("lines"))


def _place(id_: str = "id") -> Column:
    return F.coalesce(id_, F.lit(2**63 - 1))


def _small(frame: DataFrame) -> DataFrame:
    """A materialised narrow table, to be broadcast if it is small enough."""
    frame = cut(frame)
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def _general(docs: DataFrame, keyed: DataFrame, least_docs: int, least_words: int) -> DataFrame:
    """id, hash, key: the lines that documents lose for their generalised templates."""
    leaves = keyed.select("vote", F.explode("lines").alias("x")).select("vote", "x.exact", "x.leaf").filter("leaf IS NOT NULL")
    leaves = leaves.groupBy("leaf").agg(F.sum("vote").alias("n"), F.min("exact").alias("low"), F.max("exact").alias("high"))
    leaves = _small(leaves.filter((F.col("n") > least_docs - 0.5) & (F.col("low") != F.col("high"))).select(F.col("leaf").alias("c_leaf")))
    found = _lines(docs, least_words, whole=True)
    found = found.join(leaves, found["leaf"] == leaves["c_leaf"], "left_semi")
    found = cut(found.groupBy("id", "hash", "exact", "leaf").agg(F.first("line").alias("line")))
    # Each different line once, and in how many documents it is.
    templates = cut(found.groupBy("leaf", "exact").agg(F.count(F.lit(1)).alias("docs"), F.first("line").alias("line")))
    words = templates.select("leaf", "exact", "docs", F.posexplode(F.split("line", " ")).alias("at", "word")).filter(F.col("at") >= DEPTH)
    words = words.select("leaf", "exact", "docs", "at", F.xxhash64("word").alias("word"))
    constant = words.groupBy("leaf", "at", "word").agg(F.sum("docs").alias("met")).filter(F.col("met") >= least_docs)
    constant = constant.select(F.col("leaf").alias("k_leaf"), F.col("at").alias("k_at"), F.col("word").alias("k_word"))
    held = words.join(constant, (F.col("leaf") == F.col("k_leaf")) & (F.col("at") == F.col("k_at")) & (F.col("word") == F.col("k_word")))
    which = [F.bit_xor(F.xxhash64(F.lit(seed), "at", "word")).alias(f"x{seed}") for seed in (1, 2)]
    held = held.groupBy("leaf", "exact").agg(F.count(F.lit(1)).alias("n"), *which)
    general = held.select(F.col("exact").alias("g_exact"), "n", F.xxhash64("leaf", "n", "x1", "x2").alias("general"))
    size = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    general = templates.join(general, F.col("exact") == F.col("g_exact")).filter(10 * (F.col("n") + DEPTH) >= CONSTANT * size).select("g_exact", "general")
    general = _small(general)
    found = found.drop("leaf", "line")
    of = cut(found.join(general, found["exact"] == general["g_exact"]).groupBy("id", "hash", "general").agg(F.collect_set("exact").alias("keys")))
    met = of.groupBy("general").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first")).filter(F.col("n") >= least_docs)
    met = _small(met.select(F.col("general").alias("m_general"), "first"))
    lost = of.join(met, of["general"] == met["m_general"]).filter(_place() != F.col("first"))
    return lost.select("id", "hash", F.explode("keys").alias("key"))


def lost_keys(docs: DataFrame, least_docs: int = LEAST_DOCS, least_words: int = LEAST_WORDS, long_docs: int = LONG_DOCS) -> DataFrame:
    """id, hash, lost: the exact templates whose lines each document loses, for documents that lose any."""
    keyed = cut(_lines(docs, least_words))  # a filter on the keys would be pushed down and make them twice; explode drops the empty
    # The rows of one document share one vote.
    again = _small(keyed.groupBy("id", "hash").count().filter("count > 1").select(F.col("id").alias("a_id"), F.col("hash").alias("a_hash"), "count"))
    keyed = keyed.join(again, keyed["id"].eqNullSafe(again["a_id"]) & (keyed["hash"] == again["a_hash"]), "left")
    keyed = keyed.select("id", "hash", F.coalesce(1 / F.col("count"), F.lit(1.0)).alias("vote"), "lines")
    rows = keyed.select(_place().alias("place"), "id", "hash", "vote", F.explode(F.array_distinct("lines.exact")).alias("key"))
    needed = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, long_docs).otherwise(least_docs)
    met = rows.groupBy("key").agg(F.sum("vote").alias("n"), F.min("place").alias("first"))
    met = _small(met.filter(F.col("n") > needed - 0.5).select(F.col("key").alias("r_key"), "first"))
    exact = rows.join(met, rows["key"] == met["r_key"]).filter(F.col("place") != F.col("first")).select("id", "hash", "key")
    lost = exact.union(_general(docs, keyed, least_docs, least_words))
    return lost.groupBy("id", "hash").agg(F.sort_array(F.collect_set("key")).alias("lost"))


def _holds(values: Column, x: Column) -> Column:
    """Whether a sorted array holds ``x``."""
    n = F.size(values)
    steps = F.array(*[F.lit(1 << i) for i in range(27, -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda low, step: F.when(low + step > n, low).when(F.try_element_at(values, low + step) <= x, low + step).otherwise(low))
    return F.when(n <= FEW, F.array_contains(values, x)).otherwise(F.coalesce(F.try_element_at(values, F.greatest(at, F.lit(1))) == x, F.lit(False)))


def _cleaned(docs: DataFrame, least_docs: int, least_words: int, long_docs: int) -> DataFrame:
    """``docs`` with columns c0, c1 ... in their order, and done: (text, n_lines, n_dropped)."""
    lost = lost_keys(docs, least_docs, least_words, long_docs)
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (flat[f"c{names.index(n)}"] for n in ("doc_id", "text"))
    flat = flat.withColumns({"k_id": doc_id.cast("long"), "k_hash": F.xxhash64(text)})
    joined = flat.join(lost.hint("shuffle_hash"), flat["k_id"].eqNullSafe(lost["id"]) & (flat["k_hash"] == lost["hash"]), "left")
    # Only the texts that lose lines are taken apart.
    keys = F.transform(masked_lines(text), lambda line: _exact(line, least_words))
    pairs = F.arrays_zip(F.split(text, "\n", -1).alias("line"), keys.alias("key"))
    stays = F.filter(pairs, lambda x: x["key"].isNull() | ~_holds(F.col("lost"), x["key"]))
    rest = F.when(F.col("lost").isNotNull(), F.transform(stays, lambda x: x["line"]))
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")

    def done(kept: Column) -> Column:
        same = kept.isNull()
        dropped = F.when(same, F.lit(0)).otherwise(n_lines - F.size(kept)).cast("long")
        return F.struct(F.when(same, text).otherwise(F.array_join(kept, "\n")).alias("text"), n_lines.alias("n_lines"), dropped.alias("n_dropped"))

    # Exploding one row is a barrier: a filter on the result is not pushed below it and computes nothing again.
    return joined.select("*", F.explode(F.transform(F.array(rest), done)).alias("done"))


def drop_recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_words: int = LEAST_WORDS, long_docs: int = LONG_DOCS) -> DataFrame:
    """``docs`` with their recurring lines dropped from text, and the added columns n_lines and n_dropped."""
    out, names = _cleaned(docs, least_docs, least_words, long_docs), docs.columns
    own = [F.col("done.text" if n == "text" else f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in ("n_lines", "n_dropped")]
    return out.select(*own, "done.n_lines", "done.n_dropped")


def keep_cleaned(docs: DataFrame, least_docs: int = LEAST_DOCS, least_words: int = LEAST_WORDS, long_docs: int = LONG_DOCS) -> DataFrame:
    """``docs``, all columns, without their recurring lines and with n_chars brought up to date; a row that so loses its last word goes."""
    out, names = _cleaned(docs, least_docs, least_words, long_docs), docs.columns
    same = F.col("done.n_dropped") == 0
    out = out.filter(same | F.col("done.text").rlike(WORD))

    def column(i: int, name: str) -> Column:
        if name == "text":
            return F.col("done.text").alias(name)
        if name == "n_chars":
            return F.when(same, F.col(f"c{i}")).otherwise(F.length("done.text").cast(docs.schema.fields[i].dataType)).alias(name)
        return F.col(f"c{i}").alias(name)

    return out.select(*[column(i, n) for i, n in enumerate(names)])
