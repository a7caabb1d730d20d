"""Personal data: typed spans, and terms that reveal them by corpus co-occurrence.

Protected entities are e-mail addresses, IP addresses, card and phone numbers,
found in every whole text by pattern and check. A term (a word of three or more
letters) reveals an entity c if the corpus says so: with N distinct texts, n_c
of them holding c, n_t holding the term and n_tc holding both, however far
apart, the pointwise mutual information log(n_tc N / (n_t n_c)) must
reach ``DISCLOSURE`` times the entity's information content -log(n_c / N), and
n_tc must be at least ``TOGETHER``. All counts are of distinct texts, so equal
surroundings never lower a ratio and repeated rows are no evidence. Such terms are generalised (or removed) wherever they stand.

The corpus is only asked about candidates: n_t is at least the number of texts
that hold the term and any entity, and terms that fail on that bound can be
ruled out from the texts with entities alone. Everything is DataFrame functions; texts
are never shuffled unless the list of texts to change is too long to broadcast.

Offsets are sums of the lengths before them, summed in pieces, and terms are set apart from typed spans by binary search.

Patterns are possessive and anchored at the start of a run, which matches what
the plain ones match but takes time linear in a run of any length.

Defined results: a null text counts as empty and has no spans; repeated rows
are reported each; texts are told apart by a 64-bit hash for counting only; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import cut, pick

TOGETHER = 3
DISCLOSURE = 0.9
#: Most candidate terms or texts to change that are broadcast, and most bytes of the latter's patterns.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
#: Code points of the blocks from which a sanitised text's pieces are taken.
BLOCK = 4_096

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: kind -> pattern, in the order of kinds.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"(?<![\p{L}\p{N}_@.%+-])\p{L}{3,}(?![\p{L}\p{N}_@]|\.[\p{L}\p{N}])"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_@.%+-])", r"(?![\p{L}\p{N}_@]|\.[\p{L}\p{N}])"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, at: Column) -> Column:
        x = F.substr(digits, at, F.lit(1)).cast("int")
        return total + F.when((n - at) % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    def check(span: Column) -> Column:
        m = span["value"]
        digits = F.regexp_replace(m, "[^0-9]", "")
        if kind == "ip":
            return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
        if kind == "card":
            return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
        if kind == "phone":
            return F.length(digits).between(10, 15)
        return F.lit(True)

    return check


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, levels: int = 2) -> Column:
    """The sums of all elements before each element of an array of integers.

    An array that grows one element at a time costs the square of its length,
    so pieces are summed each and then shifted by the sums before them.
    """
    if levels == 1:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(values, none, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums")), lambda acc: acc["sums"])

    def inner(values: Column) -> Column:
        piece = F.greatest(F.lit(1), F.ceil(F.pow(F.size(values), F.lit(1 - 1 / levels)))).cast("int")

        def whole(pieces: Column) -> Column:
            totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + x))
            shifted = F.transform(F.arrays_zip(pieces.alias("p"), running(totals, 1).alias("before")), lambda z: F.transform(running(z["p"], levels - 1), lambda x: x + z["before"]))
            return F.flatten(shifted)

        cut = F.transform(F.sequence(F.lit(0), F.size(values) - 1, piece), lambda at: F.slice(values, at + 1, piece))
        return F.when(F.size(values) > 0, let(cut, whole)).otherwise(F.array().cast("array<int>"))

    return let(values, inner)


def _matches(text: Column, pattern: Column, possible: Column) -> Column:
    """Leftmost non-overlapping matches, each with the text between it and the one before."""

    def gaps(found: Column) -> Column:
        return F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))

    none = F.array().cast("array<struct<m:string,gap:string>>")
    return F.when(possible, let(F.regexp_extract_all(text, pattern, F.lit(0)), gaps)).otherwise(none)


def _placed(matches: Column, rank: Column) -> Column:
    """Spans of the matches of the kind of this rank, by code point offsets."""
    before = running(F.transform(matches, lambda x: F.length(x["gap"]) + F.length(x["m"])))

    def span(x: Column) -> Column:
        start = x["before"] + F.length(x["z"]["gap"])
        kind = F.element_at(F.array(*[F.lit(k) for k in (*PATTERNS, "term")]), rank + 1)
        return F.struct(start.alias("start"), rank.alias("rank"), (start + F.length(x["z"]["m"])).alias("end"), kind.alias("kind"), x["z"]["m"].alias("value"))

    return F.transform(F.arrays_zip(matches.alias("z"), before.alias("before")), span)


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _last_before(spans: Column, end: Column) -> Column:
    """The last of ``spans`` (by start) that starts before ``end``, by binary search; null if there is none."""
    steps = F.array(*[F.lit(1 << i) for i in range(27, -1, -1)])
    n = F.size(spans)
    at = F.aggregate(steps, F.lit(0), lambda low, step: F.when(low + step > n, low).when(F.try_element_at(spans, low + step)["start"] < end, low + step).otherwise(low))
    return let(at, lambda at: F.when(at > 0, F.try_element_at(spans, at)))


def _apart(extra: Column, base: Column) -> Column:
    """The spans of ``extra`` that overlap none of ``base``: those of one kind do not overlap, so the last before a span's end decides."""
    by_kind = F.array(*[_of_kind(base, kind) for kind in PATTERNS])
    return let(by_kind, lambda kinds: F.filter(extra, lambda t: ~F.exists(kinds, lambda spans: F.coalesce(_last_before(spans, t["end"])["end"] > t["start"], F.lit(False)))))


def base_spans(text: Column) -> Column:
    """All typed spans of a text by start, then kind: start, rank, end, kind, value."""
    hints = {"email": F.instr(text, "@") > 0, "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.instr(text, "+") > 0}
    found = F.array(*[_matches(text, F.lit(pattern), hints[kind]) for kind, pattern in PATTERNS.items()])
    placed = F.transform(found, lambda matches, rank: _placed(matches, rank))
    return let(placed, lambda by_kind: F.array_sort(F.concat(*[F.filter(by_kind[i], _valid(kind)) for i, kind in enumerate(PATTERNS)])))


def terms(text: Column) -> Column:
    """Distinct terms of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def _texts(docs: DataFrame) -> DataFrame:
    d = pick(docs, "doc_id", "text")
    return d.select(d["doc_id"].cast("long"), F.coalesce(d["text"].cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))


def revealing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, together: int = TOGETHER) -> tuple[DataFrame, DataFrame] | None:
    """(term, disclosure) of revealing terms and (hash, term) of the texts that hold them; None if there is no candidate."""
    texts = _texts(docs)
    some = texts.select("hash", "text", F.explode(F.array(base_spans(F.col("text")))).alias("spans")).filter(F.size("spans") > 0).dropDuplicates(["hash"])
    entities = F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["kind"], s["value"])))
    around = cut(some.select("hash", entities.alias("entities"), terms(F.col("text")).alias("terms")))
    total = texts.select("hash").distinct().count()

    def sets(column: str, name: str) -> DataFrame:
        """(name, n, same): what is in ``together`` texts or more, in how many, and a hash of which."""
        which = [F.bit_xor(F.xxhash64(F.lit(seed), "hash")) for seed in (1, 2)]
        found = around.select("hash", F.explode(column).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"x{i}") for i, x in enumerate(which)])
        return cut(found.filter(F.col("n") >= together).select(F.col(name).alias("k"), "n", F.xxhash64("n", "x0", "x1").alias("same")))

    def held_by(column: str, found: DataFrame, name: str) -> DataFrame:
        """(hash, name, n) of each text's classes of what stands in the same texts."""
        rows = around.select("hash", F.explode(column).alias("x"))
        return rows.join(found, rows["x"] == found["k"]).select("hash", F.col("same").alias(name), F.col("n").alias(f"n_{name}")).distinct()

    # What stands in the same texts has the same counts, so pairs are made of classes of it only: the
    # addresses of a long list that is copied about are one class.
    entity_sets, term_sets = sets("entities", "entity"), sets("terms", "term")
    left, right = held_by("entities", entity_sets, "e"), held_by("terms", term_sets, "t").withColumnRenamed("hash", "h")
    # p(c|t) >= p(c) ** (1 - disclosure) is the same as the bound on mutual information
    least = F.pow(F.col("n_e") / F.lit(float(max(1, total))), F.lit(1 - disclosure))
    # n_tc is at most n_c, and n_t at least the texts with the term and any entity.
    pairs = left.join(right, left["hash"] == right["h"]).filter(F.col("n_t") * least <= F.col("n_e"))
    met = pairs.groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_tc"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    met = met.filter((F.col("n_tc") >= together) & (F.col("n_tc") / F.col("n_t") >= least)).select("t", "n_tc", least.alias("least")).distinct()
    possible = cut(met.join(term_sets, met["t"] == term_sets["same"]).select(F.col("k").alias("term"), "n_tc", "least"))
    candidates = possible.select(F.col("term").alias("c")).distinct()
    few = candidates.count()
    if not few:
        return None
    held = texts.select("hash", F.explode(terms(F.col("text"))).alias("term"))
    held = held.join(F.broadcast(candidates) if few <= BROADCAST_ROWS else candidates, F.col("term") == F.col("c"), "left_semi").distinct()
    held = cut(held)
    counts = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).select(F.col("term").alias("t"), "n_t")
    revealing = possible.join(counts, possible["term"] == counts["t"]).filter(F.col("n_tc") / F.col("n_t") >= F.col("least"))
    revealing = cut(revealing.groupBy("term").agg(F.max(F.col("n_tc") / F.col("n_t")).alias("disclosure")))
    return revealing, held.join(revealing.select(F.col("term").alias("r")), F.col("term") == F.col("r"), "left_semi")


def with_spans(docs: DataFrame, disclosure: float = DISCLOSURE, together: int = TOGETHER) -> DataFrame:
    """doc_id, text, base (typed spans), spans (those and the revealing terms) of every row of ``docs``."""
    texts = _texts(docs)
    found = revealing_terms(docs, disclosure, together)
    rows = texts.select("doc_id", "text", "hash", base_spans(F.col("text")).alias("base"))
    if found is None:
        return rows.select("doc_id", "text", "base", F.col("base").alias("spans"))
    per_text = found[1].groupBy("hash").agg(F.collect_set("term").alias("terms"))  # a text's own terms
    pattern = F.concat(F.lit(f"(?iu){_BEFORE}(?:"), F.array_join(F.array_sort("terms"), "|"), F.lit(f"){_AFTER}"))
    per_text = cut(per_text.select(F.col("hash").alias("h"), pattern.alias("pattern")))
    size = per_text.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()
    few = size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(per_text) if few else per_text, rows["hash"] == per_text["h"], "left")
    extra = _placed(_matches(F.col("text"), F.col("pattern"), F.col("pattern").isNotNull()), F.lit(len(PATTERNS)))
    spans = let(extra, lambda extra: F.when(F.size(extra) > 0, F.array_sort(F.concat("base", _apart(extra, F.col("base"))))).otherwise(F.col("base")))
    return rows.select("doc_id", "text", "base", spans.alias("spans"))


def _outermost(spans: Column) -> Column:
    """(s, before): sorted spans without those that begin inside one before them, and the largest end before each."""
    steps = lambda s, ends: F.filter(F.arrays_zip(s.alias("s"), ends.alias("before")), lambda z: z["s"]["start"] >= z["before"])

    def before(spans: Column) -> Column:
        # The largest end before each span: spans of one kind end in order, so the last of each kind before it decides.
        by_kind = F.array(*[_of_kind(spans, kind) for kind in (*PATTERNS, "term")])

        def ends(kinds: Column) -> Column:
            def largest(s: Column) -> Column:
                key = F.struct(s["start"].alias("start"), s["rank"].alias("rank"))
                of = lambda ks: F.coalesce(_last_below(ks, key)["end"], F.lit(0))
                return F.array_max(F.transform(kinds, of))

            return F.transform(spans, largest)

        return let(by_kind, ends)

    return let(spans, lambda spans: steps(spans, before(spans)))


def _last_below(spans: Column, key: Column) -> Column:
    """The last of ``spans`` whose (start, rank) is below ``key``."""
    steps = F.array(*[F.lit(1 << i) for i in range(27, -1, -1)])
    n = F.size(spans)

    def below(at: Column) -> Column:
        s = F.try_element_at(spans, at)
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank")) < key

    at = F.aggregate(steps, F.lit(0), lambda low, step: F.when(low + step > n, low).when(below(low + step), low + step).otherwise(low))
    return let(at, lambda at: F.when(at > 0, F.try_element_at(spans, at)))


def sanitise(docs: DataFrame, remove: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, text with each span generalised to its kind (``<EMAIL>``), or removed if its kind is in ``remove``; null texts become empty.

    A span that begins inside another is part of it: both are replaced as one, by the first one's kind.
    """
    rows = with_spans(docs, **options)

    def put(s: Column) -> Column:
        gone = F.lit(False) if not remove else s["kind"].isin(*remove)
        return F.when(gone, F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))

    def rest(blocks: Column, start: Column, end: Column) -> Column:
        """Code points start to end of the text, whose blocks are given."""
        first = F.floor(start / BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.floor(F.greatest(end - 1, F.lit(0)) / BLOCK).cast("int") - first + 1), "")
        return F.when(end > start, F.substr(near, start % BLOCK + 1, end - start)).otherwise(F.lit(""))

    def whole(x: Column) -> Column:
        # A span's "before" is where the one kept before it ends, with all that begins inside it.
        pieces = F.transform(x["kept"], lambda z: F.concat(rest(x["blocks"], z["before"], z["s"]["start"]), put(z["s"])))
        return F.concat(F.array_join(pieces, ""), rest(x["blocks"], x["last"], x["length"]))

    blocks = F.regexp_extract_all(F.col("text"), F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    parts = F.struct(_outermost(F.col("spans")).alias("kept"), last.alias("last"), blocks.alias("blocks"), F.length("text").alias("length"))
    return rows.select("doc_id", F.when(F.size("spans") > 0, let(parts, whole)).otherwise(F.col("text")).alias("text"))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
