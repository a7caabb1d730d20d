"""Operators against brute force, invariants and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeweave.llm import language_id, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, queries, sharding, simhash_dedup, topk_search
from tests.llm.conftest import SF

WORDS = r"[^\x20\x09-\x0D]+"


def held_out(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


# 1


def test_languages_of_held_out_documents(spark):
    rows = queries.op1_language_mixture(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.held_out == held_out(r.doc_id, 5, 0) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_finds_both_languages(spark, sample):
    model = language_id.learn(sample, F.lit(True))
    by = {lang: next(r.text for r in sample.filter(F.col("lang") == lang).filter("n_chars > 2000").limit(1).collect())[:1500] for lang in ("en", "de")}
    docs = spark.createDataFrame([(1, by["en"] + "\n" + by["de"]), (2, by["en"]), (3, "1234 !!"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert set(got[1].languages) == {"en", "de"} and 0.3 < got[1].languages["en"] < 0.7
    assert set(got[2].languages) == {"en"}
    assert (got[3].lang_pred, got[3].score, got[4].lang_pred) == ("und", 0.0, "und")


def test_em_reaches_the_best_mixture():
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(50) * 0.3, 2).T + 1e-9)
    counts = rng.multinomial(4000, 0.7 * np.exp(logs[:, 0]) + 0.3 * np.exp(logs[:, 1]))
    at = np.flatnonzero(counts)
    pi, _ = language_id.infer([(at, counts[at])], logs)
    grid = np.linspace(0.01, 0.99, 99)
    best = max(grid, key=lambda a: (counts[at] * np.log(a * np.exp(logs[at, 0]) + (1 - a) * np.exp(logs[at, 1]))).sum())
    assert abs(pi[0, 0] - best) < 0.02


# 2


def test_shards(spark, sample):
    rows = queries.op2_sampled_splitters(spark, SF).collect()
    texts = {r.doc_id: r.text for r in sample.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    loads = Counter()
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r["size"]
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    mean = sum(loads.values()) / 8
    assert max(loads.values()) < mean + max(r["size"] for r in rows) and min(loads.values()) > mean - max(r["size"] for r in rows)
    shard_of = {}
    for r in rows:
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard


@pytest.mark.parametrize("hot", [0.05, 0.4])
def test_a_hot_text_is_split_only_beyond_a_shard(make_docs, hot):
    n = 4000
    docs = make_docs(*[(i, "the very same words" if i < hot * n else f"text {i} {i * 7919 % 1013}") for i in range(n)])
    rows = sharding.shard_by_bytes(docs).collect()
    loads = Counter()
    for r in rows:
        loads[r.shard] += r["size"]
    assert max(loads.values()) / (sum(loads.values()) / 8) < 1.02
    used = {r.shard for r in rows if r.doc_id < hot * n}
    assert len(used) == (1 if hot < 0.1 else 4)


# 3


def base_by_force(text):
    words = re.findall(WORDS, text)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {p for v in where.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(WORDS, line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated)


def test_quality_rules(spark, sample):
    rows = queries.op3_likelihood_ratio_rules(spark, SF).collect()
    texts = {r.doc_id: r.text for r in sample.collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows:
        assert base_by_force(texts[r.doc_id]) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    judged = [r for r in rows if not r.base_failed and r.doc_id in good]
    assert np.mean([r.kept for r in judged if good[r.doc_id] == 1]) > 0.98
    assert np.mean([r.kept for r in judged if good[r.doc_id] == 0]) < 0.3


def test_ratio_by_force(spark, make_docs):
    docs = make_docs((1, "good words all over"), (2, "bad &&& noise &&&"), (3, "good words again"), (4, "more &&& &&&"))
    labels = spark.createDataFrame([(1, 1), (3, 1), (2, 0)], "doc_id long, quality int")
    ratio = quality_rules.learn(docs, labels)
    raw, target = Counter(), Counter()
    for r in docs.collect():
        raw.update(quality_rules.ngrams(r.text.encode()).tolist())
        if r.doc_id in (1, 3):
            target.update(quality_rules.ngrams(r.text.encode()).tolist())
    for b in raw:
        p, q = target[b] / target.total(), raw[b] / raw.total()
        assert ratio[b] == pytest.approx(np.log((p / q + 0.5) / 1.5), abs=1e-5)
    got = {r.doc_id: r.llr for r in quality_rules.judge(docs, ratio).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(np.mean([ratio[g] for g in quality_rules.ngrams(r.text.encode())]), abs=1e-5)


# 4

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - (9 if int(c) > 4 else 0) for i, c in enumerate(reversed(digits))) % 10 == 0


def spans_by_force(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15

    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if ok(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans(spark, make_docs):
    rng = random.Random(3)
    pieces = ["a@b.co", "x_y.z@d-e.f.g", "@", ".", "..", "1.2.3.4", "300.1.1.1", "01.02.003.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (202) 555-0100", "+44.20.7946.0958", "é😀", " ", "\n", "9", "00", "-", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+", "%", "5500 0000 0000 0004 9", "w@x..y"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    rows = pii.with_spans(make_docs(*enumerate(texts))).select("doc_id", pii.digest(F.col("base")).alias("b")).collect()
    for r in rows:
        assert r.b == spans_by_force(texts[r.doc_id])


def test_digest_columns(spark, sample):
    texts = {r.doc_id: r.text for r in sample.collect()}
    for r in queries.op4_co_occurrence_pii(spark, SF).collect():
        spans = spans_by_force(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [spans.count(f"{k}:") for k in PATTERNS]
        assert not spans or set(spans.split(",")) <= set(r.spans.split(","))


def test_terms_that_reveal_are_found(make_docs):
    rng = random.Random(1)
    filler = ["river", "stone", "cloud", "garden", "window", "paper", "music", "light", "forest", "street"]
    talk = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, talk(30)) for i in range(300)]
    rows += [(1000 + i, f"{talk(12)} Zanthor {talk(2)} ask zan@corp.org {talk(12)}") for i in range(6)]
    rows += [(2000, f"{talk(10)} zanthor was here {talk(5)}")]
    found = pii.with_spans(make_docs(*rows))
    got = {r.doc_id: r.s for r in found.select("doc_id", pii.digest(F.col("spans")).alias("s")).collect()}
    texts = dict(rows)
    for i in [*range(1000, 1006), 2000]:
        at = texts[i].lower().index("zanthor")
        assert f"term:{at}:{at + 7}" in got[i]
    assert all(not got[i] for i in range(300))
    clean = {r.doc_id: r.text for r in pii.sanitise(make_docs(*rows), remove=("term",)).collect()}
    assert "zanthor" not in clean[2000].lower() and "<EMAIL>" in clean[1000] and clean[5] == texts[5]


# 5


def test_topk_by_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.2, (700, 16)).astype(np.float32)
    vectors[300:340] = vectors[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk_search, "SUB", 3)
    rows = topk_search.top_k(df, 5, F.col("vec_id") % 50 == 0, rows=128, queries=8).collect()
    ints = np.floor(256 * vectors.astype(float)).astype(int)
    expected = set()
    for q in range(0, 700, 50):
        order = sorted((-(ints[q] @ ints[j]), j) for j in range(700) if j != q)[:5]
        expected |= {(q, k, j, -s) for k, (s, j) in enumerate(order, 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in rows} == expected


# 6


def test_mixing(spark, sample):
    plan = queries.op6_source_mixing(spark, SF).collect()
    sources = {r.doc_id: r.source for r in sample.collect()}
    size, target = Counter(), {}
    for r in plan:
        size[sources[r.doc_id]] += r["size"]
        target[sources[r.doc_id]] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    free, want = set(size), {}
    left = 1.5 * sum(size.values())
    while True:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > 2 * size[s]}
        if not over:
            want |= {s: left * weights[s] / total for s in free}
            break
        want |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    for s in size:
        assert target[s] == pytest.approx(want[s]) and target[s] <= 2 * size[s] + 1e-6
        assert all(r.source_size == size[s] for r in plan if sources[r.doc_id] == s)


def test_mix_emits_what_the_plan_says(sample):
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(sample).collect()}
    emitted = Counter(r.doc_id for r in mixing.mix(sample).select("doc_id").collect())
    assert all(emitted[d] == c for d, c in copies.items())


def test_taken_words_near_targets(make_docs):
    docs = make_docs(*[(i, "w " * (1 + i % 7), "en", ("a", "b", "c")[i % 3]) for i in range(6000)])
    plan = mixing.mix_plan(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t / r.target - 1) < 0.05 for r in plan)


# 7


def test_lines(make_docs):
    license = "All of this work is licensed under the public terms"
    docs = make_docs(
        (1, f"first unique line of text\n{license}"), (2, f"{license}\nsecond unique line of text\nshort"), (3, f"third one stands alone here\n  {license} \nshort"),
        (4, "visit number 17 of the main page was logged at noon today"), (5, "visit number 4 of the main page was logged at noon today"), (6, "visit number 99 of the main page was logged at noon today"),
        (7, "user anna opened the door of room seven in the house"), (8, "user anna opened the door of room nine in the house"), (9, "user anna opened the door of room three in the house"),
        (10, "short"), (11, "a line of two documents only"), (12, "a line of two documents only"),
    )
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert got[1][2].endswith(license) and got[2] == (3, 1, "second unique line of text\nshort") and got[3] == (3, 2, "third one stands alone here")
    assert got[4][1] == 0 and got[5] == (1, 1, "") and got[6] == (1, 1, "")
    assert got[7][1] == 0 and got[8][1] == 1 and got[9][1] == 1
    assert got[10] == (1, 1, "") and got[11][1] == 0 and got[12][1] == 0


def test_any_fields_generalise(make_docs):
    names, cities = ["alice", "bob", "carol", "dave"], ["Paris", "Rome", "Oslo", "Bern"]
    rows = [(i, f"the user called {names[i]} logged in from {cities[i]} at noon") for i in range(4)]
    rows += [(10 + i, f"a visit was {w}") for i, w in enumerate(("short", "long", "good"))]
    rows += [(20 + i, f"{names[i]} went home to {cities[i]} by bus today") for i in range(4)]
    rows += [(30 + i, f"these lines share only {names[i]} {cities[i]} {cities[3 - i]}") for i in range(4)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.drop_recurring_lines(make_docs(*rows)).collect()}
    assert [got[i] for i in range(4)] == [0, 1, 1, 1] and [got[i] for i in (10, 11, 12)] == [0, 0, 0]
    assert not any(got[i] for i in (*range(20, 24), *range(30, 34)))  # leading words differ; too few are constant; 10 to 12: none beyond the leading words is


def test_many_lost_lines(make_docs):
    rng = random.Random(3)
    shared = [f"line {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}" for i in range(600)]
    rows = [(i, "\n".join(sorted(shared, key=lambda _: rng.random()))) for i in range(3)]
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.drop_recurring_lines(make_docs(*rows, (4, "one of its own\n" + shared[5]))).collect()}
    assert got[0][0] == 0 and got[1] == (600, "") and got[2] == (600, "") and got[4] == (1, "one of its own")


# 8


@pytest.mark.parametrize("hot", [False, True])
def test_packing_by_force(hot):
    rng = random.Random(5)
    rows = [(rng.choice([0, 3, 17, 40, 64, 100, 150]) if rng.random() < 0.3 else rng.randint(1, 99), "h" if hot and rng.random() < 0.4 else f"s{rng.randint(0, 12)}", rng.randint(0, 60)) for _ in range(500)]
    got = packing.pack_shard(rows, 100)
    # The tightest compatible bin by a plain scan.
    bins, expected = [], {}
    order = sorted(((w, i, k) for i, (s, _, _) in enumerate(rows) for k, w in enumerate([100] * (s // 100) + ([s % 100] if s % 100 else []))), key=lambda p: (-p[0], p[1], p[2]))
    repeated = Counter(c for s, _, c in rows if s)
    for w, i, k in order:
        _, source, cluster = rows[i]
        fit = [b for b in bins if b[0] >= w and source not in b[1] and (repeated[cluster] < 2 or cluster not in b[2])]
        b = min(fit, key=lambda b: (b[0], b[3]), default=None)
        if b is None:
            b = [100, set(), set(), len(bins)]
            bins.append(b)
        expected[i, k] = (w, b[3], 100 - b[0])
        b[0] -= w
        b[1].add(source)
        b[2].add(cluster)
    assert {(i, k): (w, b, s) for i, k, w, b, s in got if b is not None} == expected
    assert {i for i, _, _, b, _ in got if b is None} == {i for i, r in enumerate(rows) if not r[0]}


def test_packed_bins(spark, sample):
    rows = queries.op8_conflict_best_fit(spark, SF).collect()
    words = {r.doc_id: len(re.findall(WORDS, r.text)) for r in sample.collect()}
    total, bins = Counter(), {}
    for r in rows:
        total[r.doc_id] += r.words
        bins.setdefault(r.bin, []).append(r)
    assert total == Counter(words)
    for b in bins.values():
        assert sum(r.words for r in b) <= packing.CAPACITY
        assert len({r.source for r in b}) == len(b) == len({r.cluster for r in b})
        at = 0
        for r in sorted(b, key=lambda r: r.start):
            assert r.start == at
            at += r.words


# 9


def fingerprint_by_force(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORDS, lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_force(fps, differ=4):
    label = list(range(len(fps)))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= differ) for f in fps]
    while changed:
        new = [min(label[j] for j in n) for n in near]
        changed = new != label
        label = new
    return label


def test_simhash(spark, sample):
    rows = queries.op9_vantage_point_simhash(spark, SF).orderBy("doc_id").collect()
    texts = {r.doc_id: r.text for r in sample.collect()}
    assert all(int(r.fingerprint, 16) == fingerprint_by_force(texts[r.doc_id]) for r in rows)
    fps = np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    assert [r.component_id for r in rows] == [rows[i].doc_id for i in classes_by_force(fps)]


def test_trees_lose_no_link(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    fps = [int(f) for f in base]
    for f in base[:120]:  # chains of near copies, and one dense ball
        for _ in range(int(rng.integers(1, 4))):
            fps.append(fps[-1] ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False)) if rng.random() < 0.5 else int(f) ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    fps += [int(base[0]) ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(300)]
    fps = np.array(sorted(set(fps)), np.uint64)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    edges = simhash_dedup.links(df, 4, sample=200, leaf=40)
    roots = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    got = [roots.get(int(f), int(f)) for f in fps.view(np.int64)]
    expected = classes_by_force(fps)
    group = {}
    assert all(group.setdefault(e, g) == g for e, g in zip(expected, got, strict=True)) and len(set(got)) == len(set(expected))


def test_keep_one(make_docs):
    text = " ".join(f"word{i}" for i in range(400))
    near = text.replace("word7 ", "other ")
    docs = make_docs((5, text), (2, near), (9, text), (9, text), (3, "something else entirely of its own"), (None, text), (4, None), (6, ""))
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(docs).collect()) == [2, 3, 4]


# 10


def test_classifier_on_held_out_labels(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in queries.op10_positive_unlabelled(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert all(r.held_out == held_out(d, 3, 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in rows.items())
    good = [rows[d].score for d, q in labels if q == 1 and rows[d].held_out]
    bad = [rows[d].score for d, q in labels if q == 0 and rows[d].held_out]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.5 for g in good]) > 0.9 and np.mean([b < 0.5 for b in bad]) > 0.9


def test_held_out_labels_are_not_read(spark, sample):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(language_id.held_out(3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality_classifier.classify(sample, labels).collect()}
    b = {r.doc_id: r.score for r in quality_classifier.classify(sample, turned).collect()}
    assert all(a[d] == pytest.approx(b[d], abs=1e-9) for d in a)


def test_prior_from_positives_alone(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels.filter("quality = 1")).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = ([rows[d] for d, q in truth.items() if q == k and held_out(d, 3, 1)] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


# Whole jobs


def test_shared_surroundings_do_not_hide_a_term(make_docs):
    rng = random.Random(2)
    filler = ["river", "stone", "cloud", "garden", "window", "paper", "music", "light", "forest", "street"]
    talk = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    block = "-- this whole block ends each and every one of these many articles as it always did, Zanthor zan@corp.org"
    rows = [(i, talk(30)) for i in range(300)] + [(1000 + i, f"{talk(30)} {block}") for i in range(40)]
    texts = dict(rows)
    got = {r.doc_id: r.s for r in pii.with_spans(make_docs(*rows)).select("doc_id", pii.digest(F.col("spans")).alias("s")).collect()}
    for i in range(1000, 1040):
        at = texts[i].index("Zanthor")
        assert f"term:{at}:{at + 7}" in got[i]
    assert all(not got[i] for i in range(300))


def test_packing_knows_near_copies(spark, tmp_path, make_docs):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(1, text, "en", "a"), (2, text.replace("word7 ", "other "), "en", "b"), (3, text.replace("word90 ", "else "), "en", "c"), (4, "of its own", "en", "d"), (5, None, "en", "e")]
    make_docs(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op8_conflict_best_fit(spark, str(tmp_path)).collect()}
    assert len({got[i].cluster for i in (1, 2, 3)}) == 1 and len({got[i].bin for i in (1, 2, 3)}) == 3
    assert got[4].cluster != got[1].cluster and got[5].bin is None


def test_terms_anywhere_in_a_text_are_found(make_docs):
    rng = random.Random(6)
    filler = ["river", "stone", "cloud", "garden", "window", "paper", "music", "light", "forest", "street"]
    talk = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, talk(30)) for i in range(300)]
    rows += [(1000 + i, f"{talk(12)} Please write to zan@corp.org or ask Zanthor") for i in range(6)]
    rows += [(2000 + i, f"Quillon {talk(60)} call 10.20.30.4 {talk(5)}") for i in range(6)]
    texts = dict(rows)
    got = {r.doc_id: r.s for r in pii.with_spans(make_docs(*rows)).select("doc_id", pii.digest(F.col("spans")).alias("s")).collect()}
    for first, name in ((1000, "Zanthor"), (2000, "Quillon")):
        for i in range(first, first + 6):
            at = texts[i].index(name)
            assert f"term:{at}:{at + 7}" in got[i]
    assert all(not got[i] for i in range(300))


def test_four_hundred_languages(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for lang in range(400):
        words = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)]
        rows += [(lang * 6 + i, " ".join(rng.choice(words) for _ in range(30)), f"l{lang:03d}") for i in range(6)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    known = {r[2] for r in rows if not held_out(r[0], 5, 0)}
    assert len(known) > 256 and all(got[i] == lang for i, _, lang in rows if lang in known)


def test_languages_by_force(spark, sample):
    """Every document's language set and proportions by an EM over all languages and all sets in order of proportion."""
    model = language_id.learn(sample, ~language_id.held_out(5, 0))
    logs = np.concatenate([model[i] for i in range(len(model))], axis=1).astype(float)
    got = {r.doc_id: r for r in language_id.identify(sample, model).collect()}
    for r in sample.filter("doc_id % 3 = 0").collect():
        at, c = np.unique(language_id.trigrams(r.text), return_counts=True)
        p = np.exp(logs[at])

        def best(allowed, p=p, c=c):
            share = np.zeros(p.shape[1])
            share[list(allowed)] = 1 / len(allowed)
            for _ in range(200):
                share = share * (p * (c / (p @ share))[:, None]).sum(0) / c.sum()
            return (c * np.log(p @ share)).sum(), share

        sets = [s for k in range(1, 5) for s in __import__("itertools").combinations(range(p.shape[1]), k)]
        value = {s: best(s)[0] - 0.5 * (len(s) - 1) * np.log(max(2, c.sum())) for s in sets}
        chosen = max(value, key=value.get)
        found = tuple(sorted(model.names.index(x) for x in got[r.doc_id].languages))
        # Greedy growth may end at another set only if that is as good but for EM's tolerance.
        assert found == chosen or value[chosen] - value[found] < 1.0
        if found == chosen:
            share = best(chosen)[1]
            assert all(abs(got[r.doc_id].languages[model.names[k]] - share[k]) < 0.05 for k in chosen)


def test_identical_rows_are_spread(make_docs, spark):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"))
    loads = Counter(r.shard for r in sharding.shard_by_bytes(docs).collect())
    assert len(loads) == 8 and max(loads.values()) < 1.02 * 20_000 / 8
    rows = packing.pack(docs.withColumn("source", F.lit("s"))).collect()
    shards = Counter(r.bin.split("-")[0] for r in rows)
    assert len(rows) == 20_000 and len(shards) > 1 and len({r.bin for r in rows}) == 20_000


def test_spans_in_their_thousands(make_docs):
    rng = random.Random(12)
    pieces = ["user{}@corp.example.org", "10.{}.3.4", "4111 1111 1111 1111", "+44 20 7946 {}", "word{}", "plain words"]
    text = " ".join(rng.choice(pieces).format(rng.randint(0, 255)) for _ in range(30_000))
    rows = pii.with_spans(make_docs((1, text))).select(pii.digest(F.col("base")).alias("b")).collect()
    assert rows[0].b == spans_by_force(text)


def terms_by_force(texts):
    """(doc_id, start, end) of the revealing terms outside typed spans, by counting over all distinct texts."""
    spans = {t: [(int(a), int(b), k) for k, a, b in (x.split(":") for x in spans_by_force(t).split(","))] if spans_by_force(t) else [] for t in set(texts.values())}
    word = re.compile(r"(?<![A-Za-z0-9_@.%+-])[A-Za-z]{3,}(?![A-Za-z0-9_@]|\.[A-Za-z0-9])")
    words = {t: {w.lower() for w in word.findall(t)} for t in spans}
    held = {}
    for t, found in spans.items():
        for a, b, k in found:
            held.setdefault((k, t[a:b]), set()).add(t)
    terms = set()
    for with_entity in held.values():
        for w in set.union(*(words[t] for t in with_entity)):
            with_term = {t for t in words if w in words[t]}
            both = len(with_term & with_entity)
            if both >= 3 and both / len(with_term) >= (len(with_entity) / len(spans)) ** (1 - 0.9):
                terms.add(w)
    return {(i, m.start(), m.end()) for i, t in texts.items() for m in word.finditer(t) if m[0].lower() in terms and not any(a < m.end() and m.start() < b for a, b, _ in spans[t])}


def test_terms_by_force(make_docs):
    rng = random.Random(13)
    filler = ["river", "stone", "cloud", "garden", "window", "paper", "music", "light", "forest", "street"]
    people = [(f"Name{'abcdefgh'[i]}{'abcdefgh'[i]}", f"n{i}@corp.org") for i in range(8)]
    rows = []
    for i in range(500):
        words = [rng.choice(filler) for _ in range(20)]
        for name, mail in rng.sample(people, rng.choice([0, 0, 1, 2])):
            words.insert(rng.randrange(len(words)), mail if rng.random() < 0.93 else "10.1.2.3")
            words.insert(rng.randrange(len(words)), name if rng.random() < 0.95 else rng.choice(people)[0])
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[3][1]) for i in range(40)]
    got = {(r.doc_id, s.start, s.end) for r in pii.with_spans(make_docs(*rows)).collect() for s in r.spans if s.kind == "term"}
    assert got == terms_by_force(dict(rows)) and got


def test_sanitised_by_force(make_docs):
    rng = random.Random(14)
    pieces = ["a@b.co", "1.2.3.4", "+1 (202) 555-0100", "4111 1111 1111 1111", "é😀 text", "\n", "+4111.1111.1111.1111"]
    texts = {i: " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for i in range(150)}
    texts[1000] = "x" * 9000 + " a@b.co " + "é😀" * 5000 + " 1.2.3.4 tail"
    for r in pii.sanitise(make_docs(*texts.items())).collect():
        out, at = [], 0
        text = texts[r.doc_id]
        for k, a, b in sorted((x.split(":") for x in spans_by_force(text).split(",") if x), key=lambda x: (int(x[1]), list(PATTERNS).index(x[0]))):
            if int(a) >= at:
                out += [text[at : int(a)], f"<{k.upper()}>"]
            at = max(at, int(b))
        assert r.text == "".join(out) + text[at:]


def test_an_overfull_leaf_loses_no_link(monkeypatch):
    rng = np.random.default_rng(18)
    fps = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    near = [fps[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 4, replace=False))) for i in range(0, 600, 3)]
    fps = np.unique(np.concatenate((fps, near)))
    expected = classes_by_force(fps)
    for overfull in (8_192, 50):
        monkeypatch.setattr(simhash_dedup, "OVERFULL", overfull)
        a, b = simhash_dedup.leaf_links(fps, 4)
        label = np.arange(len(fps))
        label[a] = b
        group = {}
        assert all(group.setdefault(e, g) == g for e, g in zip(expected, label, strict=True)) and len(set(label)) == len(set(expected))


def test_parts_of_a_frequent_shingle_meet(spark, make_docs):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:at], f"own{i}", *words[at + 1 :]])) for i, at in enumerate(rng.choices(range(120), k=120))]
    rows += [(1000 + i, " ".join(rng.choices(words, k=60))) for i in range(40)]
    docs = make_docs(*rows)
    for tokens, hot in ((2_000_000, 1_000_000), (200, 10)):
        prints = simhash_dedup.shingle_sets.set_prints(docs).cache()
        edges = simhash_dedup.shingle_sets.similar_links(prints, docs, simhash_dedup.components, task_tokens=tokens, hot_rows=hot)
        roots = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
        of = {r.doc_id: roots.get(r.fp, r.fp) for r in prints.collect()}
        assert len({of[i] for i in range(120)}) == 1 and len(set(of.values())) == 41


def test_contracted_names_are_of_one_component(spark):
    edges = [(i, i + 1) for i in range(12)] + [(100 + i, 100) for i in range(1, 60)] + [(500, 500)]
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in simhash_dedup.shingle_sets._contracted(frame).collect()}
    assert set(got) == set(range(13)) | set(range(100, 160))
    assert {r for n, r in got.items() if n >= 100} == {100} and all(r < 13 for n, r in got.items() if n < 13)
    assert got[6] == 0 and len({r for n, r in got.items() if n < 13}) < 13
    assert simhash_dedup.shingle_sets._contracted(frame.filter("u < 0")).count() == 0


def test_shingle_sets_by_force():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [None, "", " ", "a", "a b c d", "x" * 20_000 + " y " + "q" * 70 + " z z z z z z z", "A b C d E F", "a b c d e f", "a  b\tc d e\nf"]
    texts += [" ".join(rng.choice(["ab", "Abcdefgh", "abcdefghi", "é" * 30, "w" * 64, "w" * 65, "w" * 16, "w" * 17]) for _ in range(rng.randint(0, 20))) for _ in range(600)]

    def force(t):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    names = {}
    for t, got in zip(texts, simhash_dedup.shingle_sets.shingle_sets(pa.array(texts)), strict=True):
        assert len(got) == len(force(t)) and names.setdefault(force(t), got.tobytes()) == got.tobytes()
    assert len(set(names.values())) == len(names)


def test_a_parity_sketch_differs_in_no_more_bits_than_the_sets():
    rng = np.random.default_rng(3)
    sets = simhash_dedup.shingle_sets
    for size in (0, 1, 40, 700, 5_000):
        base = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
        for changed in (0, 1, size // 3, size):
            other = np.unique(np.concatenate((base[changed:], rng.integers(0, 1 << 64, changed, np.uint64))))
            bits = sum(int(x).bit_count() for x in (sets.parity(base) ^ sets.parity(other)).view(np.uint64))
            apart = len(np.setxor1d(base, other))
            assert bits <= apart and bits % 2 == apart % 2 and len(sets.parity(base)) == sets.PARITY


def test_wide_sketches_of_any_two_widths_differ_in_no_more_bits_than_the_sets():
    rng = np.random.default_rng(4)
    sets = simhash_dedup.shingle_sets
    base = np.unique(rng.integers(0, 1 << 64, 6_000, np.uint64))
    for a, b in ((0, 0), (0, 1), (1, 500), (500, 513), (513, 600), (2_000, 2_400), (5_000, 6_000)):
        for other in (base[:b], base[b // 3 : b], rng.integers(0, 1 << 64, b, np.uint64)):
            bits = sets._differing(sets.wide_parity(base[:a]).tobytes(), sets.wide_parity(other).tobytes())
            apart = len(np.setxor1d(base[:a], other))
            assert bits <= apart and bits % 2 == apart % 2 and bits * 4 >= min(apart, 512)


def join_rows(spark, word):
    """Rows made by the joins whose plan nodes speak of ``word``, of all that the session keeps."""
    store = spark._jsparkSession.sharedState().statusStore()
    seq = lambda s: (s.apply(i) for i in range(s.size()))
    total = 0
    for run in seq(store.executionsList()):
        values = store.executionMetrics(run.executionId())
        for node in seq(store.planGraph(run.executionId()).allNodes()):
            if "Join" in node.name() and word in node.desc():
                ids = [m.accumulatorId() for m in seq(node.metrics()) if m.name() == "number of output rows"]
                total += sum(int(values.apply(i).replace(",", "")) for i in ids if values.contains(i))
    return total


def test_long_sets_that_share_much_make_few_rows(spark, make_docs):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(1_600)]
    texts = []
    for _ in range(40):  # similarities around 0.8, and hundreds of shared first shingles, each met in other sets
        texts.append([w if rng.random() > 0.0135 else f"x{rng.randrange(10**6)}" for w in words])
    docs = make_docs(*[(i, " ".join(t)) for i, t in enumerate(texts)])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    least = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    before = join_rows(spark, "o_token")
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates_by_jaccard(docs).collect()}
    assert [got[i] for i in range(len(sets))] == least and 1 < len(set(least)) < 40
    assert join_rows(spark, "o_token") - before < 10 * 40 * 39 // 2


def test_first_shingles_are_dealt_evenly(spark, make_docs):
    rng = random.Random(22)
    docs = make_docs(*[(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(200)] * 2)
    total = 200 * 196 / 5
    sets = simhash_dedup.shingle_sets
    met = sets._meetings(docs.withColumn("text", F.concat("text", F.lit(" end"), F.col("doc_id") % 2)).union(docs), 400, total, 5, 8, total / 8, 10**6)
    rows = [r.n for r in met.filter("kind = 1").groupBy(F.expr("token >> 32").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(rows) == 8 and max(rows) < 2 * min(rows)


def test_sets_that_stars_leave_apart_are_linked_by_similarity(spark, make_docs):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(90)]
    texts = [list(words)]
    for _ in range(70):  # copies of one text with a few words of their own, so that similarities lie around 0.8
        texts.append([w if rng.random() > 0.025 else f"x{rng.randrange(10**6)}" for w in words])
    docs = make_docs(*[(i, " ".join(t)) for i, t in enumerate(texts)])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    least = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = least[i], least[j]
                least = [min(a, b) if x in (a, b) else x for x in least]
    found = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates_by_jaccard(docs).collect()}
    assert found == dict(enumerate(least)) and len(set(least)) > 3


def test_texts_are_masked_once(spark, sample):
    """A filter on the exploded lines must not be pushed below the masking, which would then be done anew for it."""
    plan = line_dedup._lines(sample, 1, whole=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "Filter" not in plan
    assert plan.count("regexp_replace(") <= 3


def test_components_by_one_task_and_by_rounds(spark, monkeypatch):
    """Few edges take no rounds, whose many jobs fill the driver; either way names the same."""
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(-20, 20)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(99, i) for i in range(50, 98)] + [(7000, 7000)]
    frame = spark.createDataFrame(edges, "a long, b long")
    rounds = []
    monkeypatch.setattr(simhash_dedup, "release", lambda session: rounds.append(session))
    got = {r.node: r.root for r in simhash_dedup.components(frame).collect()}
    assert not rounds
    monkeypatch.setattr(simhash_dedup.common, "ONE_TASK", 0)
    assert got == {r.node: r.root for r in simhash_dedup.components(frame).collect()} and rounds
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: y for x, y in label.items() if x != y}
    assert simhash_dedup.components(frame.filter("a > 99999")).count() == 0
