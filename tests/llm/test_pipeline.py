"""The pipeline against its stages run by hand, and its effects."""

import random
from collections import Counter
from itertools import combinations

import pyarrow as pa

import corpus_pipeline
from lakeweave.llm import shingle_sets, simhash_dedup
from tests.llm.conftest import SF


def test_stages_are_applied_in_order(spark, sample, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "packing"]
    docs, kept = sample, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.collect())
    key = lambda r: (str(r.doc_id), r.piece, r.words, str(r.bin), str(r.start))
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, kept[-1]))
    # near-duplicates: the smallest doc_id of each brute-force class
    assert sorted(r.doc_id for r in kept[2]) == kept_by_jaccard({r.doc_id: r.text for r in kept[1]})
    # packing places each word of the mixed corpus once
    words = Counter()
    for r in kept[3]:
        words[r.doc_id] += len(r.text.encode().split())
    placed = Counter()
    for r in kept[4]:
        placed[r.doc_id] += r.words
    assert placed == words


def test_documents_without_language_go(spark, make_docs):
    docs = make_docs((1, "some words of english text here"), (2, "1234 5678"), (3, None), (4, "more english words in a text"))
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 4]


def shingles_by_force(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_by_jaccard(texts):
    """The smallest id of each group linked by 5-word Jaccard similarity of 0.8 or more."""
    sets = {i: shingles_by_force(t) for i, t in texts.items()}
    near = lambda a, b: a == b or (both := len(a & b)) and 10 * both >= 8 * (len(a) + len(b) - both)
    left, kept = sorted(sets), []
    while left:
        kept.append(left[0])
        group, left = [left[0]], left[1:]
        for i in group:
            found = [j for j in left if near(sets[i], sets[j])]
            group += found
            left = [j for j in left if j not in found]
    return kept


def test_near_dedup_by_jaccard(spark, sample, make_docs):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for base in range(12):  # chains of near copies whose words differ in many places
        text = [rng.choice(words) for _ in range(rng.choice([30, 120, 300]))]
        for step in range(4):
            rows.append((base * 10 + step, " ".join(text)))
            for at in rng.sample(range(len(text)), len(text) // 60 + 1):
                text[at] = rng.choice(words)
    hot = [rng.choice(words) for _ in range(150)]
    rows += [(1000 + i, " ".join([*hot[:at], f"own{i}", *hot[at + 1 :]])) for i, at in enumerate(rng.choices(range(150), k=150))]
    rows += [(2000 + i, " ".join([*hot[: 20 + i], *rng.choices(words, k=100)])) for i in range(100)]
    for docs in (make_docs(*rows), sample):
        out = corpus_pipeline.dedup_documents(spark, docs, SF)
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert sorted(r.doc_id for r in out.collect()) == kept_by_jaccard(texts)


def test_lines_of_any_length_go(spark, make_docs):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = make_docs(*[(i, f"document {'abc'[i]} has this line\n\nAll rights reserved.\nLes.\n\n{'a ' * i}text") for i in range(3)], (3, f"one more of its kind\n{long}"), (4, f"quite another beginning\n{long}\na line of two"), (5, "some other text here\na line of two"))
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got[0].count("\n") == 5 and got[1] == "document b has this line\n\n\na text" and got[2] == "document c has this line\n\n\na a text"
    assert got[3].endswith(long) and got[4] == "quite another beginning\na line of two" and got[5].endswith("\na line of two")


def test_near_dedup_goes_by_simhash_trees(spark, sample, monkeypatch):
    """The stage asks the vantage-point trees for its first candidates and lets go of what it is done with."""
    real, freed, trees = simhash_dedup.links, [], []
    monkeypatch.setattr(simhash_dedup, "links", lambda *a, **k: trees.append(a) or real(*a, **k))
    for module in (simhash_dedup, shingle_sets):
        monkeypatch.setattr(module, "release", lambda session: freed.append(session))
    corpus_pipeline.dedup_documents(spark, sample, SF).count()
    assert len(trees) == 1 and len(freed) >= 4
    prints = shingle_sets.set_prints(sample, hashed=True)
    hashes = {r.fp: r.simhash % (1 << 64) for r in prints.select("fp", "simhash").distinct().collect()}
    for r in prints.join(sample.select("doc_id", "text"), "doc_id").limit(60).collect():
        tokens = [int(t) for t in shingle_sets.shingle_sets(pa.array([r.text]))[0]]
        assert hashes[r.fp] == sum(1 << b for b in range(64) if 2 * sum(t >> b & 1 for t in tokens) > len(tokens))
    root = {fp: fp for fp in hashes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(hashes, 2):
        if (hashes[a] ^ hashes[b]).bit_count() <= simhash_dedup.DIFFER:
            root[find(a)] = find(b)
    pairs = simhash_dedup.simhash_candidates(prints).collect()
    assert all(r.a < r.b and find(r.a) == find(r.b) for r in pairs)
    classes = len({find(x) for x in hashes})
    for r in pairs:
        root.setdefault(("own", r.a), ("own", r.a))
        root.setdefault(("own", r.b), ("own", r.b))
        root[find(("own", r.a))] = find(("own", r.b))
    assert classes == len({find(("own", x)) if ("own", x) in root else x for x in hashes})
