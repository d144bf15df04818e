"""The pipeline's near-duplicate stage against all pairs of 5-word shingle sets."""

from collections import defaultdict

import numpy as np

import corpus_pipeline
from lawspark.llm import simhash

from .test_ops import brute_components


def brute_sets(texts):
    out = []
    for t in texts:
        w = [x.lower() for x in (t or "").encode().split()]
        k = min(5, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute_stay(rows):
    """Smallest keys of the groups connected by a 5-word Jaccard similarity of 0.8 or more."""
    rows, sets = sorted(rows), brute_sets([t for _, t in sorted(rows)])
    links, by = [], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or [None]:
            by[x].append(i)
    for i, j in {(i, j) for b in by.values() for i in b for j in b if j < i}:
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            links.append((i, j))
    return sorted(set(brute_components([k for k, _ in rows], links)))


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.integers(len(words))] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def test_stage_links_all_similar_texts(spark, sf):
    """Loose copies around the limit, some in a dense group, among unlike texts that share a common passage."""
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(4000, size=rng.integers(60, 300))] for _ in range(60)]
    passage = [f"p{k}" for k in range(40)]
    texts = [" ".join(b) for b in base] + [edited(rng, b, t) for b in base for t in (1, 2, 4, 6)]
    texts += [edited(rng, base[0], t) for t in range(1, 9) for _ in range(12)] + [" ".join(passage + b[:40]) for b in base] + ["", " ", "a b", "A  b", "a b c"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_stay(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()) == want
    assert sorted(r.doc_id for r in simhash.one_of_each(df, block=16, whole_block=1000).collect()) == want
    fps = [simhash.fingerprint(t) for t in texts[:300]]
    assert sum((fps[k] ^ fps[60 + 4 * k]).bit_count() > 2 for k in range(60)) > 5


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == brute_stay(rows)


def test_recall_of_wide_fingerprints():
    """Of pairs just at the limit next to none are beyond the radii, and unrelated sets are."""
    rng = np.random.default_rng(11)

    def code(s):
        return [np.array([simhash.majority(simhash.again(s, k))], np.uint64) for k in range(simhash.SET_WORDS)]

    def joined(codes):
        return [np.concatenate(w) for w in zip(*codes)]

    left, right, na, nb = [], [], [], []
    for _ in range(3000):
        n = int(rng.integers(30, 400))
        only = n // 9  # n - only shared of n + only: 0.8 or a little more
        x = rng.integers(0, 1 << 63, n + only, dtype=np.uint64)
        left.append(code(x[:n]))
        right.append(code(x[only:]))
        assert 10 * (n - only) >= 8 * (n + only)
        na.append(n)
        nb.append(n)
    hit = simhash.near(joined(left), joined(right), np.array(na), np.array(nb))
    assert np.diag(hit).mean() >= 0.998
    assert hit.sum() - np.diag(hit).sum() == 0


def test_long_fingerprints_by_their_definition():
    """Texts of more shingles than are counted at a time, against bit counts made one by one."""
    import xxhash

    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(50, size=simhash.STEP * 2 + 77)]
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert simhash.fingerprint(" ".join(words)) == want


def test_rows_that_differ_in_key_or_text_alone(spark):
    rows = [(1, "a b c d e f", {"x": 1}), (1, "a b c d e f", {"x": 2}), (1, "other words stand here today", {}), (None, "a b c d e f", {}), (None, "quite another text", {}), (None, "quite another text", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (1, "other words stand here today"), (None, "quite another text")], key=str)
