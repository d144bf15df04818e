"""The operators of the subpackage against brute force, on the smallest tables and on fixtures with odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from lawspark.llm import common, licences, mixing, packing, quality, sharding, simhash, tokens, urls, vectors

WORD = re.compile(r"[^\x20\x09-\x0d]+")

ODD = [
    (1, "a b c d e f g h", "x"),
    (2, None, "x"),
    (3, "", None),
    (4, " \n\t ", "y"),
    (None, "one two three", None),
    (None, None, None),
    (5, "a b c d e f g h", "x"),
    (5, "a b c d e f g h", "x"),
    (6, "Ünïcödé wörds — 日本語 \U0001f600 <s> <|endoftext|> \x00 end", "z"),
    (7, "word " * 30_000, "z"),
    (8, "x" * 70_000, "é"),
    (9, "single", "a"),
    (10, "two words", "a"),
]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """A folder of tables with odd rows and an extra column whose name clashes with results."""
    top = tmp_path_factory.mktemp("odd")
    rows = [(i, t, "en", s, len(t or ""), 1, "e") for i, t, s in ODD]
    names = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    pages = [(0, "http://A.Example.org/es/1", "h"), (1, None, None), (2, "no scheme", ""), (None, "https://x.com/de/a?q#f", "h"), (3, "http://h", ""), (3, "http://h", ""), (4, "ftp://org/x", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    v = [(0, [1.0, 0.0]), (1, [2.0, 0.01]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (6, [0.0, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (10, [float("inf"), 0.0])]
    spark.createDataFrame([(a, b, 0) for a, b in v], "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    return str(top)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory, odd_dir):
    top = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{top}/{t}.parquet")
    return str(top)


def docs_of(spark, folder):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def folders(sf, odd_dir):
    return [sf, odd_dir]


def multiset(rows):
    return Counter(tuple(r) for r in rows)


# 1 ---------------------------------------------------------------------------------------------------------------------


def test_op1(spark, sf, odd_dir, empty_dir):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
    for folder in folders(sf, odd_dir):
        want = multiset((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, _ in docs_of(spark, folder))
        got = tokens.op1_token_counts(spark, folder).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
        assert multiset(got) == want
    assert tokens.op1_token_counts(spark, empty_dir).count() == 0


def test_chunks_are_exact():
    sp, joined = tokens.model(public_tokenizers.path(tokens.MODEL))
    rng = np.random.default_rng(0)
    parts = ["the ", "and", " ", "  ", "\n", "x", "tion", "é", "日本", "▁", "12", "-", "\U0001f600", "\x00", "ing ", "aaaa"]
    for size in (7, 20, 64):
        for _ in range(40):
            text = "".join(rng.choice(parts, 150))
            assert tokens.count_tokens(sp, joined, text, size, 4)[0] == len(sp.encode(text))
    n, chunks, widened = tokens.count_tokens(sp, joined, "a" * 500 + " b" * 50, 64, 4)
    assert n == len(sp.encode("a" * 500 + " b" * 50)) and widened and chunks > 1


# 2 ---------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    n = Counter(xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles)
    return sum(1 << b for b in range(64) if 2 * sum(c for x, c in n.items() if x >> b & 1) > len(shingles))


def brute_components(names, links):
    up = list(range(len(names)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    low = defaultdict(list)
    for k, n in enumerate(names):
        low[find(k)].append(n)
    return [min((n for n in low[find(k)] if n is not None), default=None) for k in range(len(names))]


def test_op2(spark, sf, odd_dir, empty_dir):
    for folder in folders(sf, odd_dir):
        docs = docs_of(spark, folder)
        fps = [brute_fingerprint(t) for _, t, _ in docs]
        f = np.array(fps, np.uint64)
        near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
        comp = brute_components([d[0] for d in docs], np.argwhere(near).tolist())
        want = Counter((d[0], f"{x:016x}", c) for d, x, c in zip(docs, fps, comp))
        assert multiset(simhash.op2_simhash(spark, folder).collect()) == want
    assert simhash.op2_simhash(spark, empty_dir).count() == 0


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [x ^ np.uint64((1 << int(a)) | (1 << int(b))) for x in base for a, b in rng.integers(0, 64, (6, 2))]
    f = np.unique(np.concatenate([base, np.array(flips, np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    names = f.view(np.int64).tolist()
    want = dict(zip(names, brute_components(names, np.argwhere(near).tolist())))
    df = spark.createDataFrame([(n,) for n in names], "fp long")
    assert {r.fp: r.grp for r in simhash.groups(df, 2, block=8).collect()} == want


def test_one_of_each(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "6", "7", "8", "9", "10", "None"])


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, 5000 + k) for k in range(1, 50)] + [(None, 1)]
    nodes = sorted({x for p in pairs for x in p if x is not None and None not in p and p[0] != p[1]})
    at = {n: k for k, n in enumerate(nodes)}
    want = dict(zip(nodes, brute_components(nodes, [(at[a], at[b]) for a, b in pairs if a is not None and a != b])))
    got = common.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    t = mixing.targets([100, 100, 100])
    assert t == pytest.approx([187.5, 75, 37.5])
    t = mixing.targets([10, 1000, 1000])
    assert t[0] == 30 and sum(t) == pytest.approx(2010)
    assert mixing.targets([7]) == [7]


def test_permutations():
    for n in (1, 2, 3, 5, 16, 17, 100, 1000):
        p = mixing.permuted(np.arange(n), n, 99)
        assert sorted(p.tolist()) == list(range(n))
        assert (mixing.permuted(p, n, 99, back=True) == np.arange(n)).all()


def test_op3(spark, sf, odd_dir, empty_dir):
    for folder in folders(sf, odd_dir):
        rows = mixing.op3_mixing(spark, folder).collect()
        docs = docs_of(spark, folder)
        assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in docs)
        sizes = Counter()
        for _, t, s in docs:
            sizes[s] += len(WORD.findall(t or ""))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        goal = dict(zip(order, mixing.targets([sizes[s] for s in order])))
        assert {(r.source_size, r.target) for r in rows} == {(sizes[s], goal[s]) for s in order}
        taken = defaultdict(int)
        for r in rows:
            assert 0 <= r.taken <= 3 * r["size"]
            taken[(r.source_size, r.target)] += r.taken
        for s in order:
            if list(goal.values()).count(goal[s]) == 1:
                assert abs(taken[(sizes[s], goal[s])] - goal[s]) <= mixing.BLOCK
        again = mixing.op3_mixing(spark, folder).collect()
        assert multiset(rows) == multiset(again)
    assert mixing.op3_mixing(spark, empty_dir).count() == 0


def test_mix_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    taken = defaultdict(int)
    for r in out.collect():
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        taken[r.doc_id] += len(WORD.findall(r.text))
    want = {r.doc_id: r.taken for r in mixing.op3_mixing(spark, sf).collect() if r.taken}
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.01)


def test_mix_of_repeated_rows_and_maps(spark):
    """Rows that are equal throughout are documents each; columns of maps and of clashing names stay."""
    rows = [(7, " ".join(f"w{k}" for k in range(300)), "a", {"x": 1}, "own")] * 200 + [(k, f"t{k} " * (k % 90), "b" if k % 3 else None, {"x": k}, "own") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>, _h string")
    out = mixing.mix_documents(df, block=32)
    assert out.schema == df.schema
    got, taken = out.collect(), defaultdict(int)
    for r in got:
        assert r._h == "own" and (r.m == {"x": 1} if r.doc_id == 7 and len(r.text) > 400 else True)
        taken[r.source] += len(WORD.findall(r.text))
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(WORD.findall(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, goal in zip(order, mixing.targets([sizes[s] for s in order])):
        assert abs(taken[s] - goal) <= 32
    report = mixing.mix_report(df).collect()
    assert len(report) == 500 and all(r.taken <= 3 * r["size"] for r in report) and multiset(report) == multiset(mixing.mix_report(df.repartition(7)).collect())


def test_many_sources(spark):
    """As many sources as documents: draws hold what isn't zero."""
    rows = [(k, "a b c d e " * 20, f"s{k}") for k in range(3000)]
    report = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(report) == 3000 and sum(r.taken for r in report) == pytest.approx(300_000, rel=0.3) and all(r.taken <= 300 for r in report)


# 4 ---------------------------------------------------------------------------------------------------------------------


def test_op4(spark, sf, odd_dir, empty_dir):
    for folder in folders(sf, odd_dir):
        docs, rows = docs_of(spark, folder), sharding.op4_ring_shards(spark, folder).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in docs)
        slots = defaultdict(list)
        for r in rows:
            assert 0 <= r.shard < 24 and r.law == "rows" and r.grown_shard is None
            slots[r.shard].append(r.slot)
        n = [len(slots[s]) for s in range(24)]
        assert max(n) - min(n) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert multiset(rows) == multiset(sharding.op4_ring_shards(spark, folder).collect())
    assert sharding.op4_ring_shards(spark, empty_dir).count() == 0


def test_ring_moves_little(spark, sf):
    """With room to spare, keys stay at home and one more shard moves about its share."""
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(F.col("id").alias("k"))
    where = [{r.k: r.shard for r in sharding.bounded_ring(rows, F.xxhash64("k"), ["k"], shards=n, load=1.25).collect()} for n in (8, 9)]
    assert max(Counter(where[0].values()).values()) <= 625
    moved = sum(where[0][k] != where[1][k] for k in where[0])
    assert moved < 0.35 * 4000


def test_ring_on_odd_rows(spark):
    """Columns named like its own keep their values; equal rows of a null key, counted before or not, fill shards alike."""
    from pyspark.sql import functions as F

    names = ["low", "high", "piece", "home", "bucket", "hash", "row", "rank", "n", "shard", "_placed"]
    rows = spark.createDataFrame([(None if k < 700 else k, *("own" for _ in names)) for k in range(1000)], "k long, " + ", ".join(f"{n} string" for n in names))
    out = sharding.bounded_ring(rows, F.xxhash64("k"), ["k"]).collect()
    assert Counter(r.shard for r in out) == {s: 42 if s < 16 else 41 for s in range(24)} and all(r[n] == "own" for r in out for n in names if n != "shard")
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    other = sharding.bounded_ring(counted, F.xxhash64("k"), ["k"], copies="c")
    assert other.columns == ["k", "home_shard", "shard", "slot"]
    assert multiset(other.collect()) == multiset((r.k, r.home_shard, r.shard, r.slot) for r in out)
    assert sharding.bounded_ring(rows.limit(0), F.xxhash64("k"), ["k"]).count() == 0


def test_settle_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(50):
        shards, pieces = int(rng.integers(1, 6)), int(rng.integers(6, 30))
        counts = [(k, int(rng.integers(shards)), int(rng.integers(0, 9))) for k in range(pieces)]
        cap = sharding.capacities(sum(c for *_, c in counts), shards, None)
        plan, load, seen = sharding.settle(counts, cap), Counter(), Counter()
        for piece, a, b, shard, slot in plan:
            assert slot == load[shard] and b > a
            load[shard] += b - a
            seen[piece] += b - a
        assert [load[s] for s in range(shards)] == cap
        assert all(seen[k] == n for k, _, n in counts)


# 5 ---------------------------------------------------------------------------------------------------------------------


def brute_licences(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    found = [(i, label) for p, label in licences.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_op5(spark, sf, odd_dir, empty_dir):
    for folder in folders(sf, odd_dir):
        rows = licences.op5_licences(spark, folder).collect()
        want = Counter((i, *brute_licences(t)) for i, t, _ in docs_of(spark, folder))
        assert Counter(tuple(r)[:6] for r in rows) == want
        for r in rows:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licences.op5_licences(spark, empty_dir).count() == 0


def test_matching_statistics():
    """The automaton against a search for each place, over few words so that runs overlap."""
    rng = np.random.default_rng(7)
    words = [b"a", b"b", b"c"]
    for _ in range(60):
        temps = [[words[k] for k in rng.integers(0, 3, rng.integers(1, 12))] for _ in range(4)]
        phrases = [[words[k] for k in rng.integers(0, 3, rng.integers(1, 4))] for _ in range(3)]
        a = licences.build(temps, phrases)
        text = [([*words, b"z"])[k] for k in rng.integers(0, 4, 60)]
        state = n = 0

        def known(run):
            return any(t[i : i + len(run)] == run for t in temps + phrases for i in range(len(t) - len(run) + 1))

        for i, w in enumerate(text):
            state, n = a.step(state, n, w)
            best = max(k for k in range(i + 2) if k == 0 or known(text[i + 1 - k : i + 1]))
            assert n == best
            here = sorted(k for k, size in a.phrases[state] if size <= n)
            assert here == sorted(k for k, p in enumerate(phrases) if text[max(0, i + 1 - len(p)) : i + 1] == p)


def test_spans():
    s = licences.Scanner()
    mit = licences.TEMPLATES[2][0]
    for text, label in [
        ("x y " + mit + " z", "mit"),
        ("/* " + mit.replace("charge", "charge, whatsoever,") + " */", "mit"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.", "gpl-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ]:
        assert {label} == {s.labels[k] for *_, k, _ in s.scan(licences.words_of(text))[1]}
    assert s.scan(licences.words_of("the software is free of charge and the rest is not"))[1] == []


def brute_spans(words, templates):
    """Runs and chains by searching every template at every word."""

    def known(run):
        return any(t[i : i + len(run)] == run for t in templates for i in range(len(t) - len(run) + 1))

    stat = []
    for i in range(len(words)):
        n = stat[-1] + 1 if stat else 1
        while n and not known(words[i + 1 - n : i + 1]):
            n -= 1
        stat.append(n)
    shortest = min([licences.MIN_RUN, *map(len, templates)])
    runs = [(i + 1, n) for i, n in enumerate(stat) if n >= shortest and (i + 1 == len(words) or stat[i + 1] <= n)]
    out = []
    for k, t in enumerate(templates):
        chain = None
        for end, n in runs:
            if n < min(licences.MIN_RUN, len(t)):
                continue
            run = words[end - n : end]
            ends = [e for e in range(n, len(t) + 1) if t[e - n : e] == run]
            if not ends:
                continue
            on = [e for e in ends if chain and e > chain["to"]]
            if on and end - n - chain["end"] <= licences.MAX_GAP and end > chain["end"]:
                chain["covered"] += min(n, end - chain["end"], on[0] - chain["to"])
                chain |= {"end": end, "to": on[0]}
                continue
            if chain:
                out.append((chain, k))
            chain = {"first": end - n, "end": end, "to": ends[0], "covered": n}
        if chain:
            out.append((chain, k))
    return sorted((c["first"], c["end"], k, c["covered"]) for c, k in out if c["covered"] >= licences.MIN_COVER * len(templates[k]))


def test_chains_by_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(150):
        vocabulary = [f"w{k}".encode() for k in range(int(rng.integers(3, 9)))]
        templates = [[vocabulary[k] for k in rng.integers(0, len(vocabulary), rng.integers(2, 25))] for _ in range(3)]
        words = []
        for _ in range(int(rng.integers(1, 7))):
            t = templates[rng.integers(3)]
            a, b = sorted(rng.integers(0, len(t) + 1, 2))
            words += [*(t if rng.random() < 0.4 else t[a:b]), *([b"zz"] * int(rng.integers(0, 3)) if rng.random() < 0.7 else [b"zz"] * 14)]
            if words and rng.random() < 0.4:
                words[rng.integers(len(words))] = vocabulary[rng.integers(len(vocabulary))]
        s = licences.Scanner([(b" ".join(t).decode(), f"l{k}") for k, t in enumerate(templates)], [])
        want = brute_spans(words, templates)
        best = s.scan(words)[1]
        s.best = lambda spans: spans
        assert s.scan(words)[1] == want and set(best) <= set(want)
        share = lambda x: x[3] / len(templates[x[2]])
        half = lambda x, y: 2 * (min(x[1], y[1]) - max(x[0], y[0])) > x[1] - x[0]
        assert set(best) == {x for x in want if not any(share(y) > share(x) and half(x, y) for y in want)}


def test_each_template_is_found():
    s = licences.Scanner()
    for k, (text, label) in enumerate(licences.TEMPLATES):
        words = licences.words_of("before it " + text.upper() + ", after it")
        assert any(x == k and s.labels[x] == label and c == s.lengths[k] for *_, x, c in s.scan(words)[1])


# 6 ---------------------------------------------------------------------------------------------------------------------


def test_op6(spark, sf, odd_dir, empty_dir):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    for folder in folders(sf, odd_dir):
        rows = packing.op6_packing(spark, folder).collect()
        want = Counter()
        for i, t, _ in docs_of(spark, folder):
            ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
            first = len(ids) % 1024 or min(1024, len(ids))
            for p, at in enumerate([0, *range(first, len(ids), 1024)]):
                part = ids[at : at + (1024 if p else first)]
                want[(i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
        assert Counter(tuple(r)[:5] for r in rows) == want
        seqs = defaultdict(list)
        for r in rows:
            seqs[r.sequence_id].append((r.offset, r.length))
        for parts in seqs.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 1024
        assert len(seqs) <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1
    assert packing.op6_packing(spark, empty_dir).count() == 0


def test_coders_agree():
    import public_tokenizers as p

    both = packing.Coder(p.path(packing.VOCABULARY), p.path(packing.RANKS), p.PATTERN)
    rng = np.random.default_rng(2)
    usual = [chr(c) for c in range(0x250) if not both.unusual.search(chr(c))] + list("‐‘’“”…€")
    for _ in range(400):
        text = "".join(rng.choice(usual, 60)) + "".join(rng.choice([" ", "'s", "don't", "\n", "the", "Ünd", "<|endoftext|>", "12", "  "], 30))
        assert both.part(text) == both.slow.encode(text, add_special_tokens=False).ids
        assert both.ids(text, 20).tolist() == both.slow.encode(text, add_special_tokens=False).ids


def test_fullest_by_brute_force():
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(200):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 30, rng.integers(1, 5))}
        gap = int(rng.integers(0, 60))
        got = packing.fullest(counts, gap)
        assert all(got[n] <= counts[n] for n in got)
        best = max(s for ks in itertools.product(*(range(c + 1) for c in counts.values())) if (s := sum(n * k for n, k in zip(counts, ks))) <= gap)
        assert sum(n * k for n, k in got.items()) == best


# 7 ---------------------------------------------------------------------------------------------------------------------


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def brute_tree(pages, bad):
    """The tree in plain Python, level by level down to the last segment of every path."""
    rows = []
    for page_id, url in pages:
        host, path = brute_url(url)
        segs = ["*" if re.search(urls.VARIABLE, s) else s for s in path.split("/") if s]
        rows.append([host, "", segs, bad.get(page_id)])
    for d in range(max((len(r[2]) for r in rows), default=0)):
        kids = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        on = [r for r in rows if len(r[2]) > d]
        for host, t, segs, b in on:
            for k, x in enumerate((1, b is False, b is True)):
                kids[host, t][segs[d]][k] += x
        for r in on:
            of, s = kids[r[0], r[1]], r[2][d]
            p, g, b = of[s]
            n, m = g + b, sum(x[1] + x[2] for x in of.values()) - g - b
            ng, nb = sum(x[1] for x in of.values()), sum(x[2] for x in of.values())
            same = not n or not m or (b * m - (nb - b) * n) ** 2 * (n + m) <= urls.Z2 * nb * ng * n * m
            rare = len(of) >= urls.FAN_OUT and p < urls.RARE
            r.append("*" if s == "*" or rare or len(of) > 1 and same else s)
        for r in on:
            r[1] += "/" + r.pop()
    ends = defaultdict(lambda: [0, 0])
    for host, t, _, b in rows:
        if b is not None:
            ends[host, t][b] += 1
    out = Counter()
    for (host, t, _, _), (page_id, url) in zip(rows, pages):
        path = brute_url(url)[1]
        rule, verdict = brute_rule(host, path)
        good, wrong = ends[host, t]
        block = wrong * 100 + urls.PRIOR_PAGES * urls.PRIOR_PERCENT > (good + wrong + urls.PRIOR_PAGES) * urls.MAX_BAD_PERCENT
        out[(page_id, host, path, rule, verdict or ("block" if block else "allow"), t)] += 1
    return out


def test_op7(spark, sf, odd_dir, empty_dir):
    for folder in folders(sf, odd_dir):
        bad = {}
        for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
            low = None if r.quality is None else r.quality == 0
            toxic = None if r.toxic is None else r.toxic == 1
            v = True if low or toxic else None if low is None or toxic is None else False
            if r.doc_id is not None and v is not None:
                bad[r.doc_id] = bad.get(r.doc_id, False) or v
        pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
        assert multiset(urls.op7_url_templates(spark, folder).collect()) == brute_tree(pages, bad)
    assert urls.op7_url_templates(spark, empty_dir).count() == 0


def test_tree_splits_and_rejects(spark):
    rng = np.random.default_rng(6)
    pages = [(k, f"http://h.net/{['blog', 'ads', 'wiki'][k % 3]}/{'post' if k % 2 else rng.integers(1000)}/a{k}") for k in range(600)]
    bad = {k: bool(k % 3 == 1) for k in range(0, 600, 2)}
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(list(bad.items()), "page_id long, bad boolean"))
    rows = got.collect()
    assert multiset(rows) == brute_tree(pages, bad)
    assert {r.verdict for r in rows if "/ads/" in r.path} == {"block"} and {r.verdict for r in rows if "/wiki/" in r.path} == {"allow"}


# 9 ---------------------------------------------------------------------------------------------------------------------


def brute_vectors(rows):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = []
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if ok[i] and ok[j] and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                    links.append((i, j))
    n = Counter(k for p in links for k in p)
    comp = brute_components([k for k, _ in rows], links)
    return [(k, n[i], c, k == c) for i, ((k, _), c) in enumerate(zip(rows, comp))]


def test_op9(spark, odd_dir, empty_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{odd_dir}/embeddings.parquet").collect()]
    got = vectors.op9_near_vectors(spark, odd_dir).collect()
    assert multiset(got) == Counter(brute_vectors(rows))
    assert vectors.op9_near_vectors(spark, empty_dir).count() == 0


def test_each_candidate_counts_once():
    """Over all buckets a pair is a candidate exactly once if some part differs in at most one bit, else never."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) for x in base for n in (1, 2, 4, 6, 9, 14)]
    codes = np.unique(np.concatenate([base, np.array(flips, np.uint64)]))
    count = np.zeros((len(codes), len(codes)), int)
    for place in range(vectors.WAYS * vectors.TABLES):
        keys = vectors.key_of(codes, place)
        count += vectors.candidates(codes, codes, place) & (keys[:, None] == keys[None, :])
    x = codes[:, None] ^ codes[None, :]
    near = np.any([np.bitwise_count((x >> np.uint64(16 * t)) & np.uint64(0xFFFF)) <= 1 for t in range(4)], axis=0)
    assert (count == near).all()


def test_vector_recall(spark):
    """Recall on planted pairs down to the limit, and exactness of what is linked."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((400, 64))
    near = [b / np.linalg.norm(b) + s * (e := rng.standard_normal(64)) / np.linalg.norm(e) for b in base for s in rng.uniform(0, 0.33, 3)]
    x = np.vstack([base / np.linalg.norm(base, axis=1, keepdims=True), near]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, block=64).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.98 * want.sum()


def test_vectors_of_a_whole_table(spark, sf):
    """All links of a real table against brute force: none beyond the limit, recall, and the components of what was found."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    u = vectors.units(np.array([v for _, v in rows], float))
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in vectors.op9_near_vectors(spark, sf).collect()}
    assert len(got) == len(rows) and all(got[k].n_links <= w for (k, _), w in zip(rows, want))
    assert sum(r.n_links for r in got.values()) >= 0.95 * want.sum()
    whole = [k for (k, _), w in zip(rows, want) if got[k].n_links == w]
    comp = dict(zip([k for k, _ in rows], brute_components([k for k, _ in rows], np.argwhere(u @ u.T >= 0.95).tolist())))
    assert sum(got[k].component_id == comp[k] for k in whole) >= 0.95 * len(whole)


def test_many_lengths(spark):
    """Lengths cost no jobs of their own; equal vectors link whatever their length and however few there are."""
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(k % 40 + 1).tolist()) for k in range(400)]
    rows += [(1000 + k, v) for k, v in rows] + [(5000 + k, rows[7][1]) for k in range(300)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=32).collect()}
    assert all(got[1000 + k].component_id == got[k].component_id for k in range(400)) and got[5000].n_links >= 301 and got[5299].component_id <= 7
    limits = Counter(brute_vectors(rows))
    exact = Counter((k, got[k].n_links, got[k].component_id, got[k].kept) for k in got)
    assert sum((limits & exact).values()) >= 0.97 * len(rows)


# 10 --------------------------------------------------------------------------------------------------------------------


def brute_base(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def test_op10(spark, sf, odd_dir, empty_dir):
    for folder in folders(sf, odd_dir):
        rows = quality.op10_quality(spark, folder).collect()
        want = Counter((i, *brute_base(t)) for i, t, _ in docs_of(spark, folder))
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality.op10_quality(spark, empty_dir).count() == 0


def test_line_rules(spark):
    good = "The quick brown fox jumps over the lazy dog and runs away."
    cases = {good: True, "Home | News | Sports | Contact": False, "*** !!! ***": False, "SALE!! NOW!! HERE!!": False, "Log in": False, "Please enable JavaScript to go on": False, "Privacy Policy": False, "A line without an end": True, "Next": False, "Next year we shall see whether it rains more than in this one": True}
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r.line: r.p for r in df.select("line", quality.line_passes(df.line).alias("p")).collect()} == cases
    rows = [(1, "\n".join(" ".join(f"word{k}x{j}" for j in range(12)) + "." for k in range(9))), (2, "\n".join(f"Home {k} | News | Sports | Contact | a b c d" for k in range(20)))]
    kept = quality.with_quality(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.kept for r in kept.collect()} == {1: True, 2: False}
