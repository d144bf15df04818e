"""The path-template tree on shapes that the given tables don't have."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from lawspark.llm import urls

from .test_ops import brute_tree


def judged(spark, pages):
    """pages: (path, bad or None). The verdict and template of each."""
    p = spark.createDataFrame([(k, f"http://h.net{path}") for k, (path, _) in enumerate(pages)], "page_id long, url string")
    bad = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(pages)], "page_id long, bad boolean")
    return {r.page_id: (r.verdict, r.template) for r in urls.judge(p, bad).collect()}


def name(k):
    return "".join(chr(97 + k // 26**i % 26) for i in range(4))


def test_frequent_branch_beside_many_rare_ones(spark):
    pages = [(f"/{name(k)}", False) for k in range(1000)] + [("/casino/x", True)] * 500
    got = judged(spark, pages)
    assert {got[k] for k in range(1000)} == {("allow", "/*")} and {got[k] for k in range(1000, 1500)} == {("block", "/casino/x")}


def test_sections_below_four_levels(spark):
    pages = [(f"/2024/05/12/news/{'casino' if k % 2 else 'sports'}/story", bool(k % 2)) for k in range(400)]
    got = judged(spark, pages)
    assert {got[k] for k in range(0, 400, 2)} == {("allow", "/*/*/*/news/sports/story")}
    assert {got[k] for k in range(1, 400, 2)} == {("block", "/*/*/*/news/casino/story")}


def test_large_hot_host(spark):
    rows = [("h", ["a", "x"], 10**8, 9 * 10**7, 10**7), ("h", ["b", "x"], 10**8, 10**7, 9 * 10**7), ("g", ["a"], 2 * 10**5, 10**5, 10**5), ("g", ["b"], 2 * 10**5, 10**5, 10**5)]
    counts = spark.createDataFrame(rows, "host string, shape array<string>, pages long, good long, bad long")
    got = {(r.host, r.shape[0]): (r.template, r.t_good, r.t_bad) for r in urls.template_tree(counts).collect()}
    assert got["h", "a"] == ("/a/x", 9 * 10**7, 10**7) and got["h", "b"] == ("/b/x", 10**7, 9 * 10**7)
    assert got["g", "a"] == got["g", "b"] == ("/*", 2 * 10**5, 2 * 10**5)


def forest(seed=3):
    """Pages of a few hosts with paths of up to ten segments, wide nodes, branches of clear and of unclear labels."""
    rng = np.random.default_rng(seed)
    pages, bad = [], {}
    for k in range(3000):
        depth = int(rng.integers(0, 11))
        top = ["ads", "wiki", "blog", "shop"][int(rng.integers(4))]
        path = [top, *(rng.choice([f"s{rng.integers(3)}", name(int(rng.integers(200))), str(rng.integers(10**6))]) for _ in range(depth - 1))][:depth]
        pages.append((k, f"https://{'hot' if k % 3 else f'h{k % 7}'}.net/{'/'.join(path)}{'?q=/x' if k % 5 == 0 else ''}"))
        if rng.random() < 0.7:
            bad[k] = bool(rng.random() < {"ads": 0.95, "wiki": 0.05}.get(top, 0.4 if "s1" in path else 0.6))
    return pages, bad


def test_deep_forest(spark):
    """The query and its SQL against plain Python."""
    pages, bad = forest()
    p = spark.createDataFrame(pages, "page_id long, url string")
    rows = urls.judge(p, spark.createDataFrame(list(bad.items()), "page_id long, bad boolean")).collect()
    want = brute_tree(pages, bad)
    assert Counter(map(tuple, rows)) == want and {r.verdict for r in rows} == {"allow", "block"} and len({r.template for r in rows}) > 20
    c = duckdb.connect()
    c.register("pages", pd.DataFrame(pages, columns=["page_id", "url"]))
    c.register("labels", pd.DataFrame([(k, int(not b), 0) for k, b in bad.items()], columns=["doc_id", "quality", "toxic"]))
    got = c.execute(urls.OP7_SQL).df().astype(object)
    assert Counter(tuple(None if v is None or v != v else v for v in r) for r in got.itertuples(index=False, name=None)) == want


def test_very_deep_path(spark):
    pages = [("/" + "/".join(f"a{name(j)}" for j in range(40)), False)] * 3 + [("/b", True), ("", None)]
    got = judged(spark, pages)
    assert got[0][1].count("/") == 40 and got[3][1] == "/*" and got[4][1] == ""


def test_counts_beyond_64_bits(spark):
    n = 10**9
    rows = [("h", [s], n, n - b, b) for s, b in (("a", 10**8), ("b", 9 * 10**8), ("c", 10**8 + 10**3))]
    got = urls.template_tree(spark.createDataFrame(rows, "host string, shape array<string>, pages long, good long, bad long")).collect()
    assert {r.shape[0]: r.template for r in got} == {"a": "/a", "b": "/b", "c": "/c"}
