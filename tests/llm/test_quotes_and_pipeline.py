"""Quotation linking and the pipeline, against brute force and on odd rows."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pytest

from lawspark.llm import mixing, quotes
from tests.llm.test_ops import ODD, WORD, brute_base
from tests.llm.test_similar_texts import brute_stay
from tests.llm.test_sql import same

KIND = "conv_id long, turn long, role string, text string, body string, size int"

TALK = [
    (1, 0, "a", "Shall we meet on Monday?\n\nI am free after ten."),
    (1, 1, "b", "On Tue, A wrote:\n> Shall we meet on Monday?\n\nMonday is fine."),
    (1, 2, "a", "> On Tue, A wrote:\n>> shall  we meet on MONDAY?\n> Monday is fine.\n\nGood."),
    (1, 3, "b", "> I am free after ten.\nTen it is."),
    (1, 4, "a", "And then?"),
    (1, 5, "b", "> Never said here\nWhat?"),
    (2, 0, "a", "Shall we meet on Monday?"),
    (2, 1, "b", "> I am free after ten.\nNo such line in this talk."),
    (2, 2, "b", "> Later words\nToo early"),
    (2, 3, "b", "Later words"),
]


def test_passages():
    body, found = quotes.passages("Hi\n> a\n> b\n>> c\nbye")
    assert body == "Hi\nbye" and found == [(0, ["Hi"]), (1, ["a", "b"]), (2, ["c"]), (0, ["bye"])]
    assert quotes.passages("> > deep\n>\n> flat") == ("", [(2, ["deep"]), (1, ["flat"])])
    assert quotes.passages("plain\n\ntext ")[0] == "plain\n\ntext " and quotes.passages("") == ("", [])
    assert quotes.passages("a > b\n1 < 2")[1] == [(0, ["a > b", "1 < 2"])]


def test_links(spark):
    rows = [(*r, "old", 1) for r in TALK]
    out = {(r.conv_id, r.turn): r for r in quotes.linked(spark.createDataFrame(rows, KIND)).collect()}
    assert len(out) == len(TALK)
    replies = {k: r.reply_to for k, r in out.items()}
    assert replies == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 3, (1, 5): 4, (2, 0): None, (2, 1): 0, (2, 2): 1, (2, 3): 2}
    assert (out[1, 2].n_quotes, out[1, 2].n_linked) == (3, 2)
    assert out[1, 5].n_linked == 0 and out[2, 1].n_linked == 0 and out[2, 2].n_linked == 0
    assert out[1, 1].body == "Monday is fine." and out[1, 3].body == "Ten it is." and out[1, 0].body == TALK[0][3]
    assert {k: r.branch for k, r in out.items() if k[0] == 1} == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 3, (1, 4): 3, (1, 5): 3}
    assert (out[1, 4].branch, out[1, 4].top, out[1, 4].depth, out[1, 4].place) == (3, 0, 1, 4) and out[1, 0].size == 1


def test_odd_messages(spark):
    rows = [(None, 0, "a", "x"), (1, None, "a", "x"), (1, 0, None, None), (1, 0, "a", ""), (1, 1, "b", "> x"), (1, 1, "b", "> x"), (7, 500000, "b", "y " * 50_000), (7, 3, "b", "y")]
    out = quotes.linked(spark.createDataFrame([(*r, "old", 1) for r in rows], KIND)).collect()
    assert Counter((r.conv_id, r.turn, r.role, r.text) for r in out) == Counter(rows)
    assert all(r.body is None for r in out if r.text is None) and [r.body for r in out if r.text == "> x"] == ["", ""]
    assert all(r.branch is None for r in out if r.conv_id is None or r.turn is None)
    assert quotes.linked(spark.createDataFrame([], KIND)).count() == 0


def test_deep_branches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(quotes, "TURNS", 4)
    rows = [(1, 0, "a", "line 0")]
    for t in range(1, 20):
        rows.append((1, t, "a", f"> line {max(0, t - 3)}\nline {t}" if t % 3 == 0 else f"line {t}"))
    out = {r.turn: r for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: (r.reply_to, r.branch, r.top, r.depth, r.place) for t, r in out.items()} == {t: w[1:] for (_, t), w in brute_order({(1, t): r.reply_to for t, r in out.items()}).items()}
    assert out[19].depth == 6


def brute_order(replies):
    """(conv, turn) to reply_to to (conv, reply_to, branch, top, depth, place), by walking the branches."""
    out, kids = {}, defaultdict(list)
    for c, t in sorted(replies):
        to = replies[c, t]
        branch = t if to is None or to != t - 1 else out[c, t - 1][2]
        top = out[c, branch][3] if branch != t else None if to is None else out[c, to][2]
        out[c, t] = [c, to, branch, top]
        if branch == t:
            kids[c, top].append(t)
    for c in {c for c, _ in out}:
        todo, place = [(b, 0) for b in reversed(kids[c, None])], 0
        while todo:
            b, depth = todo.pop()
            t = b
            while (c, t) in out and out[c, t][2] == b:
                out[c, t] += [depth, place]
                place, t = place + 1, t + 1
            todo += [(k, depth + 1) for k in reversed(kids[c, b])]
    return {k: tuple(v) for k, v in out.items()}


def brute_links(rows):
    """rows: conv, turn, text. (conv, turn) to (n_quotes, n_linked, reply_to) of each row, by comparing every quote with every earlier text."""

    def norm(x):
        return " ".join(re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)))

    said, quoted = defaultdict(set), []
    for conv, turn, text in rows:
        runs, all_own = [], []
        lines = []
        for x in (text or "").split("\n"):
            k = 0
            rest = x[:3].lstrip(" \t") + x[3:] if x[:3].lstrip(" \t")[:1] == ">" or x[:4].lstrip(" \t")[:1] == ">" else x
            while rest[:1] == ">":
                k += 1
                rest = rest[1:]
                rest = rest[1:] if rest[:1] in (" ", "\t") else rest
            lines.append((k, rest))
        for j, (k, x) in enumerate(lines):
            low = norm(x)
            head = k == 0 and (low.endswith(" wrote:") or low.endswith(" said:")) and len(low) < 90
            nxt = [y for y in lines[j + 1 : j + 3] if y[0] or norm(y[1])]
            if head and nxt and nxt[0][0]:
                runs.append(None)
            elif not low:
                runs.append(None)
            elif runs and runs[-1] and runs[-1][0] == k:
                runs[-1][1].append(low)
            else:
                runs.append((k, [low]))
        for r in filter(None, runs):
            if not r[0]:
                said[conv, turn] |= {" ".join(r[1]), *r[1]}
                all_own += r[1]
        said[conv, turn].add(" ".join(all_own))
        quoted.append([r for r in runs if r and r[0]])
    out = []
    for (conv, turn, _), quotes_ in zip(rows, quoted):
        origins = []
        for k, ls in quotes_:
            looks = [" ".join(ls), *sorted(ls, key=len, reverse=True)]
            first = next((min(ts) for x in looks if x and (ts := [t for (c, t), ss in said.items() if c == conv and t < turn and x in ss])), None)
            origins.append((k, first))
        linked_ = [t for _, t in origins if t is not None]
        by_quote = max((t for k, t in origins if k == 1 and t is not None), default=None)
        back = turn - 1 if any(c == conv and t == turn - 1 for c, t, _ in rows) else None
        out.append((conv, turn, len(origins), len(linked_), by_quote if by_quote is not None else back))
    return out


def threads(seed):
    """Mail threads: replies that quote earlier messages whole, in part, nested, trimmed and edited, with gaps and repeated turns."""
    rng, rows = np.random.default_rng(seed), []
    start = {0: 0, 1: -7, 2: 20_000_000_000, 3: 5, 4: 1, 5: 1000}
    for conv in range(6):
        texts, turn = [], start[conv]
        for _ in range(25):
            own = [" ".join(f"W{x}" for x in rng.integers(300, size=rng.integers(1, 9))) for _ in range(int(rng.choice([1, 3, 6, 50], p=[0.3, 0.4, 0.25, 0.05])))]
            if rng.random() < 0.3:
                own.insert(len(own) // 2, "")
            lines = []
            for _ in range(int(rng.integers(0, 3)) if texts else 0):
                src = texts[int(rng.integers(max(0, len(texts) - 8), len(texts)))].split("\n")
                cut = src[: int(rng.integers(1, len(src) + 1))] if rng.random() < 0.5 else src
                cut = [x.lower() + "  " if rng.random() < 0.2 else x + " edited" if rng.random() < 0.2 else x for x in cut]
                lines += [*(["On Monday, somebody wrote:"] if rng.random() < 0.5 else []), *("> " + x if rng.random() < 0.8 else " >" + x for x in cut), *([""] if rng.random() < 0.5 else [])]
            text = "\n".join([*lines, *own])
            texts.append(text)
            rows.append((conv, turn, text))
            if rng.random() < 0.1:
                rows.append(rows[-1] if rng.random() < 0.5 else (conv, turn, "> " + own[0] + "\nsame turn"))
            turn += 1 if rng.random() < 0.92 else 3
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_threads(spark, monkeypatch, seed):
    """Every link, branch and place against brute force, and the SQL against both."""
    monkeypatch.setattr(quotes, "TURNS", 8)
    rows = threads(seed)
    out = quotes.linked(spark.createDataFrame([(c, t, "r", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    links = brute_links(rows)
    assert Counter((r.conv_id, r.turn, r.n_quotes, r.n_linked, r.reply_to) for r in out) == Counter(links)
    assert sum(n[3] for n in links) > 50
    to = {}
    for c, t, _, _, x in links:
        to[c, t] = max((y for y in (to.get((c, t)), x) if y is not None), default=None)
    order = brute_order(to)
    assert all((r.branch, r.top, r.depth, r.place) == order[r.conv_id, r.turn][2:] for r in out)
    assert max(r.depth for r in out) > 2
    db = duckdb.connect()
    db.register("conversations", pd.DataFrame([(c, t, "r", x) for c, t, x in rows], columns=["conv_id", "turn", "role", "text"]))
    same(pd.DataFrame([r.asDict() for r in out]).drop(columns="text"), db.execute(quotes.OP8_SQL).df())


def test_op8_keeps_all_messages(spark, sf):
    from lawspark.llm.queries import QUERIES

    given = spark.read.parquet(f"{sf}/conversations.parquet")
    out = QUERIES["op8_quotations"](spark, sf)
    assert Counter(map(tuple, out.select("conv_id", "turn", "role", "body").collect())) == Counter(map(tuple, given.select("conv_id", "turn", "role", "text").collect()))


# The pipeline --------------------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def staged(spark, docs, folder, tmp_path):
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs)
    return out


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean, single, mix, packed = staged(spark, docs, sf, tmp_path)
    assert len(corpus_pipeline.STAGES) == 4 and all(d.columns == docs.columns for d in (clean, single, mix))
    texts = {r.doc_id: r.text for r in docs.collect()}
    cut = {r.doc_id: r.text for r in clean.collect()}
    kept = set(cut)
    assert all([x for x in cut[i].split("\n") if x not in texts[i].split("\n")] == [] for i in kept)
    assert not any(brute_base(texts[i])[5] for i in kept) and len(kept) > 0.6 * len(texts)
    assert sorted(r.doc_id for r in single.collect()) == brute_stay([(r.doc_id, r.text) for r in clean.collect()])
    sizes, taken = Counter(), Counter()
    for r in single.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    for r in mix.collect():
        assert r.text in cut[r.doc_id] and r.n_chars == len(r.text)
        taken[r.source] += len(WORD.findall(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, goal in zip(order, mixing.targets([sizes[s] for s in order])):
        assert abs(taken[s] - goal) <= 256
    seqs, lengths = defaultdict(list), Counter()
    for r in packed.collect():
        seqs[r.sequence_id].append((r.offset, r.length))
        lengths[r.doc_id] += r.length
    assert set(lengths) == {r.doc_id for r in mix.collect()}
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


CLASHES = ("_w", "_l", "kept", "n_words", "_mark", "fp", "grp", "component_id", "_h", "_h2", "_size", "_runs", "block", "sid", "size", "k", "length")


@pytest.mark.parametrize("rows", [[(i, t, "en", s, 3) for i, t, s in ODD], []])
@pytest.mark.parametrize("more", [(), CLASHES])
def test_stages_on_odd_rows(spark, tmp_path, rows, more):
    """Each stage on nulls, empty and long texts, repeated rows, no rows, and columns whose names clash with its own."""
    kind = ", ".join([DOCS, *(f"{c} string" for c in more)])
    docs = spark.createDataFrame([(*r, *("own " + c for c in more)) for r in rows], kind)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if not rows:
            assert got == []
        elif k < 3:
            assert out.columns == docs.columns and {r.doc_id for r in got} <= {r[0] for r in rows}
            assert all(r[c] == "own " + c for r in got for c in more)
        if rows and k == 2:
            words = Counter()
            for r in got:
                words[r.doc_id] += len(WORD.findall(r.text))
            assert all(words[i] <= 3 * sum(len(WORD.findall(t or "")) for j, t, _ in ODD if j == i) for i in words)
        if rows and k == 3:
            assert {r.doc_id for r in got} == {r[0] for r in rows}


def test_modules_swallow_no_import_errors():
    from pathlib import Path

    for f in [*Path("lawspark/llm").glob("*.py"), Path("corpus_pipeline.py")]:
        assert not re.search(r"except\s+(ImportError|ModuleNotFoundError|Exception)", f.read_text())


def test_saved_tables_go(spark, sf):
    """Of an operator's tables only those that its result reads stay; of a pipeline run those of its last stages."""
    from pathlib import Path

    from lawspark.llm import common
    from lawspark.llm.queries import QUERIES

    top = Path(common.shared_dir(spark).removeprefix("file://"))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, most in [("op2_simhash", 2), ("op3_mixing", 1), ("op7_url_templates", 1), ("op8_quotations", 3), ("op9_near_vectors", 2)]:
        before = set(top.iterdir())
        QUERIES[name](spark, sf).count()
        assert len(set(top.iterdir()) - before) <= most, (name, set(top.iterdir()) - before)
    before = set(top.iterdir())
    corpus_pipeline.run(spark, sf).count()
    left = sorted(p.name.split("-")[0] for p in set(top.iterdir()) - before)
    assert left == ["lengths", "pieces", "stage"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    with pytest.raises(ValueError), common.temporary():
        table = common.saved(spark.range(3), "gone")
        raise ValueError
    assert not Path(table._saved_path.removeprefix("file://")).exists()
