"""Line, substring and exact dedup against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.frames import NO_ID
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.substring_dedup import substring_dedup

from .conftest import ODD_IDS, ids

SPACE = " \t\n\x0b\x0c\r"
UPPER = {i: i + 32 for i in range(65, 91)}


def plain_lines(rows, min_chars=10, min_docs=2):
    key = lambda line: line.strip(SPACE).translate(UPPER)
    holders = defaultdict(set)
    for did, text in rows:
        for line in text.split("\n"):
            holders[key(line)].add(did)
    out = []
    for did, text in rows:
        lines = text.split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and min(holders[key(x)]) != did for x in lines]
        out.append((did, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


def plain_windows(rows, window):
    words = [text.encode().split() for _, text in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (did, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((did, len(w), len(gone), kept))
    return sorted(out)


def given(df):
    return [(NO_ID if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in df.collect()]


def result(df, *columns):
    rows = df.select("doc_id", *columns).collect()
    return sorted((NO_ID if r[0] is None else r[0], *r[1:]) for r in rows)


@pytest.fixture(scope="module")
def random_docs(spark):
    rng = random.Random(5)
    pool = [f"line number {i} " + "x" * (i % 7) for i in range(40)] + ["short", "", "  Line Number 3 xxx"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def passages(spark):
    """Few words, so that repeats overlap, nest and touch; one passage in a third of all documents."""
    rng = random.Random(9)
    shared = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))] for _ in range(12)]
    rows = []
    for i in range(240):
        words = []
        for _ in range(rng.randint(1, 5)):
            words += rng.choice(shared) if rng.random() < 0.5 else [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 15))]
        if i % 3 == 0:
            words += ["and"] * rng.randint(5, 60)
        rows.append((i, " ".join(words)))
    rows += [(1000, "and " * 400), (1001, "z " * 8), (1002, "z " * 7)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines(random_docs, min_docs):
    got = result(line_dedup(random_docs, min_docs=min_docs), "n_lines", "n_dropped", "kept")
    assert got == plain_lines(given(random_docs), min_docs=min_docs)


def test_lines_of_odd_documents(odd, none):
    assert result(line_dedup(odd), "n_lines", "n_dropped", "kept") == plain_lines(given(odd))
    assert line_dedup(none).collect() == []


@pytest.mark.parametrize("window", [1, 2, 7, 8, 35])
def test_passages(passages, window):
    got = result(substring_dedup(passages, window=window), "n_words", "n_removed", "kept")
    assert got == plain_windows(given(passages), window)


def test_passages_do_not_depend_on_the_layout(passages):
    one, nine = (result(substring_dedup(passages.repartition(n), window=7), "n_removed", "kept") for n in (1, 9))
    assert one == nine


def test_passages_of_odd_documents(odd, none):
    for window in (5, 35):
        out = substring_dedup(odd, window=window)
        assert result(out, "n_words", "n_removed", "kept") == plain_windows(given(odd), window)
        for row in out.collect():
            assert sum(s["n"] for s in row["removed"]) == row["n_removed"]
    assert substring_dedup(none).collect() == []


def test_a_gram_sketch_full_of_chance_bits_changes_nothing(passages, monkeypatch):
    import tidemark.llm.substring_dedup as module

    want = result(substring_dedup(passages, window=7), "kept")
    real = module._shared_grams

    def full(*args):
        sketch, common = real(*args)
        sketch[:] = 255
        return sketch, common

    monkeypatch.setattr(module, "_shared_grams", full)
    assert result(substring_dedup(passages, window=7), "kept") == want


def plain_groups(rows):
    groups = defaultdict(list)
    for did, text in rows:
        groups[text].append(did)
    return groups


@pytest.mark.parametrize("widths", [(1, 2), (3,), (128, 512)])
def test_equal_texts(spark, widths):
    rng = random.Random(2)
    texts = ["", "a", "aa", "aaa", "ab", "ä", "äb", "x" * 700, "x" * 701, "x" * 640 + "y"]
    rows = [(i, rng.choice(texts)) for i in range(120)]
    out = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), widths=widths)
    groups = plain_groups(rows)
    want = [
        (d, max(groups[t]), len(groups[t]), d == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())
        for d, t in rows
    ]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_equal_texts_of_odd_documents(odd, none):
    rows = exact_dedup(odd).collect()
    assert ids(exact_dedup(odd)) == ODD_IDS
    by_text = defaultdict(list)
    for row in rows:
        by_text[row["text_sha256"]].append(row)
    for same in by_text.values():
        assert sum(r["kept"] for r in same) == 1
        assert {r["group_size"] for r in same} == {len(same)}
        last = [None if r["doc_id"] is None else r["doc_id"] for r in same]
        assert {r["keep_id"] for r in same} == {None if None in last else max(last)}
    assert exact_dedup(none).collect() == []


def test_all_texts_equal(spark):
    rows = spark.createDataFrame([(i, "same text") for i in range(50)], "doc_id long, text string")
    assert {(r["keep_id"], r["group_size"]) for r in exact_dedup(rows).collect()} == {(49, 50)}


def test_long_equal_texts_take_few_rounds(spark, monkeypatch):
    from tidemark.llm import exact_dedup as module

    rounds = []
    measured = module.measured
    monkeypatch.setattr(module, "measured", lambda df, label, **m: rounds.append(label) or measured(df, label, **m))
    long = "0123456789" * 1_000_000
    docs = spark.createDataFrame([(1, long), (2, long), (3, long + "x"), (4, "short")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True)}
    assert len(rounds) <= 24  # two tables a round
