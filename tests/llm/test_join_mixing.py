"""N-gram join, decontamination, language, scoring, mixing and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.decontaminate import MATCH, align, decontaminate
from tidemark.llm.frames import NO_ID
from tidemark.llm.language_id import declared_in_markup, language_id
from tidemark.llm.lm_score import lm_score
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import ngram_join, prefix_length

from .conftest import ODD_IDS, ids

UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    want = {x: top(x) for a, b in links for x in (a, b) if a != b}
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: r for x, r in want.items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def grams(text, size=5):
    words = text.encode().translate(UPPER).split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def plain_join(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        same = [j for j in range(n) if sets[j] == sets[i] and sets[i]] or [i]
        out.append((rows[i][0], min(rows[j][0] for j in same), min(rows[j][0] for j in seen), len(links[i])))
    return sorted(out)


def join_result(out):
    back = lambda x: NO_ID if x is None else x
    return sorted((back(r[0]), back(r[1]), back(r[2]), r[3]) for r in out.select("doc_id", "set_id", "class_id", "n_links").collect())


@pytest.mark.parametrize("block", [128, 7])
def test_near_copies(spark, monkeypatch, block):
    """A large group of near copies, chains of them, copies, and passages that others share."""
    import tidemark.llm.ngram_join as module

    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 10**5)}"
    texts = []
    base = [word() for _ in range(200)]
    for _ in range(70):
        copy = list(base)
        for at in rng.sample(range(200), 2):
            copy[at] = word()
        texts.append(" ".join(copy))
    for _ in range(12):
        chain = [word() for _ in range(120)]
        for _ in range(4):
            texts.append(" ".join(chain))
            chain[rng.randint(0, 119)] = word().upper()
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(20)]
    texts += texts[:5] * 2 + ["few words", "FEW words", "few", "", " "]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    out = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    got, want = join_result(out), plain_join(rows)
    assert got == want
    firsts = out.where("first").groupBy("class_id").count().collect()
    assert len(firsts) == len({w[2] for w in want}) and {r["count"] for r in firsts} == {1}


def test_join_of_odd_documents(odd, none):
    rows = [(NO_ID if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert join_result(ngram_join(odd)) == plain_join(rows)
    assert ngram_join(none).collect() == []
    assert prefix_length(0.8, 32, 6, 0.9999) == 6 and prefix_length(0.8, 4, 6, 0.9999) == 1


@pytest.mark.parametrize("threshold, trees", [(0.8, 4), (0.2, 32)])
def test_a_join_that_cannot_keep_its_recall_raises(none, threshold, trees):
    with pytest.raises(ValueError, match="trees"):
        ngram_join(none, threshold=threshold, trees=trees)


def plain_align(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if x == y else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
    return max(map(max, rows))


def test_alignment_is_smith_waterman():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert align(np.array(a, np.uint64), np.array(b, np.uint64)) == plain_align(a, b)


def test_benchmark_passages(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(6))
    common = ["the", "of", "and", "in"]
    items = [[rng.choice(common) if rng.random() < 0.4 else word() for _ in range(30)] for _ in range(12)] + [["one", "two"], []]
    rows, truth = [], {}
    for i in range(200):
        words = [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(80)]
        if i % 4 == 0:
            item = rng.randrange(12)
            passage = list(items[item])
            if i % 8 == 0:
                for at in rng.sample(range(30), 4):
                    passage[at] = word()
                del passage[5]
            words[40:40] = [w.upper() + "," for w in passage]
            truth[i] = item
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(0, " ".join(items[0])), (99, None), (None, "x y z")], "item_id long, text string")
    for blocks in (20_000, 5):
        got = decontaminate(docs, table, block_items=blocks).collect()
        assert {r["doc_id"]: r["item_id"] for r in got if r["contaminated"]} == truth
        for r in got:
            if r["contaminated"]:
                full = plain_align(items[r["item_id"]], [w.strip(",").lower() for w in rows[r["doc_id"]][1].split()])
                assert r["score"] == pytest.approx(full / (MATCH * 30)) and r["item_id"] in r["item_ids"]


def test_a_hot_passage_hides_no_edited_copy(spark):
    """A third of the rows are one text that holds all items; other copies have every third word or a fifth of all edited."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(6))
    items = [[word() for _ in range(15)] for _ in range(4)]
    hot = [w for item in items for w in item]
    rows = [(i, " ".join(hot)) for i in range(120)]
    for i in range(120, 360):
        words = [word() for _ in range(60)]
        if i % 2:
            passage = list(items[rng.randrange(4)])
            for at in range(2, 15, 3) if i % 4 == 1 else rng.sample(range(15), 3):
                passage[at] = word()
            words[30:30] = passage
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()
    number = {w: n for n, w in enumerate({w for _, t in rows for w in t.split()} | set(hot))}
    coded = [np.array([number[w] for w in item]) for item in items]
    want = {i: [j for j, x in enumerate(coded) if align(x, np.array([number[w] for w in t.split()])) >= 15] for i, t in rows}
    assert sum(bool(x) for x in want.values()) == 240
    assert {r["doc_id"]: r["item_ids"] for r in got} == want


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_anchors_miss_no_alignment(monkeypatch, threshold):
    import tidemark.llm.decontaminate as module

    monkeypatch.setattr(module, "ANCHORS_AT_ONCE", 50)
    rng = np.random.RandomState(5)
    value = rng.randint(0, 2**63 - 1, 40).astype(np.uint64) * np.uint64(2)
    reached = 0
    for _ in range(40):
        items = [(i, value[rng.randint(0, 40, rng.randint(3, 14))]) for i in range(5)]
        texts = [value[rng.randint(0, 40, rng.randint(0, 40))] for _ in range(6)]
        for text in texts[:4]:
            item = items[rng.randint(0, 5)][1]
            text[:] = np.resize(np.insert(item, rng.randint(0, len(item), 2), value[:2]), len(text))
        frequency = dict(zip(value.tolist(), rng.random_sample(40) ** 4 / 10 + 1e-6))
        anchors = module.Anchors(items, frequency, 1e-6, threshold)
        bounds = np.cumsum([0, *map(len, texts)])
        hits = list(anchors.hits(np.concatenate(texts), bounds))
        for d, text in enumerate(texts):
            own = [(at - bounds[d], i, False) for at, i in hits if bounds[d] <= at < bounds[d + 1]]
            found = {i: s for i, s in module._scores(text, own, items, threshold) if s >= threshold - 1e-9}
            full = {i: align(item, text) / (MATCH * len(item)) for i, item in items}
            assert found == {i: s for i, s in full.items() if s >= threshold - 1e-9}
            reached += len(found)
    assert reached > 40


def test_contamination_of_odd_documents(odd, none, spark):
    items = spark.createDataFrame([(1, "beta gamma delta epsilon"), (2, "")], "item_id long, text string")
    out = decontaminate(odd, items)
    assert ids(out) == ODD_IDS
    assert sorted(r["doc_id"] for r in out.where("contaminated").collect()) == [1, 2, 2]
    assert decontaminate(none, items).collect() == []
    assert not decontaminate(odd, items.where("false")).where("contaminated").count()


def speech(rng, language, n):
    return " ".join(rng.choice(language) for _ in range(n))


TONGUES = {"en": ["the", "house", "with", "thing", "where"], "de": ["das", "haus", "mit", "dings", "wo"],
           "fr": ["la", "maison", "avec", "chose", "où"], "es": ["el", "casa", "con", "cosa", "dónde"]}


def test_language_of_pages(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        true = rng.choice(list(TONGUES))
        said = true if rng.random() < 0.9 else rng.choice(list(TONGUES))
        rows.append((i, f'<html class=x lang="{said}-XX">', f"https://www.{true}.example.{true}/p/{i}", speech(rng, TONGUES[true], 12), true))
    rows.append((900, "<html lang='fr'>", "https://www.fr.example.fr/", "ok", "fr"))  # says little: host and markup decide
    rows.append((901, None, None, "12345 %%%", "und"))
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, body string, truth string")
    out = language_id(pages, "page_id", "body", declared=declared_in_markup(F.col("html")), address=F.col("url"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert sum(got[r[0]]["language"] == r[4] for r in rows) >= 0.99 * len(rows)
    assert got[900]["language"] == "fr" and got[900]["kept"]
    assert got[901]["language"] == "und" and not got[901]["kept"]
    assert got[0]["host"] == rows[0][2].split("/")[2]


def test_language_of_odd_documents(odd, none):
    out = language_id(odd, declared=F.col("lang"), address=F.col("source"))
    assert ids(out) == ODD_IDS
    by_id = {r["doc_id"]: r for r in out.where("doc_id is not null").collect()}
    assert by_id[3]["language"] == by_id[4]["language"] == "und" and not by_id[3]["kept"]
    assert by_id[8]["host"] == "host.example.de" and by_id[7]["host"] == ""
    assert language_id(none, declared=F.col("lang"), address=F.col("source")).collect() == []
    assert ids(language_id(odd)) == ODD_IDS


def plain_score(rows, depth):
    """Context-tree weighting by recursion over dictionaries."""
    low = lambda t: t.encode().translate(UPPER)
    held = {d: zlib.crc32((str(d) if d is not None else "").encode()) % 7 == 2 for d, _ in rows}
    words, counts, children = Counter(), {}, {}

    def steps(text):
        data = bytes(depth) + low(text) + b"\0"
        for i in range(depth, len(data)):
            node = 1
            for bit in range(7, -1, -1):
                b = data[i] >> bit & 1
                yield data[i - depth : i], node, b
                node = node * 2 + b

    for d, t in rows:
        if not held[d]:
            words.update([*low(t).split(), b""])
            for context, node, b in steps(t):
                for k in range(depth + 1):
                    counts.setdefault((context[depth - k :], node), [0, 0])[b] += 1
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append(context)
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
    memo = {}

    def weight(context, node):
        if (context, node) not in memo:
            value = kt(*counts.get((context, node), (0, 0)))
            if len(context) < depth:
                value = np.logaddexp(value, sum(weight(c, node) for c in children.get((context, node), ()))) - math.log(2)
            memo[context, node] = value
        return memo[context, node]

    def p_one(context, node, k=0):
        here = context[depth - k :]
        a, b = counts.get((here, node), (0, 0))
        p = (b + 0.5) / (a + b + 1)
        if k == depth:
            return p
        stop = math.exp(kt(a, b) - math.log(2) - weight(here, node))
        return stop * p + (1 - stop) * p_one(context, node, k + 1)

    total, distinct = sum(words.values()), len(words)
    out = []
    for d, t in rows:
        own = [*low(t).split(), b""]
        base = sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in own)
        score = sum(math.log10(p if b else 1 - p) for c, n, b in steps(t) for p in [p_one(c, n)])
        out.append((d, held[d], len(own), sum(w in words for w in own), total, base, score))
    return out


@pytest.mark.parametrize("sent", [2**23, 0])
def test_scores(spark, sent):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Abc", "abd", "été", "xyz", "ab"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows.append((77, "never seen ÿ words\x00 here"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score(docs, sent_grams=sent).collect()}
    for d, *exact, base, score in plain_score(rows, 5):
        row = got[d]
        assert [row[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens")] == exact
        assert row["base_score"] == pytest.approx(base, rel=1e-9) and row["score"] == pytest.approx(score, rel=1e-6)


def test_scores_of_odd_documents(odd, none):
    out = lm_score(odd)
    assert ids(out) == ODD_IDS
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out.collect())
    assert lm_score(none).collect() == []


def test_nothing_to_learn_from(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_score(spark.createDataFrame([(only, "ab")], "doc_id long, text string")).first()
    assert row["held_out"] and row["n_known"] == 0 and row["score"] == pytest.approx(-24 * math.log10(2)) and row["base_score"] == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    kinds = {"good": (1, 0), "low": (0, 0), "toxic": (1, 1)}
    extra = {"good": [], "low": ["buy!!!", "click$$$"], "toxic": ["idiot", "moron"]}
    rows, labels = [], []
    for i in range(600):
        kind = rng.choices(list(kinds), [6, 2, 2])[0]
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(20, 60))] + [rng.choice(extra[kind]) for _ in range(6) if extra[kind]]
        rng.shuffle(words)
        rows.append((i, " ".join(words), kind))
        if i % 2:
            labels.append((i, *kinds[kind]))
    return spark.createDataFrame(rows, "doc_id long, text string, kind string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rates_meet_the_targets(labelled):
    docs, labels = labelled
    weights = {"good": 0.8, "low": 0.15, "toxic": 0.05}
    out = mix(docs, labels, weights, "good").join(docs.select("doc_id", "kind"), "doc_id").collect()
    right = sum(list(weights)[int(np.argmax(r["posteriors"]))] == r["kind"] for r in out)
    assert right >= 0.97 * len(out)
    totals = np.sum([np.array(r["posteriors"]) * r["tokens"] * r["rate"] for r in out], axis=0)
    assert totals / totals.sum() == pytest.approx(list(weights.values()), abs=0.01)
    good = [r for r in out if r["kind"] == "good" and r["posteriors"][0] > 0.9]
    assert min(r["rate"] for r in good) > 0.9 and np.mean([r["copies"] for r in good]) > 0.97
    assert all(0 <= r["rate"] <= 1 and r["copies"] in (0, 1) for r in out)


def test_rates_are_the_least_squares_solution(labelled):
    """Against plain projected gradient descent on the same posteriors."""
    docs, labels = labelled
    weights = {"good": 0.5, "low": 0.2, "toxic": 0.3}
    out = mix(docs, labels, weights, "good", max_rate=1.2, steps=50, tolerance=1e-9).orderBy("doc_id").collect()
    n, p = np.array([r["tokens"] for r in out], float), np.array([r["posteriors"] for r in out])
    share = np.array(list(weights.values()))
    target = share / share[0] * (n @ p)[0]
    metric = (p * n[:, None]).T @ p
    metric += np.eye(3) * metric.trace() * 1e-6
    r = np.ones(len(n))
    for _ in range(5000):
        r = np.clip(r - p @ np.linalg.solve(metric, (n * r) @ p - target), 0, 1.2)
    distance = lambda x: (e := (n * x) @ p - target) @ np.linalg.solve(metric, e)
    assert distance(np.array([x["rate"] for x in out])) == pytest.approx(distance(r), rel=1e-2, abs=1e-6 * n.sum())


def test_mixing_of_odd_documents(odd, none, labelled, spark):
    weights = {"good": 0.9, "low": 0.1, "toxic": 0.0}
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 1, 1), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    assert ids(mix(odd, labels, weights, "good")) == ODD_IDS
    assert mix(none, labels, weights, "good").collect() == []
    assert ids(mix(odd, labels.where("false"), weights, "good")) == ODD_IDS


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()}
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    kept, before = docs, {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, source)
        assert kept.columns == docs.columns
        now = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name == "ngram_join":
            assert now == {r[0] for r in plain_join([r for r in rows if r[0] in before]) if r[0] == r[2]}
        if name == "decontaminate":
            for d, t in rows:
                if d in before and any(x in t for x in items.values()):
                    assert d not in now
            assert len(now) >= 0.9 * len(before)
        before = now
    final = corpus_pipeline.run(spark, source)
    assert {r["doc_id"] for r in final.collect()} == before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontaminate", "mix_sources", "token_output"]


def test_pipeline_stands_odd_documents(spark, odd, tmp_path):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, "beta gamma delta epsilon")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert len({(r["doc_id"], r["text"]) for r in docs.collect()}) == docs.count()
    for rows in (docs, docs.where("false")):
        assert corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, rows, str(tmp_path)), str(tmp_path)).count() <= rows.count()
