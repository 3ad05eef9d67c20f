"""Language posteriors and domain posteriors against plain dictionaries."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.language_id import declared_in_markup, language_id
from tidemark.llm.mixing import mix

from .conftest import ids

LANGUAGES = ("en", "de", "fr", "es")


def trigram_buckets(text):
    data = b" " + text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) + b"  "
    codes = [data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2)]
    return [(c * 0x9E3779B1 % 2**32) >> 16 for c in codes]


def normalised(logs):
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    return [w / sum(weights) for w in weights]


def plain_posteriors(rows, tempering=0.25, strength=20.0):
    """``rows``: id, text, declared, host, suffix; every document with a known declaration trains."""
    k = len(LANGUAGES)
    counts = {name: Counter() for name in LANGUAGES}
    for _, text, declared, _, _ in rows:
        if declared in counts:
            counts[declared].update(trigram_buckets(text))
    totals = {name: sum(c.values()) + 0.5 * 2**16 for name, c in counts.items()}
    text_logs, q = {}, {}
    for did, text, *_ in rows:
        buckets = trigram_buckets(text)
        logs = [tempering * sum(math.log((counts[n][b] + 0.5) / totals[n]) for b in buckets) for n in LANGUAGES]
        text_logs[did] = [*logs, tempering * len(buckets) * math.log(2.0**-16)]
        q[did] = normalised(text_logs[did])
    n = len(rows)
    mixed = [(sum(q[d][i] for d in q) + 1) / (n + k + 1) for i in range(k + 1)]
    stated = defaultdict(lambda: [0.0] * (k + 1))
    for did, _, declared, _, _ in rows:
        stated[declared] = [a + b for a, b in zip(stated[declared], q[did])]
    norm = [sum(stated[name][i] for name in LANGUAGES) + k for i in range(k + 1)]
    out = {}
    for did, _, declared, host, suffix in rows:
        others_s = [r[0] for r in rows if r[4] == suffix and r[0] != did]
        others_h = [r[0] for r in rows if r[3] == host and r[0] != did]
        of_suffix = [(sum(q[o][i] for o in others_s) + strength * mixed[i]) / (len(others_s) + strength) for i in range(k + 1)]
        of_host = [(sum(q[o][i] for o in others_h) + strength * of_suffix[i]) / (len(others_h) + strength) for i in range(k + 1)]
        told = [math.log((stated[declared][i] + 1) / norm[i]) if declared in LANGUAGES else 0.0 for i in range(k + 1)]
        out[did] = normalised([a + b + math.log(c) for a, b, c in zip(text_logs[did], told, of_host)])
    return out


WORDS = {
    "en": "the of and house with water thing people".split(),
    "de": "der und nicht haus wasser mit leute schön".split(),
    "fr": "le et dans maison eau avec été gens".split(),
    "es": "el y casa agua con niño pueblo gente".split(),
}


def pages_of(rnd, n=120):
    rows = []
    for i in range(n):
        name = rnd.choice(LANGUAGES)
        text = " ".join(rnd.choice(WORDS[name]) for _ in range(rnd.randint(1, 6)))
        declared = rnd.choice([name, name, "en", "xx", ""])
        suffix = rnd.choice(["com", {"en": "uk"}.get(name, name)])
        rows.append((i, text, declared, f"h{rnd.randrange(4)}.{suffix}", suffix))
    return rows


def check_language(got, want):
    names = [*LANGUAGES, "und"]
    assert len(got) == len(want)
    for r in got:
        best = max(range(5), key=want[r["doc_id"]].__getitem__)
        assert r["language"] == names[best]
        assert r["posterior"] == pytest.approx(want[r["doc_id"]][best], rel=2e-3)
        assert r["kept"] == (best < 4 and want[r["doc_id"]][best] >= 0.5)


def test_language_posteriors(spark):
    rows = pages_of(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, suffix string")
    found = language_id(docs, declared=F.col("lang"), address=F.concat(F.lit("https://"), "source", F.lit(":80/x?y")))
    check_language(found.collect(), plain_posteriors(rows))


def test_language_of_pages_by_markup_and_suffix(spark):
    """Raw pages: the declaration stands in the markup, host and suffix in the address."""
    rows = pages_of(random.Random(8))
    html = {i: f"<!DOCTYPE html><HTML class='a' Lang={d!r}>" if d else "<html>" for i, _, d, _, _ in rows}
    pages = spark.createDataFrame(
        [(i, f"http://me@{host}/p", html[i] + f"<p>{text}</p>") for i, text, _, host, _ in rows], "page_id long, url string, html string"
    )
    found = language_id(pages, "page_id", "html", declared_in_markup(F.col("html")), F.col("url"))
    plain = [(i, html[i] + f"<p>{text}</p>", d, host, suffix) for i, text, d, host, suffix in rows]
    check_language(found.collect(), plain_posteriors(plain))


def plain_domains(spark, texts, labels, domains):
    """Posteriors of a naive Bayes over the same buckets, from counts in dictionaries."""
    words = {i: [w for w in (t or "").split() if w] for i, t in texts.items()}
    distinct = sorted({w for ws in words.values() for w in ws})
    frame = spark.createDataFrame([(w, w) for w in distinct], "w string, text string")
    bucket = {r["w"]: {"whole": r["whole"], "ending": r["ending"]} for r in mixing._words(frame).collect()}
    learned = {(d, texts[i]): words[i] for i, d in labels.items()}
    per = Counter(d for d, _ in learned)
    total = sum(per.values())
    scores = {i: [math.log((per[d] + 1) / (total + len(domains))) for d in domains] for i in texts}
    for kind in ("whole", "ending"):
        holding, shares = Counter(), Counter()
        for (d, _), ws in learned.items():
            holding.update({(d, bucket[w][kind]) for w in ws})
            shares.update((d, bucket[w][kind]) for w in ws)
        seen = {b for _, b in holding}
        together = {b: sum(holding[d, b] for d in domains) for b in seen}
        expected = {(d, b): together[b] / total * per[d] for b in seen for d in domains}
        clear = {b for b in seen if any(abs(holding[d, b] - expected[d, b]) > mixing.CLEAR * math.sqrt(expected[d, b] + 1) for d in domains)}

        def weight(d, b):
            if b not in clear:
                own = sum(n for (x, _), n in shares.items() if x == d)
                other = sum(n for (x, y), n in shares.items() if x == d and y not in clear)
                return math.log((other + mixing.SHRINK) / (own + mixing.SHRINK))
            if abs(holding[d, b] - expected[d, b]) > mixing.CLEAR * math.sqrt(expected[d, b] + 1):
                return math.log((holding[d, b] + mixing.SHRINK) / (expected[d, b] + mixing.SHRINK))
            return 0.0

        known = {}
        for i, ws in words.items():
            for n, d in enumerate(domains):
                for w in ws:
                    b = bucket[w][kind]
                    if (d, b) not in known:
                        known[d, b] = weight(d, b)
                    scores[i][n] += known[d, b]
    return {i: normalised(s) for i, s in scores.items()}


def test_domain_posteriors(spark):
    rnd = random.Random(12)
    domains = ["good", "low", "toxic"]
    own = {"good": "clear careful reasoned text".split(), "low": "buy cheap click now".split(), "toxic": "awful stupid hate you".split()}
    shared = "the a of to in word thing day".split()
    texts, labels = {}, {}
    for i in range(600):
        d = rnd.choice(domains)
        texts[i] = " ".join(rnd.choice(own[d] if rnd.random() < 0.4 else shared) for _ in range(rnd.randint(1, 30)))
        if rnd.random() < 0.8:
            labels[i] = d
    texts[600], texts[601] = None, "unseen entirely"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame(list(labels.items()), "doc_id long, domain string")
    got = mix(docs, table, {"good": 0.9, "low": 0.1, "toxic": 0.0}, "good", domain=F.col("domain")).collect()
    want = plain_domains(spark, texts, labels, domains)
    assert len(got) == len(texts)
    for r in got:
        assert r["posteriors"] == pytest.approx(want[r["doc_id"]], abs=2e-3)
    assert sum(max(w) > 0.9 for w in want.values()) > 300  # the words do tell


def test_pipeline_stages_of_no_documents(spark, none, tmp_path):
    """Every stage stands a table without rows, and gives one."""
    import corpus_pipeline

    spark.createDataFrame([(1, "some benchmark text to find")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.collect() == [], name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == none.columns
    assert ids(none) == []
