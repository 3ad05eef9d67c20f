"""Periodic runs, the prefix trie and sentence pieces, against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import queries as corpus
from tidemark.llm import sentence_pieces
from tidemark.llm.periodic_runs import find_runs, periodic_runs
from tidemark.llm.prefix_trie import conversation_trie
from tidemark.llm.sentence_pieces import Model, check_model, decode_pieces, encode_pieces

from .conftest import LONG, ODD_IDS, ids

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


# -- periodic runs ---------------------------------------------------------------------


def all_runs(w, least):
    """Every run: each lag, each stretch, smallest periods only."""
    found = set()
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if i > s and length >= max(least, 2 * q):
                if not any(all(w[s + k] == w[s + k + p] for k in range(length - p)) for p in range(1, q)):
                    found.add((s, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rnd):
    n = rnd.randint(0, 70)
    kinds = rnd.choice([1, 2, 2, 3, 5])
    w = [rnd.randrange(kinds) for _ in range(n)]
    if rnd.random() < 0.5 and n > 4:
        a = rnd.randrange(n)
        p = rnd.randint(1, max(1, (n - a) // 2))
        for i in range(a, n):
            w[i] = w[a + (i - a) % p]
    elif rnd.random() < 0.3:
        x, y = [0], [0, 1]
        while len(y) < n:
            x, y = y, y + x
        w = y[:n]
    return w


def test_runs_of_many_small_documents():
    rnd = random.Random(11)
    for _ in range(700):
        docs = [periodic_words(rnd) for _ in range(rnd.randint(1, 4))]
        least = rnd.choice([12, 12, 2, 3, 5, 6, 7, 20, 40])
        bounds = np.cumsum([0, *map(len, docs)])
        found = find_runs(np.array(sum(docs, []), np.int64), bounds, least)
        want = [(s + int(b), n, q) for w, b in zip(docs, bounds) for s, n, q in all_runs(w, least)]
        assert list(zip(*(c.tolist() for c in found))) == want


@pytest.mark.parametrize(
    "words, want",
    [
        ([0] * 200_000, [(0, 200_000, 1)]),
        ([0] * 5000 + [1] + [0] * 5000, [(0, 5000, 1), (5001, 5000, 1)]),
        ([i % 7000 for i in range(14_000)], [(0, 14_000, 7000)]),
        ([i % 7001 for i in range(14_001)], []),
    ],
)
def test_runs_of_long_documents(words, want):
    found = find_runs(np.array(words), np.array([0, len(words)]))
    assert [r for r in zip(*(c.tolist() for c in found))] == want


def collapsed(words, runs):
    return " ".join(
        w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)
    )


def test_periodic_runs_of_odd_documents(spark, odd, none):
    rows = periodic_runs(odd).collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x)) == ODD_IDS
    by_id = {r["doc_id"]: r for r in rows}
    # The long text has a period of 14997 words and twice that many words.
    assert [tuple(r) for r in by_id[5]["runs"]] == [(0, 30_000, 14_997)]
    assert by_id[5]["kept"] == " ".join(LONG.split(" ")[:14_997]) and by_id[6]["kept"].endswith(" tail")
    assert by_id[3]["n_words"] == by_id[4]["n_words"] == 0 and by_id[3]["kept"] == "" and by_id[3]["runs"] == []
    assert by_id[7]["kept"] == " ".join(words_of("Été ñandú ß 日本語 \t\r\n  \x0b x\n\nline of ten chars\nLINE OF TEN CHARS  "))
    assert periodic_runs(none).collect() == []


def test_periodic_runs_in_several_slices(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(f"w{x}" for x in periodic_words(rnd)) for _ in range(200)] + ["a b " * 200_000, "\t ", "x" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in periodic_runs(docs).collect():
        words = words_of(texts[r["doc_id"]])
        if len(words) < 1000:
            runs = all_runs(words, 12)
        else:
            runs = [(0, len(words), 2)]
        assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(words)
        assert r["kept"] == (collapsed(words, runs) if len(words) < 1000 else "a b")


def test_periodic_query_against_its_definition(spark, tmp_path):
    rnd = random.Random(3)
    texts = {i: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 60))) for i in range(300)}
    texts[1], texts[2] = None, ""
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    for r in corpus.queries()["op11_periodic_runs"](spark, str(tmp_path)).collect():
        words = words_of(texts[r["doc_id"]])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = all_runs(words, 12)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 10


# -- prefix trie -------------------------------------------------------------------------


def plain_trie(conversations):
    """Nodes by path, from conversations as lists of (role, text)."""
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    rows = []
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        rows.append((
            min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside), len(children[path]),
            sum(not children[p] for p in below), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def some_conversations(rnd, n):
    return {
        c * 7 + rnd.randrange(7): [(rnd.choice(["u", "a"]), rnd.choice(["", "x", "yy", "é日"])) for _ in range(rnd.choice([1, 2, 3, 3, 9]))]
        for c in range(n)
    }


@pytest.mark.parametrize("limits", [{}, {"shard_conversations": 5, "shard_turns": 40}, {"shard_conversations": 1}])
def test_trie_of_random_conversations(spark, limits):
    plain = some_conversations(random.Random(9), 120)
    hot = {c: [("u", "same"), ("a", "all")] for c in range(1000, 1100)}  # copies of one conversation
    plain |= hot
    rows = [(c, t, *turn) for c, turns in plain.items() for t, turn in enumerate(turns)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversation_trie(frame, **limits)
    assert sorted(map(tuple, found.select(COLUMNS).collect()), key=str) == plain_trie(plain)
    assert found.select("path").distinct().count() == found.count()


def test_trie_query_with_grafts(spark, tmp_path):
    rnd = random.Random(4)
    own = {}
    for c in [0, 1, 2, 3, 99, 100, 101, 150, 250, 251, 700, 705, 799, 1200, 1201]:
        own[c] = [(rnd.choice(["u", "a"]), rnd.choice(["x", "yy", "z z"])) for _ in range(rnd.randint(1, 7))]
    own |= {c: [("u", "x")] for c in range(210, 220)}  # no conversation 200: some are left without turns
    rows = [(c, t, *turn) for c, turns in own.items() for t, turn in enumerate(turns)]
    rows = [(c, None if t == 0 else t, r, x) for c, t, r, x in rows]  # a null turn comes first
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not turns for turns in rebuilt.values())
    found = corpus.queries()["op12_prefix_trie"](spark, str(tmp_path))
    assert sorted(map(tuple, found.select(COLUMNS).collect()), key=str) == plain_trie(rebuilt)


def test_trie_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, cid long, pos long, key string, path string"
    rest = (1, 2, "k", "p")
    rows = [
        (1, 0, None, None, *rest), (1, 0, None, None, *rest),  # a repeated row is another turn
        (2, None, "", "", *rest), (2, 5, "", "long " * 20_000, *rest),
        (None, 0, "", "", *rest), (None, 1, "u", None, *rest),
    ]
    found = conversation_trie(spark.createDataFrame(rows, schema)).select(COLUMNS).collect()
    empty, last = ("", ""), 2**63 - 1
    want = plain_trie({1: [empty, empty], 2: [empty, ("", "long " * 20_000)], last: [empty, ("u", "")]})
    null = lambda x: None if x == last else x
    wanted = [(null(r[0]), r[1], null(r[2]), *r[3:7]) for r in want]
    assert sorted([tuple(r)[:7] for r in found], key=str) == sorted(wanted, key=str)
    alone = [r["ends_sha256"] for r in found if r["conv_id"] is None]
    assert alone == [hashlib.sha256(b"null").hexdigest()]
    assert conversation_trie(spark.createDataFrame([], schema)).collect() == []


# -- sentence pieces -----------------------------------------------------------------------

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SNIPPETS = [
    *"abehtniors10x", " ", "  ", "   ", "▁", "\n", "\t", "é", "日", "本", "😀", "\x00", "aa", "the", "<s>", "<0x41>", "\u0300", "ß", " the", "ing", "ер",
]


def random_texts(n, seed=2):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(SNIPPETS) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    letters = "".join(rnd.choice("etaoinshrdlu") for _ in range(20_000))
    return texts + [" ", "  ", "", "▁", " ▁", " " * 100, "a" * 5000, "ab" * 3000, letters, "日本語" * 500]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("run_chars", [1_000_000, 50])
def test_pieces_like_the_library(library, monkeypatch, run_chars):
    monkeypatch.setattr(sentence_pieces, "RUN_CHARS", run_chars)
    texts = random_texts(4000)
    ids, sizes = Model(PIECES).encode(texts)
    want = library.encode(texts, num_threads=1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert Model(PIECES).decode(ids, sizes).to_pylist() == library.decode(want)


def test_decoding_any_ids(library):
    rnd = random.Random(8)
    lists = [[rnd.choice([rnd.randrange(32_000), rnd.randrange(3, 259)]) for _ in range(rnd.randint(0, 20))] for _ in range(3000)]
    lists += [[1], [1, 259], [0], [2, 1, 29871, 29871]]
    flat, sizes = np.array(sum(lists, [])), np.array([len(x) for x in lists])
    assert Model(PIECES).decode(flat, sizes).to_pylist() == library.decode(lists)


def test_pieces_of_odd_documents(spark, odd, none, library):
    found = encode_pieces(odd, PIECES)
    assert ids(found) == ODD_IDS
    text = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in decode_pieces(found, PIECES).collect():
        if r["doc_id"] is not None:
            assert r["ids"] == library.encode(text[r["doc_id"]]) and r["decoded"] == library.decode(r["ids"])
    assert encode_pieces(none, PIECES).collect() == []
    given = spark.createDataFrame([(1, None), (2, []), (3, [library.piece_to_id("▁")])], "n int, ids array<int>")
    assert [tuple(r) for r in decode_pieces(given, PIECES).orderBy("n").select("n", "decoded").collect()] == [(1, ""), (2, ""), (3, "")]
    with pytest.raises(Exception, match="outside the model"):
        decode_pieces(given.withColumn("ids", F.array(F.lit(32_000))), PIECES).collect()


def test_pieces_query_against_the_library(spark, tmp_path, library):
    texts = {i: t for i, t in enumerate(random_texts(200, seed=6))} | {5000: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in corpus.queries()["op13_sentence_pieces"](spark, str(tmp_path)).collect():
        want = library.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "none.model"
    path.write_bytes(b"")
    with pytest.raises(ValueError):
        check_model(str(path))
