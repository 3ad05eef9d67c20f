"""Round trips: web archives and token shards."""

import gzip
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import tokens as token_module
from tidemark.llm.frames import NO_ID, texts
from tidemark.llm.tokens import document_ids, read_tokens, sampled_pieces, write_tokens
from tidemark.llm.warc import parse_records, read_warc, round_trip, unchunked, write_warc

from .conftest import ODD_IDS, ids

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pages(spark):
    body = "<p>é " + "WARC/1.1\r\n\r\n" * 20 + "</p>"
    rows = [
        (5, "http://a/5", body), (3, "http://a/3", body), (9, None, body), (1, "http://a/1 \r\nX: y", "short"),
        (2, "http://a/2", "short"), (4, "http://a/4", None), (6, "http://a/6", ""), (7, "http://a/7", "ß" * 40_000),
        (8, "http://a/8", "ß" * 40_000), (None, "http://a/n", "z" * 99), (10, "u", "y" * 100), (10, "u", "y" * 100), (11, "u", "y" * 100),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))


def plain_records(rows):
    rows = [(NO_ID if p is None else p, (h or "").encode()) for p, _, h, _ in rows]
    out = []
    for page, body in rows:
        first = min(p for p, b in rows if b == body)
        revisit = len(body) >= 100 and page != first
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 7, "segment_bytes": 256, "records_per_file": 40}])
def test_pages_come_back(spark, pages, tmp_path, options):
    out = round_trip(pages, str(tmp_path / "w"), **options)
    got = [(NO_ID if r[0] is None else r[0], *r[1:]) for r in out.collect()]
    assert sorted(got, key=str) == plain_records(pages.collect())
    payloads = {r["page_id"]: bytes(r["payload"]) for r in read_warc(spark, str(tmp_path / "w")).where("record_type = 'response'").collect()}
    for row in pages.collect():
        key = NO_ID if row["page_id"] is None else row["page_id"]
        if key in payloads:
            assert payloads[key] == (row["html"] or "").encode()


def test_archives_follow_the_format(pages, tmp_path):
    write_warc(pages, str(tmp_path / "w"), segment_bytes=20_000)
    kinds = []
    for part in (tmp_path / "w").glob("part-*"):
        for headers, block in parse_records(gzip.decompress(part.read_bytes())):
            kinds.append(headers["warc-type"])
            assert len(block) == int(headers["content-length"])
            if headers["warc-type"] == "continuation":
                assert headers["warc-segment-origin-id"] and int(headers["warc-segment-number"]) > 1
    assert kinds.count("continuation") >= 4 and kinds.count("revisit") == 4


def test_archives_are_cut_by_bytes(spark, pages, tmp_path):
    docs = spark.range(40).selectExpr("id AS page_id", "'http://a' AS url", "repeat(char(97 + id % 26), 30000 + id) AS html").coalesce(1)
    write_warc(docs, str(tmp_path / "w"), segment_bytes=4096, archive_bytes=50_000)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 20 and max(sizes) <= 50_000
    assert read_warc(spark, str(tmp_path / "w")).where("length(payload) = 30000 + page_id").count() == 40


def test_a_missing_segment_is_noticed(spark, pages, tmp_path):
    write_warc(pages.where("page_id = 7").coalesce(1), str(tmp_path / "w"), records_per_file=1)
    parts = sorted((tmp_path / "w").glob("part-*"))
    assert len(parts) > 3
    parts[2].unlink()
    with pytest.raises(Exception, match="incomplete segments"):
        read_warc(spark, str(tmp_path / "w")).collect()


def test_no_pages(pages, tmp_path):
    assert round_trip(pages.where("false"), str(tmp_path / "w")).collect() == []


def test_chunked_framing():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert unchunked(head + b"3;x=1\r\nabc\r\n2\r\n\r\n\r\n0\r\n\r\n") == b"abc\r\n"
    assert unchunked(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    with pytest.raises(ValueError):
        unchunked(head + b"5\r\nabc\r\n0\r\n\r\n")


def plain_tokens(rows):
    tool = Tokenizer.from_file(VOCABULARY)
    out = {}
    for did, text in rows:
        ids_ = np.array([*tool.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.setdefault(NO_ID if did is None else did, []).append((len(ids_), zlib.crc32(ids_.tobytes())))
    return out


def check_tokens(df, path):
    want = plain_tokens([(r["doc_id"], r["text"]) for r in df.collect()])
    rows = read_tokens(df.sparkSession, path).collect()
    rows = sorted((r["start"], NO_ID if r["doc_id"] is None else r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in rows)
    before, got = 0, {}
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)
    for start, did, n, crc in rows:
        assert start == before
        before += n
        got.setdefault(did, []).append((n, crc))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 500, "partition_bytes": 2000, "dictionary_slices": 60, "dictionary_bytes": 1024}])
def test_tokens_come_back(spark, tmp_path, options):
    text = F.concat_ws(" ", F.lit("some words of text"), F.sha2(F.col("id").cast("string"), 256), F.repeat(F.lit("again "), F.col("id").cast("int") % 50))
    docs = spark.range(200).select(((F.col("id") * 37) % 200).alias("doc_id"), text.alias("text"))
    write_tokens(docs, str(tmp_path / "t"), VOCABULARY, **options)
    check_tokens(docs, str(tmp_path / "t"))
    if options:
        dictionary = next((tmp_path / "t/dictionary").glob("part-*")).read_bytes()[:-1]
        shards = sorted((tmp_path / "t/shards").glob("part-*"))
        assert dictionary and len(shards) > 5
        content = shards[0].read_bytes()
        row = docs.where("doc_id = 0").first()
        assert document_ids(content, dictionary, 0)[:-1].tolist() == Tokenizer.from_file(VOCABULARY).encode(row["text"]).ids
        with pytest.raises(ValueError):
            document_ids(content, b"other", 0)
        with pytest.raises(KeyError):
            document_ids(content, dictionary, 199)


def test_tokens_of_odd_documents(odd, none, tmp_path):
    write_tokens(odd, str(tmp_path / "t"), VOCABULARY)
    check_tokens(odd, str(tmp_path / "t"))
    assert ids(read_tokens(odd.sparkSession, str(tmp_path / "t"))) == ODD_IDS
    write_tokens(none, str(tmp_path / "n"), VOCABULARY)
    assert read_tokens(odd.sparkSession, str(tmp_path / "n")).collect() == []


@pytest.mark.parametrize("run_chars, known", [(1_000_000, 16_000_000), (500, 16_000_000), (3000, 2000), (1, 0)])
def test_words_give_the_ids_of_whole_texts(monkeypatch, run_chars, known):
    import random

    for name, value in {"RUN_CHARS": run_chars, "KNOWN_BYTES": known, "LIBRARY_CHARS": 100}.items():
        monkeypatch.setattr(token_module, name, value)
    rng = random.Random(3)
    some_texts = ["", " ", "a", "don't 'tis I'll", "a\tb", "é²³ 1/2 ½", "日本語", "x  y", "\n\na b \n c", "<|endoftext|> hi", "ª \xa0 b"]
    some_texts += ["a <|endoftext|> b", "a<|endoftext|>b  <|endoftext|>", " a", "a ", "\u3000 a \u2003b", "😀 😀x 😀"]
    some = [*"ab 'ts\n,.1é", " ", " ", "\xa0", "\u3000", "<|endoftext|>", " word", " the"]
    some_texts += ["".join(rng.choice(some) for _ in range(rng.randint(1, 40))) for _ in range(3000 if run_chars > 1 else 300)]
    tool = token_module.Encoder(VOCABULARY)
    plain = Tokenizer.from_file(VOCABULARY)
    assert tool.by_word
    for _ in range(2):  # the second time with words that are known
        ids, counts = tool.encode(some_texts)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in some_texts]


def test_special_tokens_are_those_of_the_library(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>")], "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "t"), VOCABULARY)
    check_tokens(docs, str(tmp_path / "t"))
    rows = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read_tokens(spark, str(tmp_path / "t")).collect()}
    assert rows == {1: [64, 220, 50256, 275, 2], 2: [50256, 2]}


def test_the_dictionary_sees_long_texts_and_no_more_than_the_sample(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 1000 = 7, repeat('long text ', 300000), 'short') AS text")
    sizes = [len(r["text"]) for r in sampled_pieces(texts(docs), 200).collect()]
    # 3 texts of 3,000,000 characters make 552 of 3549 pieces.
    assert len(sizes) == 200 and max(sizes) == 16_384 and 10 <= sum(n > 5 for n in sizes) <= 60
    assert sampled_pieces(texts(docs), 100_000).count() == 3549 and sampled_pieces(texts(docs.where("false")), 9).count() == 0


def test_texts_without_anything_to_train_on(spark, tmp_path):
    docs = spark.createDataFrame([(3, None), (1, ""), (2, None)], "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "t"), VOCABULARY)
    check_tokens(docs, str(tmp_path / "t"))
    some = docs.unionByName(spark.createDataFrame([(4, "words")], docs.schema))
    write_tokens(some, str(tmp_path / "u"), VOCABULARY, dictionary_slices=0)
    check_tokens(some, str(tmp_path / "u"))
