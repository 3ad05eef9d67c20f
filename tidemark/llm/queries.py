"""Registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.language_id import language_id
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.lm_score import lm_score
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import ngram_join
from tidemark.llm.periodic_runs import periodic_runs
from tidemark.llm.prefix_trie import NO_ID, conversation_trie
from tidemark.llm.sentence_pieces import decode_pieces, encode_pieces
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.tokens import read_tokens, write_tokens
from tidemark.llm.warc import round_trip
from tidemark.storage import new_path

# Target shares of tokens, and the domain that keeps all of its own.
MIX_WEIGHTS = {"good": 0.95, "low": 0.05, "toxic": 0.0}
MIX_ANCHOR = "good"

Query = Callable[[SparkSession, str], DataFrame]

# SQL: the unsigned CRC-32 of ``c`` in decimal, bit by bit.
_CRC32 = """xor(list_reduce(
    flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384), 4294967295), 4294967295)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def _ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("th")


def _substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def _exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def tokens(docs: DataFrame) -> DataFrame:
    """Token shards of ``docs``, read back: where each document stands, and its checksum."""
    import public_tokenizers

    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(docs.sparkSession, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX_WEIGHTS, MIX_ANCHOR)
    shares = [F.get("posteriors", i).alias(f"p_{d}") for i, d in enumerate(MIX_WEIGHTS)]
    return rated.select("doc_id", "tokens", *shares, "rate", "copies")


def _lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def _language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(
        table(spark, sf_dir, "documents"), declared=F.col("lang"), address=F.col("source")
    ).drop("th")


def _decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents; about a tenth goes on with a period from some word on."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    h = F.crc32(docs["doc_id"].cast("bigint").cast("string"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", text.alias("text"), F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    n = F.greatest(F.size("words"), F.lit(1))
    a = F.col("g") % n
    plan = chosen.withColumn("a", a.cast("int")).withColumn(
        "p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    )
    word = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))
    ))
    return plan.select("doc_id", F.when(F.size("words") > 0, F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))


def _periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    ).selectExpr(
        "doc_id", "n_runs", "-best.start AS start", "best.length AS length", "-best.period AS period",
        "1000 * best.length div -best.period AS exponent_milli", "runs_sha256", "collapsed_sha256",
    )


# The most turns that a conversation of the trie query takes from another.
LENT_TURNS = 5


def _prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    cid = F.col("cid")
    head = F.when(cid != NO_ID, F.crc32(cid.cast("string")) % (LENT_TURNS + 1)).otherwise(0)
    return conversation_trie(table(spark, sf_dir, "conversations"), graft=(cid - cid % 100, head, LENT_TURNS)).drop("path")


def _sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": _line_dedup,
        "op2_warc": _warc,
        "op3_ngram_join": _ngram_join,
        "op4_substring_dedup": _substring_dedup,
        "op5_exact_dedup": _exact_dedup,
        "op6_mix_sources": _mix,
        "op7_tokens": _tokens,
        "op8_lm_score": _lm_score,
        "op9_language_id": _language_id,
        "op10_decontaminate": _decontaminate,
        "op11_periodic_runs": _periodic_runs,
        "op12_prefix_trie": _prefix_trie,
        "op13_sentence_pieces": _sentence_pieces,
    }


def oracle_sql() -> dict[str, str]:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return {
        "op1_line_dedup": f"""
            WITH lines AS (
                SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
                FROM documents),
            keyed AS (
                SELECT *, translate(trim(line, {space}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
            shared AS (
                SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
                GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
            marked AS (
                SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first AS dropped
                FROM keyed k LEFT JOIN shared s USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), ''))
                       AS kept_sha256
            FROM marked GROUP BY doc_id""",
        "op2_warc": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                              sha256(coalesce(html, '')) AS payload_digest FROM pages),
            f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit'
                        ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
            FROM p JOIN f USING (payload_digest)""",
        "op3_ngram_join": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, list_filter(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
                FROM documents),
            g AS (
                SELECT DISTINCT doc_id, unnest(
                    CASE WHEN len(words) >= 5 THEN
                        list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s
                FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
            c AS (
                SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
                FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
            l AS (
                SELECT x, y, c = nx.n AND c = ny.n AS same
                FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
                WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
            r AS (
                SELECT doc_id, doc_id AS root FROM documents
                UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
            SELECT doc_id,
                   least(doc_id, coalesce((SELECT min(y) FROM l WHERE x = doc_id AND same), doc_id)) AS set_id,
                   min(root) AS class_id, (SELECT count(*) FROM l WHERE x = doc_id) AS n_links,
                   min(root) = doc_id AS first
            FROM r GROUP BY doc_id""",
        "op4_substring_dedup": r"""
            WITH t AS (
                SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                           lambda x: x <> '') AS words FROM documents),
            w AS (
                SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t),
            s AS (
                SELECT doc_id, unnest(range(1, len(words) - 33)) AS pos,
                       unnest(list_transform(range(1, len(words) - 33),
                              lambda i: md5(array_to_string(words[i:i + 34], ' ')))) AS h
                FROM t WHERE len(words) >= 35),
            r AS (
                SELECT doc_id, pos FROM s JOIN
                    (SELECT h FROM s GROUP BY h HAVING count(*) > 1) USING (h)),
            m AS (
                SELECT w.*, last_value(r.pos IGNORE NULLS) OVER (
                    PARTITION BY w.doc_id ORDER BY w.pos) AS start
                FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.pos = w.pos),
            k AS (SELECT doc_id, pos, word, coalesce(pos - start < 35, false) AS gone FROM m)
            SELECT t.doc_id, len(any_value(t.words)) AS n_words, count(*) FILTER (gone) AS n_removed,
                   sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
            FROM t LEFT JOIN k USING (doc_id) GROUP BY t.doc_id""",
        "op5_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
            "op12_prefix_trie": f"""
            WITH t AS (
                SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
                FROM conversations),
            ids AS (SELECT c, {_CRC32} % 6 AS h, c - c % 100 AS b FROM (SELECT DISTINCT c FROM t)),
            taken AS (SELECT ids.c, h, least(h, count(t.c)) AS m FROM ids LEFT JOIN t ON t.c = ids.b GROUP BY ids.c, h),
            r AS (
                SELECT ids.c, t.pos + 1 AS d, role, text FROM ids JOIN t ON t.c = ids.b AND t.pos < ids.h
                UNION ALL
                SELECT t.c, t.pos - h + m + 1, role, text FROM t JOIN taken ON taken.c = t.c AND t.pos >= h),
            p AS (
                SELECT c, d, length(text) AS len,
                       sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY d)) AS path
                FROM r
                UNION ALL SELECT c, 0, 0, '' FROM ids),
            last AS (SELECT c, max(d) AS d FROM p GROUP BY c),
            nodes AS (
                SELECT path, any_value(p.d) AS d, min(c) AS rep, count(*) AS n, any_value(len) AS len,
                       sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)
                                       FILTER (p.d = last.d), '')) AS ends
                FROM p JOIN last USING (c) GROUP BY path),
            edges AS (
                SELECT nodes.path, p.path AS parent FROM nodes JOIN p ON p.c = nodes.rep AND p.d = nodes.d - 1),
            kids AS (SELECT parent AS path, count(*) AS k FROM edges GROUP BY parent),
            under AS (
                SELECT p.path, sum((n - 1) * nodes.len) AS saved, count(*) FILTER (k IS NULL) AS leaves
                FROM nodes LEFT JOIN kids USING (path) JOIN p ON p.c = nodes.rep AND p.d <= nodes.d
                GROUP BY p.path)
            SELECT nodes.rep AS conv_id, nodes.d AS depth, above.rep AS parent_conv_id, nodes.n AS n_convs,
                   coalesce(k, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
                   nodes.ends AS ends_sha256
            FROM nodes JOIN under USING (path) LEFT JOIN kids USING (path) LEFT JOIN edges USING (path)
            LEFT JOIN nodes AS above ON above.path = edges.parent""",
    }
