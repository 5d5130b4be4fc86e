"""The registered ``opN_*`` queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyweir.llm import chat, filter_audit, jaccard_join, langid, line_dedup, mixing, near_dedup, quality, resampling, secrets, sentencepiece_codec, topk, toxicity
from tallyweir.llm._common import read_table


def piece_model(path: str | None = None) -> bytes:
    """The model file's bytes; executors get them with the task."""
    return Path(path or public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.token_digests(read_table(spark, sf_dir, "documents"), piece_model())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_conversations(chat.with_probe(read_table(spark, sf_dir, "conversations"))))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(read_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decisions(read_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", read_table(spark, sf_dir, "labels"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_quality_rules, op3_toxicity, op4_top_k, op5_secrets, op6_chat, op7_mixing, op8_near_dedup, op9_line_dedup, op10_language, op11_filter_audit, op12_resampling, op13_jaccard_join)
}

_WORDS = r"[^\x20\x09-\x0D]+"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPE = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"

_COMPONENTS = """
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all({lower}, '{words}') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) >= {size} THEN list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: {runs}))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM worded
        ), items AS (
            SELECT doc_id, unnest(g) AS x FROM sets
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM common JOIN sets s ON s.doc_id = a JOIN sets t ON t.doc_id = b WHERE 100 * k >= {percent} * (len(s.g) + len(t.g) - k)
        ), reach AS (
            SELECT doc_id AS id, doc_id AS other FROM sets
            UNION
            SELECT r.id, l.other FROM reach r JOIN (SELECT a AS x, b AS other FROM links UNION ALL SELECT b, a FROM links) l ON l.x = r.other
        ), named AS (
            SELECT id, min(other) AS component_id FROM reach GROUP BY id
        )
"""


def _components(size: int, percent: int) -> str:
    """CTEs ``sets`` and ``named`` (id, component_id): documents whose sets of ``size`` words in a row have a Jaccard index of ``percent``."""
    runs = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return _COMPONENTS.format(lower=_LOWER.format("coalesce(text, '')"), words=_WORDS, runs=runs, size=size, percent=percent)


ORACLE_SQL: dict[str, str] = {
    "op4_top_k": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        ) WHERE rank <= 20
    """,
    "op6_chat": f"""
        WITH turns AS (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), told AS (
            SELECT conv_id, turn, role AS o_role, text AS o_text, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns
        ), shown AS (
            SELECT *, {_ESCAPE.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")} AS e_role, {_ESCAPE.format("text")} AS e_text FROM told
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, o_role NULLS FIRST, o_text NULLS FIRST)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, o_role NULLS FIRST, o_text NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length('<|im_start|>' || e_role || chr(10) || e_text || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
        FROM shown GROUP BY conv_id
    """,
    "op7_mixing": """
        WITH counts AS (
            SELECT source, count(*) AS n, pow(count(*), 0.5) AS w FROM documents GROUP BY source
        ), rates AS (
            SELECT source, (sum(n) OVER () * w) / (sum(w) OVER () * n) AS rate FROM counts
        ), steps AS (
            SELECT source, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rates
        ), tails AS (
            SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS tail FROM steps
        ), drawn AS (
            SELECT *, (('0x' || substr(md5('poisson-1|' || coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents
        ), counted AS (
            SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM tails t WHERE t.source IS NOT DISTINCT FROM d.source AND t.tail < d.u) AS copies FROM drawn d
        )
        SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INTEGER AS copy FROM counted WHERE copies > 0
    """,
    "op8_near_dedup": _components(3, 85) + """
        SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, n.component_id, s.doc_id = n.component_id AS kept FROM sets s JOIN named n ON n.id = s.doc_id
    """,
    "op11_filter_audit": f"""
        WITH marks AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
        ), texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents
        ), failed AS (
            SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
                (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
                + 4 * (100 * length(regexp_replace(t.t, '[^A-Z]+', '', 'g')) > 5 * length(t.t))::INT
                + 8 * regexp_matches(t.t, '[#$%&*|]')::INT
                + 16 * coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t.t), false)::INT AS mask
            FROM texts t LEFT JOIN marks m ON m.doc_id = t.doc_id
        ), counted AS (
            SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM failed GROUP BY ALL
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
        ), orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), steps AS (
            SELECT filter_order, k::INTEGER AS step, 1 << (ascii(substr(filter_order, k, 1)) - 65) AS own,
                list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS prior
            FROM orders, (SELECT unnest(range(1, 6)) AS k)
        ), facts AS (
            SELECT part, filter_order, step, own, coalesce(prior, 0)::INT AS prior, mask, n, g, x FROM counted, steps
        ), removals AS (
            SELECT part, own, sum(n) AS shapley FROM facts WHERE mask & own <> 0 AND mask & prior = 0 GROUP BY ALL
        )
        SELECT f.part, filter_order, step,
            coalesce(sum(n) FILTER (mask & (f.own | prior) = 0), 0)::BIGINT AS kept,
            coalesce(sum(n) FILTER (mask & f.own <> 0 AND mask & prior = 0), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (mask & f.own <> 0 AND mask & prior <> 0), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (mask = f.own), 0)::BIGINT AS unique_fails,
            coalesce(sum(g) FILTER (mask & f.own <> 0 AND mask & prior = 0), 0)::BIGINT AS good_lost,
            coalesce(sum(x) FILTER (mask & f.own <> 0 AND mask & prior = 0), 0)::BIGINT AS toxic_lost,
            coalesce(any_value(r.shapley), 0)::BIGINT AS shapley
        FROM facts f LEFT JOIN removals r ON r.part = f.part AND r.own = f.own GROUP BY f.part, filter_order, step
    """,
    "op12_resampling": f"""
        WITH codes AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
            FROM (SELECT unnest(range(256)) AS i)
        ), texts AS (
            SELECT 's' AS side, doc_id, row_number() OVER () AS row_no, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS w FROM documents
            UNION ALL SELECT 't', NULL, row_number() OVER (), regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') FROM benchmark
        ), words AS (
            SELECT side, row_no, unnest(w) AS word FROM texts
        ), hexed AS (
            SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)
        ), hashed AS (
            SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM hexed, codes
        ), counts AS (
            SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM words JOIN hashed USING (word) GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts
        ), sums AS (
            SELECT row_no, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
            FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 's' GROUP BY row_no
        ), scored AS (
            SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM (SELECT * FROM texts WHERE side = 's') LEFT JOIN sums USING (row_no)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored
        )
        SELECT doc_id, n_features::BIGINT AS n_features, weight, score, (CASE WHEN n_features >= 20 AND r <= able // 10 THEN r END)::BIGINT AS rank FROM placed
    """,
    "op13_jaccard_join": _components(5, 80) + """
        SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, n.component_id FROM sets s JOIN named n ON n.id = s.doc_id
    """,
}
