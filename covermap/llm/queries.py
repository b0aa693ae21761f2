"""The registered queries of the operators, each over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from covermap.llm.collocations import collocations
from covermap.llm.common import table
from covermap.llm.decontamination import benchmark_leaks
from covermap.llm.exact_dedup import exact_groups
from covermap.llm.lexical_search import search
from covermap.llm.license_scan import scan_licenses
from covermap.llm.lm_scoring import scored_documents
from covermap.llm.mixing import taken_words
from covermap.llm.secret_scan import scan_secrets
from covermap.llm.simhash import near_duplicates
from covermap.llm.suffix_dedup import remove_repeats
from covermap.llm.token_ids import written_ids
from covermap.llm.toxicity import toxic_scores
from covermap.llm.url_filters import judge_urls


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_ids(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {query.__name__: query for query in (
    op1_benchmark_decontamination, op2_url_filters, op3_simhash, op4_toxicity, op5_token_ids, op6_mixing, op7_secret_scan, op8_suffix_dedup, op9_exact_dedup, op10_lm_scoring,
    op11_collocations, op12_license_scan, op13_lexical_search)}

ORACLE_SQL = {
    "op9_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM documents),
        grouped AS (
            SELECT doc_id, sha256(normal) AS text_sha256, min(doc_id) OVER (PARTITION BY normal) AS keep_id,
                   count(*) OVER (PARTITION BY normal) AS group_size
            FROM texts)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped""",
    "op11_collocations": r"""
        WITH lowered AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
        lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda word: word <> '') AS words FROM pieces),
        grams AS (
            SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
            FROM lists, (SELECT unnest(range(1, 6)) AS k) AS sizes WHERE len(words) >= k),
        counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
        frequent AS (SELECT * FROM counts WHERE f >= 100),
        inner_parts AS (
            SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' ') AS phrase, max(f) AS longer
            FROM frequent, (SELECT unnest(range(1, 5)) AS i) AS starts, (SELECT unnest(range(2, 5)) AS s) AS sizes
            WHERE k > 2 AND s < k AND i + s - 1 <= k GROUP BY ALL),
        left_over AS (
            SELECT frequent.* FROM frequent LEFT JOIN inner_parts USING (lang, phrase)
            WHERE k > 1 AND (longer IS NULL OR 100 * longer < 100 * f)),
        cuts AS (
            SELECT c.lang, c.phrase, c.f AS a, t.n, cut, h.f AS l, r.f AS r,
                   CAST((1000::HUGEINT * c.f * t.n) // (h.f::HUGEINT * r.f) AS BIGINT) AS score
            FROM left_over AS c JOIN totals AS t USING (lang), (SELECT unnest(range(1, 5)) AS cut) AS places, frequent AS h, frequent AS r
            WHERE cut < c.k AND h.lang = c.lang AND r.lang = c.lang AND h.phrase = array_to_string(string_split(c.phrase, ' ')[:cut], ' ')
              AND r.phrase = array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ')),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
    "op13_lexical_search": r"""
        WITH words AS (
            SELECT row, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
        counts AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY row),
        stats AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
        frequencies AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
        items AS (
            SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
        weights AS (
            SELECT item, item_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM items JOIN frequencies USING (term), stats),
        scored AS (
            SELECT item, item_id, row, doc_id,
                   CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total))))) AS BIGINT) AS score
            FROM weights JOIN counts USING (term) JOIN sizes USING (row), stats GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
