"""Queries pN_... of the training-data problems, over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrivane.llm import copies, encode, mix, neardup, overlap, pii, residue, sample
from scrivane.runtime import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(table(spark, folder, "resume"))


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(table(spark, folder, "resume"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlaps(table(spark, folder, "resume"), table(spark, folder, "resume_split")).select("id_a", "id_b")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(table(spark, folder, "resume"), table(spark, folder, "resume_split"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_records(table(spark, folder, "resume"), table(spark, folder, "resume_split"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "resume"))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_links(table(spark, folder, "resume"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.hidden_copies(table(spark, folder, "resume"))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copy_counts(table(spark, folder, "resume"))


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sample.draw(table(spark, folder, "resume"), table(spark, folder, "category_target"))[0]


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return sample.draw(table(spark, folder, "resume"), table(spark, folder, "category_target"))[1]


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encoded(table(spark, folder, "documents"))


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return encode.decoded(p6_ids(spark, folder))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mixed(table(spark, folder, "documents"), table(spark, folder, "source_target"))[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mixed(table(spark, folder, "documents"), table(spark, folder, "source_target"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents")).select("doc_id")


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    return residue.without_residue(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_report, p2_records, p3_found, p3_links, p4_found, p4_counts, p5_sample, p5_report, p6_ids, p6_decoded, p7_mix, p7_report, p8_found, p8_kept)}


_KEYED = r"""
    SELECT DISTINCT id, list_sort(list_filter(string_split_regex(lower(resume_str), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS words
    FROM resume WHERE id IS NOT NULL AND resume_str IS NOT NULL
"""


_SHINGLES = r"""
    WITH w AS (SELECT DISTINCT id, list_filter(string_split_regex(lower(resume_str), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM resume WHERE id IS NOT NULL AND resume_str IS NOT NULL),
    k AS (SELECT id, list_sort(w) AS bag, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 30),
    g AS (SELECT id, unnest(s) AS g FROM k), n AS (SELECT id, len(s) AS n, bag, hash(list_sort(s)) AS same FROM k),
    b AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
    p AS (SELECT a, b, m.bag = o.bag AS equal, CAST(shared AS DOUBLE) / (m.n + o.n - shared) AS similarity FROM b JOIN n m ON m.id = a JOIN n o ON o.id = b WHERE 10 * shared >= 7 * (m.n + o.n - shared))
"""


_SPLITS = r"""
    , f AS (SELECT resume_id AS id, min({'f': CASE lower(trim(split, E' \t\r\n')) WHEN 'train' THEN 1 ELSE 2 END, 's': lower(trim(split, E' \t\r\n')), 'o': source}) AS f FROM resume_split
      WHERE resume_id IS NOT NULL AND lower(trim(split, E' \t\r\n')) IN ('train', 'validation', 'test') GROUP BY resume_id),
    e AS (SELECT x.id AS a, y.id AS b, 1.0::DOUBLE AS similarity FROM n x JOIN n y ON x.bag = y.bag AND x.id < y.id UNION ALL SELECT a, b, similarity FROM p WHERE NOT equal),
    t AS (SELECT e.*, x.f AS fa, y.f AS fb FROM e JOIN f x ON x.id = a JOIN f y ON y.id = b WHERE x.f.f <> y.f.f)
"""


_QUOTA = r"""
    WITH r AS (SELECT id, min(upper(trim(category, E' \t\r\n'))) AS category FROM resume
               WHERE id IS NOT NULL AND trim(category, E' \t\r\n') <> '' GROUP BY id),
    c AS (SELECT category, count(*) AS available FROM r GROUP BY category),
    t AS (SELECT target_name, upper(trim(category)) AS category, target_share, CAST(min_records AS BIGINT) AS min_records,
                 CAST(floor(target_share * (SELECT floor(count(*) * 0.2 + 0.5) FROM r) + 0.5) AS BIGINT) AS wish FROM category_target),
    q AS (SELECT target_name, t.category, target_share, min_records, coalesce(available, 0) AS available, greatest(wish, coalesce(min_records, 0)) AS wanted,
                 least(greatest(wish, coalesce(min_records, 0)), coalesce(available, 0)) AS quota FROM t LEFT JOIN c ON t.category = c.category)
"""


def oracle_sql() -> dict[str, str]:
    keep = f"SELECT id, min(id) OVER (PARTITION BY words) AS keep_id FROM ({_KEYED}) WHERE len(words) >= 30"
    return {
        "p2_found": _SHINGLES + _SPLITS + "SELECT a AS id_a, b AS id_b FROM t",
        "p3_found": _SHINGLES + "SELECT a AS id_a, b AS id_b FROM p WHERE NOT equal",
        "p3_links": _SHINGLES + """, c AS (SELECT id, min(id) OVER (PARTITION BY same, bag) AS class_id FROM n), r AS (SELECT DISTINCT class_id FROM c),
            l AS (SELECT class_id, count(*) AS links FROM (SELECT a AS class_id, b AS other FROM p UNION ALL SELECT b, a FROM p) q WHERE other IN (SELECT class_id FROM r) GROUP BY class_id)
            SELECT c.id, c.class_id, coalesce(links, 0) AS links FROM c LEFT JOIN l ON l.class_id = c.class_id""",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p4_found": f"SELECT keep_id, id AS copy_id FROM ({keep}) WHERE keep_id <> id",
        "p5_sample": _QUOTA + """SELECT q.target_name, r.category, r.id
            FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY substr(md5('42:' || id), 1, 15), id) AS k FROM r) r
            JOIN q ON q.category = r.category WHERE k <= quota""",
        "p5_report": _QUOTA + """SELECT target_name, category, target_share, min_records, available, wanted, quota,
            round(CAST(quota AS DOUBLE) / CAST(sum(quota) OVER (PARTITION BY target_name) AS DOUBLE), 6) AS actual_share,
            CASE WHEN available = 0 THEN 'missing' WHEN quota < wanted THEN 'exhausted' ELSE 'met' END AS status FROM q""",
        "p4_counts": f"SELECT keep_id, count(*) AS copies FROM ({keep}) GROUP BY keep_id",
    }
