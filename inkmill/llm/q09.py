"""op9: substring dedup of documents by 13-word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .substring_dedup import substring_dedup


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=13)


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLE = {
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i + 12], ' ')))) AS k FROM d WHERE len(w) >= 13),
        x AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM s),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM x WHERE first < doc_id),
        t AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id) USING (doc_id)),
        p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)"""
}
