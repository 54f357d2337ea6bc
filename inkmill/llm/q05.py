"""op5: near-duplicate components of documents by a 4-word shingle Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .jaccard_join import jaccard_components


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, share=85)


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLE = {
    "op5_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(reach) FROM r WHERE r.id = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""
}
