"""op7: near-duplicate vectors of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .embedding_dedup import near_vectors


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


QUERIES = {"op7_embedding_dedup": op7_embedding_dedup}
ORACLE = {
    "op7_embedding_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
        r AS (SELECT vec_id AS id, vec_id AS reach FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, (SELECT min(reach) FROM r WHERE r.id = vec_id) AS component_id, (SELECT min(reach) FROM r WHERE r.id = vec_id) = vec_id AS kept FROM v"""
}
