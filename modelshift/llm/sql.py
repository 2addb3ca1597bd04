"""SQL with the same rows as the registered queries, where SQL can express them."""

from __future__ import annotations


def centroid_sql(rounds: int = 3, clusters: int = 16) -> str:
    """``op13_centroids``: the rounds as one common table expression after the other."""
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 "
        "AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "comps AS MATERIALIZED (SELECT vec_id, i, "
        "CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) t(i))",
        "seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c "
        f"FROM kept QUALIFY c < {clusters})",
        "c0 AS MATERIALIZED (SELECT c, i, x AS v FROM seeds JOIN comps USING (vec_id))",
    ]
    for k in range(rounds + 1):
        parts.append(
            f"a{k} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT vec_id, c, "
            f"CAST(sum((x - v) * (x - v)) AS BIGINT) AS d FROM comps JOIN c{k} USING (i) "
            "GROUP BY vec_id, c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if k < rounds:
            parts.append(
                f"c{k + 1} AS MATERIALIZED (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v "
                f"FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{k} JOIN comps USING (vec_id) "
                f"GROUP BY c, i) UNION ALL SELECT c, i, v FROM c{k} WHERE c NOT IN (SELECT c FROM a{k}))")
    parts.append(f"names AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h "
                 f"FROM c{rounds} GROUP BY c)")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, "
        "CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN names USING (c)")
