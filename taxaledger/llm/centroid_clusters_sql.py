"""DuckDB SQL for the clustering: every distance of every round, no bounds."""

from __future__ import annotations


def cluster_sql(k: int, rounds: int, dimensions: int, scale: int, salt: str) -> str:
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
          FROM embeddings WHERE len(embedding) = {dimensions} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dimensions})""",
        f"e AS MATERIALIZED (SELECT rid, unnest(range({dimensions})) AS d, unnest(v) AS x FROM kept)",
        f"""c0 AS MATERIALIZED (SELECT c, unnest(range({dimensions})) AS d, unnest(v) AS x FROM (
          SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS c, v FROM kept) WHERE c < {k})""",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT rid, c, dist FROM (
          SELECT rid, c, sum((e.x - c{r}.x) * (e.x - c{r}.x)) AS dist FROM e JOIN c{r} USING (d) GROUP BY rid, c)
          QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1)""")
        if r < rounds:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.c, c{r}.d, CAST(coalesce((s - (s % n + n) % n) // n, c{r}.x) AS BIGINT) AS x
              FROM c{r} LEFT JOIN (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{r} JOIN e USING (rid) GROUP BY c, d) m ON m.c = c{r}.c AND m.d = c{r}.d)""")
    return f"""WITH {', '.join(ctes)},
named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(dist) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN named USING (c)"""
