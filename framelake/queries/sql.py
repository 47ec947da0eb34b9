"""Common table expressions that the queries' SQL shares."""

M = "m AS MATERIALIZED (SELECT vec_id AS frame, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS i) t)"
MP = f"{M}, mp AS MATERIALIZED (SELECT CAST(y * 8 + x AS BIGINT) AS pixel, frame, v FROM m)"
P = "p64 AS (SELECT unnest(range(0, 64)) AS pixel)"
A = f"{P}, a AS (SELECT pixel, CAST(pixel % 10 AS INTEGER) AS comp, CAST(1 + pixel % 3 AS DOUBLE) AS value FROM p64 UNION ALL SELECT pixel, CAST((pixel + 1) % 10 AS INTEGER), CAST(0.5 AS DOUBLE) FROM p64 WHERE pixel % 4 = 0)"
C = "c AS MATERIALIZED (SELECT comp, frame, avg(v) AS value FROM a JOIN mp USING (pixel) GROUP BY 1, 2)"
U = "u AS (SELECT pixel, CAST((pixel // 8 // 4) * 2 + (pixel % 8) // 4 AS INTEGER) AS comp, 1 + (pixel % 5) / CAST(4 AS DOUBLE) AS value FROM p64)"
V = "z AS MATERIALIZED (SELECT comp, frame, avg(v) AS value FROM u JOIN mp USING (pixel) GROUP BY 1, 2)"
MAC = f"{MP}, {A}, {C}"
ALL = f"{MP}, {A}, {C}, {U}, {V}"
UV = "uv AS MATERIALIZED (SELECT pixel, frame, sum(u.value * z.value) AS value FROM u JOIN z USING (comp) GROUP BY 1, 2)"
AC = "ac AS MATERIALIZED (SELECT pixel, frame, sum(a.value * c.value) AS value FROM a JOIN c USING (comp) GROUP BY 1, 2)"
B = "b AS (SELECT pixel, sum(value) AS b FROM (SELECT pixel, avg(value) AS value FROM uv GROUP BY 1 UNION ALL SELECT pixel, -avg(value) FROM ac GROUP BY 1) t GROUP BY 1)"


def with_(ctes: str, query: str) -> str:
    return f"WITH {ctes} {query}"


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"
