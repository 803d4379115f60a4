"""SQL of the iterative models: mixed components by squaring a matrix, and k-Means by Lloyd's steps, one common table after another."""

from __future__ import annotations


def uniform(salt: str) -> str:
    """The number in (0, 1) of a hash of the id, as in clustering.uniform."""
    return f"((CAST('0x' || substr(md5(concat(id, '-{salt}')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


GAP = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def plus_plus_seeds(k: int, seed: int, t: str = "") -> list[str]:
    """Common tables {t}s1 ... {t}sk over {t}p(id, x), one seed more each time."""
    ctes = [f"{t}s1 AS MATERIALIZED (SELECT 0 AS cluster, x AS y FROM (SELECT * FROM {t}p ORDER BY {uniform(str(seed))}, id LIMIT 1))"]
    for i in range(1, k):
        ctes.append(f"{t}g{i} AS MATERIALIZED (SELECT id, any_value(x) AS x, min({GAP}) AS d FROM {t}p CROSS JOIN {t}s{i} GROUP BY id)")
        drawn = f"SELECT * FROM {t}g{i} WHERE d <> 0 ORDER BY -ln({uniform(f'{seed}-{i}')}) / d, id LIMIT 1"
        ctes.append(f"{t}s{i + 1} AS MATERIALIZED (SELECT * FROM {t}s{i} UNION ALL SELECT {i}, x FROM ({drawn}))")
    return ctes


def kmeans(points: str, plus_plus: bool, steps: int, *, k: int = 4, seed: int = 42, tol: float = 0.0, t: str = "") -> str:
    """Common tables over ``points``, which defines {t}p(id, x): seeds and so many steps; the last is {t}labelled(id, x, cluster, dist2).

    A cluster without points keeps its centroid; once no coordinate moves by more than ``tol`` (plus
    1e-5 of itself) the centroids stay, so more steps change nothing. The last centroids are {t}c{steps}.
    """
    ctes = [points]
    table = lambda name, query: ctes.append(f"{t}{name} AS MATERIALIZED ({query})")
    if plus_plus:
        ctes += plus_plus_seeds(k, seed, t)
        table("c0", f"SELECT * FROM {t}s{k}")
    else:
        order = f"{uniform(str(seed))}, id"
        table("c0", f"SELECT row_number() OVER (ORDER BY {order}) - 1 AS cluster, x AS y FROM (SELECT * FROM {t}p ORDER BY {order} LIMIT {k})")
    nearest = lambda i: (
        f"SELECT id, x, cluster, dist2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist2, cluster) AS n FROM (SELECT id, x, cluster, {GAP} AS dist2 FROM {t}p CROSS JOIN {t}c{i})) WHERE n = 1"
    )
    for i in range(steps):
        table(f"a{i}", nearest(i))
        table(f"m{i}", f"SELECT cluster, list(m ORDER BY dim) AS w FROM (SELECT cluster, dim, avg(v) AS m FROM (SELECT cluster, unnest(x) AS v, unnest(range(0, len(x))) AS dim FROM {t}a{i}) GROUP BY cluster, dim) GROUP BY cluster")
        table(f"n{i}", f"SELECT c.cluster, y, coalesce(w, y) AS w FROM {t}c{i} c LEFT JOIN {t}m{i} m ON m.cluster = c.cluster")
        table(f"c{i + 1}", f"SELECT cluster, CASE WHEN (SELECT bool_and({_close(tol)}) FROM {t}n{i}) THEN y ELSE w END AS y FROM {t}n{i}")
    table("labelled", nearest(steps))
    return ", ".join(ctes)


def iterations(t: str, steps: int, tol: float) -> str:
    """The steps that {t}'s k-Means took, the last one without a move."""
    return f"(SELECT 1 + count(*) FROM ({' UNION ALL '.join(f'SELECT bool_and({_close(tol)}) AS still FROM {t}n{i}' for i in range(steps))}) WHERE NOT still)"


def _close(tol: float) -> str:
    return f"len(list_filter(list_zip(w, y), lambda z: abs(z[1] - z[2]) > {tol!r} + 1e-5 * abs(z[2]))) = 0"


def kmeans_by_k(points: str, steps: int, *, ks: range = range(2, 11), seed: int = 42, tol: float = 1e-4) -> str:
    """Common tables (one is recursive) over ``points``: placed(k, id, x, cluster, dist2) of k-Means for each k, whose seeds begin those of the largest."""
    nearest = f"SELECT k, i, id, x, arg_min({{'c': cluster, 'd': d}}, (d, cluster)) AS best FROM (SELECT k, i, cluster, id, x, {GAP} AS d FROM st CROSS JOIN p) GROUP BY k, i, id, x"
    means = f"SELECT k, c, list(m ORDER BY dim) AS w FROM (SELECT k, c, dim, avg(v) AS m FROM (SELECT k, best.c AS c, unnest(x) AS v, unnest(range(0, len(x))) AS dim FROM ({nearest})) GROUP BY k, c, dim) GROUP BY k, c"
    return ", ".join(
        [
            points,
            *plus_plus_seeds(max(ks), seed),
            f"""st AS (
  SELECT k, 0 AS i, cluster, y FROM s{max(ks)} CROSS JOIN (SELECT unnest(range({min(ks)}, {max(ks) + 1})) AS k) WHERE cluster < k
  UNION ALL
  SELECT k, i + 1, cluster, CASE WHEN bool_and({_close(tol)}) OVER (PARTITION BY k) THEN y ELSE w END
  FROM (SELECT s.k, s.i, s.cluster, s.y, coalesce(m.w, s.y) AS w FROM st s LEFT JOIN ({means}) m ON m.k = s.k AND m.c = s.cluster) WHERE i < {steps}
)""",
            f"placed AS MATERIALIZED (SELECT k, id, x, best.c AS cluster, best.d AS dist2 FROM ({nearest.replace('FROM st', f'FROM (SELECT * FROM st WHERE i = {steps})')}))",
        ]
    )


ELBOW = """curve AS (SELECT k, sum(dist2) AS inertia FROM placed GROUP BY k),
ends AS (SELECT min(k) AS k0, max(k) AS k1, min(inertia) AS i0, max(inertia) AS i1 FROM curve),
knee AS (SELECT k AS knee FROM curve CROSS JOIN ends ORDER BY 1 - (inertia - i0) / (i1 - i0) - (k - k0) / (k1 - k0) DESC, k LIMIT 1)"""
SILHOUETTES = """sampled AS (SELECT k, id, x, cluster FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5(concat(id, '-42')), id) AS n FROM placed) WHERE n <= 10000),
dist AS (SELECT q.k, q.id, q.cluster AS own, r.cluster AS other, sum(sqrt(list_sum(list_transform(list_zip(q.x, r.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS s, count(*) AS n FROM sampled q JOIN sampled r ON q.k = r.k GROUP BY ALL),
ab AS (SELECT k, id, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM dist GROUP BY k, id),
scores AS (SELECT k, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY k)"""


def bisecting(points: str, steps: int, *, k: int = 4, seed: int = 42, tol: float = 1e-4) -> str:
    """Common tables over ``points``: tree{k - 1}(id, x, path, dist2), where the leaf with the highest inertia has been split each time."""
    ctes = [points, "tree0 AS MATERIALIZED (SELECT id, x, '' AS path, 1.0::DOUBLE AS dist2 FROM p)"]
    for i in range(k - 1):
        worst = f"(SELECT path FROM tree{i} GROUP BY path ORDER BY sum(dist2) DESC, path LIMIT 1)"
        ctes.append(kmeans(f"b{i}_p AS MATERIALIZED (SELECT id, x FROM tree{i} WHERE path = {worst})", True, steps, k=2, seed=seed, tol=tol, t=f"b{i}_"))
        ctes.append(
            f"tree{i + 1} AS MATERIALIZED (SELECT t.id, t.x, CASE WHEN l.id IS NULL THEN t.path ELSE t.path || l.cluster END AS path, coalesce(l.dist2, t.dist2) AS dist2 FROM tree{i} t LEFT JOIN b{i}_labelled l ON l.id = t.id)"
        )
    return ", ".join(ctes)


def components(numeric: list[str], categorical: list[str], squarings: int = 24) -> str:
    """Common tables over ``filled``: z(user_id, col, v), the axes e0 and e1 (root, col, v), and pc(user_id, pc0, pc1).

    Squaring a covariance matrix again and again, brought to trace 1, leaves the projection on its first axis.
    """
    ctes = ["total AS (SELECT count(*)::DOUBLE AS n FROM filled)"]
    table = lambda name, query: ctes.append(f"{name} AS MATERIALIZED ({query})")
    parts = [
        f"SELECT user_id, '{c}' AS col, coalesce(({c} - (SELECT avg({c}) FROM filled)) / (SELECT stddev_pop({c}) FROM filled), 0) AS v FROM filled WHERE (SELECT stddev_pop({c}) FROM filled) <> 0" for c in numeric
    ]
    parts += [
        f"SELECT user_id, '{c}=' || k.value AS col, CASE WHEN {c} = k.value THEN 1 ELSE 0 END / sqrt(k.share) - sqrt(k.share) AS v "
        f"FROM filled CROSS JOIN (SELECT {c} AS value, count(*) / (SELECT n FROM total) AS share FROM filled WHERE {c} IS NOT NULL GROUP BY {c}) k"
        for c in categorical
    ]
    table("z", " UNION ALL ".join(parts))
    table("cov0", "SELECT a.col AS i, b.col AS j, sum(a.v * b.v) / (SELECT n FROM total) AS v FROM z a JOIN z b USING (user_id) GROUP BY ALL")
    for k in (0, 1):
        table(f"q{k}_0", f"SELECT i, j, v / (SELECT sum(v) FROM cov{k} WHERE i = j) AS v FROM cov{k}")
        for s in range(squarings):
            table(f"r{k}_{s}", f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM q{k}_{s} a JOIN q{k}_{s} b ON a.j = b.i GROUP BY ALL")
            table(f"q{k}_{s + 1}", f"SELECT i, j, v / (SELECT sum(v) FROM r{k}_{s} WHERE i = j) AS v FROM r{k}_{s}")
        last = f"q{k}_{squarings}"
        table(f"x{k}", f"SELECT i AS col, v / (SELECT sqrt(max(v)) FROM {last} WHERE i = j) AS v FROM {last} WHERE j = (SELECT j FROM {last} WHERE i = j ORDER BY v DESC, j LIMIT 1)")
        table(f"y{k}", f"SELECT col, v * (SELECT CASE WHEN v < 0 THEN -1 ELSE 1 END FROM x{k} ORDER BY abs(v) DESC, col LIMIT 1) AS v FROM x{k}")
        table(f"e{k}", f"SELECT (SELECT sum(a.v * c.v * b.v) FROM cov{k} c JOIN y{k} a ON a.col = c.i JOIN y{k} b ON b.col = c.j) AS root, col, v FROM y{k}")
        table(f"cov{k + 1}", f"SELECT i, j, c.v - a.root * a.v * b.v AS v FROM cov{k} c JOIN e{k} a ON a.col = c.i JOIN e{k} b ON b.col = c.j")
    table("pc", "SELECT user_id, sum(z.v * e0.v) AS pc0, sum(z.v * e1.v) AS pc1 FROM z JOIN e0 USING (col) JOIN e1 USING (col) GROUP BY user_id")
    return ", ".join(ctes)


EIGENVALUES = """SELECT CAST(component AS BIGINT) AS component, round(l, 6) AS eigenvalue, round(l / t, 6) AS explained, round(sum(l) OVER (ORDER BY component) / t, 6) AS cumulative
FROM (SELECT 0 AS component, any_value(root) AS l FROM e0 UNION ALL SELECT 1, any_value(root) FROM e1) CROSS JOIN (SELECT sum(v) AS t FROM cov0 WHERE i = j)"""
