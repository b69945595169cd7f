"""Leading eigenpairs of a small symmetric matrix in SQL, by power iteration: what ordinations are checked against."""

from __future__ import annotations


def leading(entries: str, k: int = 1, steps: int = 3000, vectors: bool = True) -> str:
    """SQL of the ``k`` largest eigenvalues of a positive semidefinite matrix, given by a query for its ``i, j, x`` (all entries).

    Gives ``axis, value, trace`` and, with ``vectors``, ``id, v``: the unit eigenvector of the first axis, its largest entry positive.
    """
    product = "list_transform({m}, lambda r: list_inner_product(r, {v}))"
    out = [f"e AS (SELECT i, j, CAST(x AS DOUBLE) AS x FROM ({entries}))",
           "ids AS (SELECT list(i ORDER BY i) AS ids FROM (SELECT DISTINCT i FROM e))",
           "m1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(x ORDER BY j) AS r FROM e GROUP BY i))",
           "tr AS (SELECT sum(x) AS trace FROM e WHERE i = j)"]
    for a in range(1, k + 1):
        out.append(f"""s{a} AS (SELECT 0 AS step, m, list_transform(range(1, len(m) + 1), lambda t: 1 + sin(CAST(t AS DOUBLE))) AS v FROM m{a} UNION ALL
            SELECT step + 1, m, list_transform(w, lambda y: y / sqrt(list_inner_product(w, w))) FROM (SELECT step, m, {product.format(m='m', v='v')} AS w FROM s{a} WHERE step < {steps}))""")
        out.append(f"p{a} AS (SELECT m, v, list_inner_product(v, {product.format(m='m', v='v')}) AS value FROM s{a} WHERE step = {steps})")
        out.append(f"""m{a + 1} AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - value * v[i] * v[j])) AS m FROM p{a})""")
    if vectors:
        big = "list_reduce(v, lambda a, b: CASE WHEN abs(b) > abs(a) + 1e-12 THEN b ELSE a END)"
        body = f"SELECT 1 AS axis, value, trace, unnest(ids) AS id, unnest(list_transform(v, lambda y: y * sign({big}))) AS v FROM p1, ids, tr"
    else:
        body = " UNION ALL ".join(f"SELECT {a} AS axis, value, trace FROM p{a}, tr" for a in range(1, k + 1))
    return f"WITH RECURSIVE {', '.join(out)} {body}"
