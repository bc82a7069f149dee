"""The steps of ``operators/linear.py`` in SQL: every sum, bound and update of the fits, one after another.

Expects ``fx(ds, id, v, labels)`` (``v`` led by a 1 for the intercept) and ``fm(ds, fit, id, train, test)``.
"""
from __future__ import annotations

from saddle.operators.linear import BLOCKS, SLACK, Linear


def fits_sql(spec: Linear, classes: int, tag: str = "") -> str:
    """CTEs that end in ``fp{tag}(ds, fit, id, k, p)``: the probability of every class for every tested row."""
    t = tag
    parts = [
        f"fl{t} AS MATERIALIZED (SELECT ds, id, generate_subscripts(v, 1) - 1 AS j, unnest(v) AS val FROM fx)",
        f"ft{t} AS MATERIALIZED (SELECT ds, fit, id FROM fm WHERE train)",
        f"fn{t} AS MATERIALIZED (SELECT ds, fit, count(*) FILTER (train) AS n FROM fm GROUP BY ALL)",
        f"fd{t} AS (SELECT ds, any_value(len(v)) - 1 AS d FROM fx GROUP BY ds)",
    ]
    spun = f"SELECT ds, fit, id, list_dot_product(v, u) AS s FROM pw{t} JOIN ft{t} USING (ds, fit) JOIN fx USING (ds, id) WHERE i < {spec.power}"
    parts.append(f"""pw{t} AS (SELECT 0 AS i, ds, fit, [0.0] || list_transform(range(d), lambda a: 1 / sqrt(d)) AS u, 0.0::DOUBLE AS top FROM fn{t} JOIN fd{t} USING (ds)
  UNION ALL SELECT (SELECT max(i) FROM pw{t}) + 1, ds, fit, list(CASE WHEN j = 0 THEN 0 ELSE u / top END ORDER BY j), any_value(top) FROM (
    SELECT *, sqrt(sum(u * u) FILTER (j > 0) OVER (PARTITION BY ds, fit)) AS top FROM (
      SELECT ds, fit, j, sum(s * val) AS u FROM ({spun}) JOIN fl{t} USING (ds, id) GROUP BY ALL)) GROUP BY ds, fit)""")
    ridge = 0.0 if spec.l1 else 1 / spec.c
    parts.append(f"fr{t} AS MATERIALIZED (SELECT ds, fit, {spec.curvature * BLOCKS} * n AS l0, {spec.curvature * BLOCKS * SLACK} * top + {ridge} AS l1 "
                 f"FROM fn{t} JOIN pw{t} USING (ds, fit) WHERE i = {spec.power})")
    slope = "g" if spec.l1 else f"(g + CASE WHEN j = 0 THEN 0 ELSE z[j + 1] / {spec.c} END)"
    moved = f"z[j + 1] - {slope} / (CASE WHEN j = 0 THEN l0 ELSE l1 END)"
    if spec.l1:
        moved = f"CASE WHEN j = 0 THEN {moved} ELSE sign({moved}) * greatest(abs({moved}) - 1 / ({spec.c} * l1), 0) END"
    seen = (f"SELECT ds, fit, id, k, list_contains(labels, k)::INTEGER AS truth, list_dot_product(v, z) AS score FROM fs{t} JOIN ft{t} USING (ds, fit) JOIN fx USING (ds, id) "
            f"WHERE i < {spec.steps}")
    slopes = f"SELECT ds, fit, k, j, sum(e * val) AS g FROM (SELECT ds, fit, id, k, {_probability(spec)} - truth AS e FROM ({seen})) JOIN fl{t} USING (ds, id) GROUP BY ALL"
    parts.append(f"""fs{t} AS (SELECT 0 AS i, ds, fit, k, list_transform(range(d + 1), lambda a: 0.0::DOUBLE) AS w, list_transform(range(d + 1), lambda a: 0.0::DOUBLE) AS z
    FROM fn{t} JOIN fd{t} USING (ds), range({classes}) AS ks(k)
  UNION ALL SELECT i + 1, ds, fit, k, list(moved ORDER BY j), list(moved + i / (i + 3) * (moved - w) ORDER BY j) FROM (
    SELECT i, ds, fit, k, j, w[j + 1] AS w, {moved} AS moved FROM fs{t} JOIN ({slopes}) USING (ds, fit, k) JOIN fr{t} USING (ds, fit)) GROUP BY i, ds, fit, k)""")
    parts.append(f"fw{t} AS MATERIALIZED (SELECT ds, fit, k, w FROM fs{t} WHERE i = {spec.steps})")
    judged = f"SELECT ds, fit, id, k, list_dot_product(v, w) AS score FROM fm JOIN fx USING (ds, id) JOIN fw{t} USING (ds, fit) WHERE test"
    parts.append(f"fp{t} AS MATERIALIZED (SELECT ds, fit, id, k, {_probability(spec)} AS p FROM ({judged}))")
    return ",\n".join(parts)


def _probability(spec: Linear) -> str:
    if spec.multinomial:
        return "exp(score) / sum(exp(score)) OVER (PARTITION BY ds, fit, id)"
    return "1 / (1 + exp(-score))"


def best_sql(tag: str = "") -> str:
    """``fb{tag}(ds, fit, id, y, pred, p)``: the first of the likeliest classes, and its share."""
    return (f"fb{tag} AS MATERIALIZED (SELECT ds, fit, id, labels[1] AS y, pred, p FROM (SELECT ds, fit, id, CAST(arg_max(k, (p, -k)) AS INTEGER) AS pred, "
            f"max(p) / sum(p) AS p FROM fp{tag} GROUP BY ds, fit, id) JOIN fx USING (ds, id))")


def f1_sql(tag: str = "") -> str:
    """``ff{tag}(ds, fit, macro, micro)``."""
    return (f"ff{tag} AS MATERIALIZED (SELECT ds, fit, avg(2 * tp / (2 * tp + wrong)) AS macro, 2 * sum(tp) / (2 * sum(tp) + sum(wrong)) AS micro FROM ("
            f"SELECT ds, fit, c, sum(tp)::DOUBLE AS tp, sum(wrong)::DOUBLE AS wrong FROM ("
            f"SELECT ds, fit, y AS c, (y = pred)::INTEGER AS tp, (y <> pred)::INTEGER AS wrong FROM fb{tag} UNION ALL "
            f"SELECT ds, fit, pred, 0, 1 FROM fb{tag} WHERE y <> pred) GROUP BY ALL) GROUP BY ds, fit)")
