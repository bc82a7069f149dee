"""Batches and negative samples as SQL."""
from __future__ import annotations

from saddle.functions.uniform import uniform_sql


def batches_sql(size: int, source: str = "(SELECT src AS x, dst AS y FROM edges)", seed: str = "batch") -> str:
    u = uniform_sql(seed, "x", "y")
    return (f"batches AS (SELECT x, y, (row_number() OVER (ORDER BY {u}, x, y) - 1) // {size} AS batch_id FROM {source})")


def noise_sql(key: str = "token") -> str:
    return (f"noise AS (SELECT {key} AS id, weight, CAST(sum(weight) OVER (ORDER BY {key}) AS BIGINT) AS hi FROM "
            f"(SELECT {key}, CAST(round(pow(freq::DOUBLE, 0.75) * 1000000.0) AS BIGINT) AS weight FROM vocab))")


def negatives_sql(n: int, batch_source: str = "batches", seed: str = "neg", key: str = "token") -> str:
    """``n`` distinct ids per batch: each draw falls on what the batch's earlier ids leave of the line."""
    steps = [f"neg0 AS (SELECT DISTINCT batch_id, [{{'lo': 0::BIGINT, 'w': 0::BIGINT}}] AS found, NULL::BIGINT AS id FROM {batch_source})"]
    for k in range(n):
        left = "(SELECT max(hi) FROM noise) - list_sum(list_transform(found, lambda f: f.w))"
        at = f"CAST(floor({uniform_sql(seed, 'batch_id', str(k))} * ({left})::DOUBLE) AS BIGINT)"
        steps.append(f"spot{k} AS (SELECT batch_id, found, list_reduce(list_prepend({{'lo': {at}, 'w': 0::BIGINT}}, found), "
                     f"lambda a, f: {{'lo': CASE WHEN a.lo >= f.lo THEN a.lo + f.w ELSE a.lo END, 'w': 0::BIGINT}}).lo AS spot FROM neg{k})")
        steps.append(f"neg{k + 1} AS (SELECT batch_id, list_sort(list_append(found, {{'lo': hi - weight, 'w': weight}})) AS found, noise.id "
                     f"FROM spot{k} JOIN noise ON spot >= hi - weight AND spot < hi)")
    every = " UNION ALL ".join(f"SELECT batch_id, id, {k + 1} AS rank FROM neg{k + 1}" for k in range(n))
    return noise_sql(key) + ",\n" + ",\n".join(steps) + f",\nnegatives AS ({every})"
