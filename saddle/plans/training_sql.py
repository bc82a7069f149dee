"""Training rounds as SQL, written out per coordinate from the textbook formulas."""
from __future__ import annotations

import math

from saddle.functions.uniform import uniform_sql
from saddle.plans.negatives_sql import negatives_sql
from saddle.plans.registry import rs
from saddle.plans.tables import uniform_array_sql
from saddle.plans.training import Params


def _width(p: Params) -> int:
    return p.logit.width


def _each(p: Params, text: str) -> list[str]:
    """``text`` for every coordinate, ``#`` standing for its number from 1."""
    return [text.replace("#", str(i)) for i in range(1, _width(p) + 1)]


def _sum(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def _start(p: Params, side: str) -> str:
    seed, width = f"{p.seed}-{side}", 0.5 / p.size
    if p.geometry == "lorentz":
        u = uniform_array_sql(seed, "id", p.size, width)
        return f"list_concat([sqrt(1 + list_dot_product({u}, {u}))], {u})"
    if p.geometry.startswith("polar"):
        away = 1.0 if p.geometry == "polar_hyperbolic" else 0.0
        span = math.asin(width / (width + away)) if away else math.pi / 10
        return f"[{2 * width!r} * {uniform_sql(seed, 'id', '1')} + {away}, {span!r} * {uniform_sql(seed, 'id', '2')}]"
    if p.geometry == "euclidean" and side == "out":
        return "[" + ", ".join(["0.0::DOUBLE"] * p.size) + "]"
    return uniform_array_sql(seed, "id", p.size, width)


def _logit(p: Params) -> tuple[str, str]:
    """(helper columns, logit) of u, v and b."""
    if p.geometry == "euclidean":
        return "0 AS h", _sum(_each(p, "u[#] * v[#]")) + " + b"
    if p.geometry.startswith("polar"):
        return "u[2] - v[2] AS h", "u[1] * v[1] * cos(h) + b"
    if p.geometry == "poincare":
        gap, uu, vv = (_sum(_each(p, t)) for t in ("(u[#] - v[#]) ** 2", "u[#] ** 2", "v[#] ** 2"))
        return (f"{gap} AS gap, 1 - {uu} AS a, 1 - {vv} AS c, 2 * {gap} / ((1 - {uu}) * (1 - {vv})) AS h",
                "-ln(1 + h + sqrt(h * (h + 2))) + b")
    return f"{_sum(_each(p, 'u[#] * v[#]'))} - 2 * u[1] * v[1] AS h", "-acosh(greatest(-h, 1.0)) + b"


def _gradients(p: Params) -> tuple[list[str], list[str]]:
    """Coordinates of the gradients of u and v, with e the weighted error."""
    if p.geometry == "euclidean":
        return _each(p, "e * v[#]"), _each(p, "e * u[#]")
    if p.geometry.startswith("polar"):
        turn = "u[1] * v[1] * sin(h) * e"
        return ["v[1] * cos(h) * e", f"-({turn})"], ["u[1] * cos(h) * e", turn]
    if p.geometry == "poincare":
        root = "sqrt(h * (h + 2))"
        return (_each(p, f"-e * (4 * (u[#] - v[#]) / (a * c) + 4 * gap * u[#] / (a ** 2 * c)) / {root}"),
                _each(p, f"-e * (4 * (v[#] - u[#]) / (a * c) + 4 * gap * v[#] / (c ** 2 * a)) / {root}"))
    k = "(CASE WHEN -h > 1 THEN e / sqrt(h * h - 1) ELSE 0 END)"
    return [("-" if i == 0 else "") + f"{k} * v[{i + 1}]" for i in range(_width(p))], \
           [("-" if i == 0 else "") + f"{k} * u[{i + 1}]" for i in range(_width(p))]


def _moved(p: Params, w: str, grad: list[str], lr: float) -> str:
    """The vector ``w`` after one step against ``grad``."""
    d = _width(p)

    def let(value: str, name: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def clip(g: str) -> str:
        norm = f"sqrt(list_dot_product({g}, {g}))"
        return f"CASE WHEN {norm} > {p.max_norm} THEN list_transform({g}, lambda q: q * {p.max_norm} / {norm}) ELSE {g} END"

    g = "[" + ", ".join(grad) + "]"
    if p.geometry == "poincare":
        room = f"(1 - list_dot_product({w}, {w}))"
        scaled = f"list_transform({g}, lambda q: q * {room} * {room} / 4)"
        new = "[" + ", ".join(f"{w}[{i}] - {lr!r} * s[{i}]" for i in range(1, d + 1)) + "]"
        ball = "CASE WHEN sqrt(list_dot_product(m, m)) >= 1 THEN list_transform(m, lambda q: q * 0.99999 / sqrt(list_dot_product(m, m))) ELSE m END"
        return let(scaled, "t", let(clip("t"), "s", let(new, "m", ball)))
    if p.geometry == "euclidean":
        return let(g, "t", let(clip("t"), "s", "[" + ", ".join(f"{w}[{i}] - {lr!r} * s[{i}]" for i in range(1, d + 1)) + "]"))
    if p.geometry == "lorentz":
        dot = "(" + " + ".join([f"{w}[1] * s[1]", *[f"{w}[{i}] * s[{i}]" for i in range(2, d + 1)]]) + ")"  # with s[1] turned, the Minkowski product
        tangent = "[" + ", ".join(f"-{lr!r} * (({'-' if i == 1 else ''}s[{i}]) + {dot} * {w}[{i}])" for i in range(1, d + 1)) + "]"
        norm = "sqrt(greatest(list_dot_product(z, z) - 2 * z[1] * z[1], 0.0))"
        space = "[" + ", ".join(f"cosh(k) * {w}[{i}] + sinh(k) * z[{i}] / k" for i in range(2, d + 1)) + "]"
        lifted = let(space, "m", "list_concat([sqrt(1 + list_dot_product(m, m))], m)")
        return let(g, "t", let(clip("t"), "s", let(tangent, "z", let(norm, "k", f"CASE WHEN k > 0 THEN {lifted} ELSE {w} END"))))
    over = f"sinh({w}[1])" if p.geometry == "polar_hyperbolic" else f"{w}[1]"
    turn = f"greatest(least(coalesce(CASE WHEN {over} <> 0 THEN s[2] / {over} END, 0.0), {p.max_norm}), -{p.max_norm})"
    return let(g, "t", let(clip("t"), "s", f"[greatest({w}[1] - {lr!r} * s[1], 0.000001), {w}[2] - {lr!r} * {turn}]"))


def training_sql(p: Params, pairs: str, scheduled: bool = False) -> str:
    """CTEs from the counted pairs ``pairs(x, y, n)`` to ``st<steps>`` and ``log<k>``, one per round; a schedule brings its ``round``."""
    steps, d = p.epochs * p.rounds, _width(p)
    at_ids = range(1, d + 1)
    parts = [
        f"pr AS (SELECT * FROM {pairs})" if scheduled else
        f"pr AS (SELECT *, CAST(floor({uniform_sql(p.seed + '-round', 'x', 'y')} * {p.rounds}) AS INTEGER) AS round FROM {pairs})",
        f"sz AS (SELECT sum(n)::DOUBLE AS total, greatest(1, CAST(ceil(count(*) / {float(p.rounds * p.batch_size)}) AS BIGINT)) AS groups FROM pr)",
        "vocab AS (SELECT y AS id, sum(n) AS freq FROM pr GROUP BY y)",
        f"drawn_for AS (SELECT unnest(range(CAST((SELECT groups FROM sz) * {steps} AS BIGINT))) AS batch_id)",
        negatives_sql(p.negatives, "drawn_for", f"{p.seed}-neg", "id"),
        f"weights AS (SELECT vocab.id, (freq + weight / (SELECT sum(weight) FROM noise) * {float(p.negatives)} * (SELECT total FROM sz)) / {p.rounds} AS e_out "
        "FROM vocab JOIN noise ON noise.id = vocab.id)",
        f"st0 AS (SELECT i.id, {_start(p, 'in')} AS w_in, {_start(p, 'out')} AS w_out, 0.0::DOUBLE AS b, e_out "
        "FROM (SELECT x AS id FROM pr UNION SELECT y FROM pr) i LEFT JOIN weights ON weights.id = i.id)".replace("CAST(id AS", "CAST(i.id AS"),
    ]
    helper, logit = _logit(p)
    gu, gv = _gradients(p)
    for k in range(steps):
        lr = p.learning_rate * max(1e-4, 1.0 - k / steps)
        set_ = f"CAST(floor({uniform_sql(p.seed + '-set', 'y', str(k))} * {p.sets}) AS BIGINT)"
        group = f"CAST(floor({uniform_sql(p.seed + '-group', 'x', 'part', str(k))} * (SELECT groups FROM sz)) AS BIGINT)"
        zero = ", ".join(["0.0"] * d)
        mean_in = [f"coalesce(a{i} / nullif(n_in, 0), 0.0)" for i in at_ids]
        mean_out = [f"coalesce(c{i} / nullif(e_out, 0), 0.0)" for i in at_ids]
        parts += [
            f"rw{k} AS (SELECT x, y AS t, 1.0::DOUBLE AS label, n::DOUBLE AS w FROM pr WHERE round = {k % p.rounds} UNION ALL "
            f"SELECT x, noise.id, 0.0, count(*)::DOUBLE FROM (SELECT x, y, CAST(floor({uniform_sql(p.seed + '-neg', 'x', 'y', str(k), 'draw')} * (SELECT max(hi) FROM noise)) AS BIGINT) AS spot "
            f"FROM (SELECT x, y, unnest(range(CAST(n * {p.negatives} AS BIGINT))) AS draw FROM pr WHERE round = {k % p.rounds})) "
            "JOIN noise ON spot >= hi - weight AND spot < hi WHERE noise.id <> y GROUP BY x, noise.id)" if p.per_pair else
            f"rw{k} AS (SELECT x, y AS t, 1.0::DOUBLE AS label, n::DOUBLE AS w FROM pr WHERE round = {k % p.rounds} UNION ALL "
            f"SELECT x, negatives.id, 0.0, w::DOUBLE FROM (SELECT x, {group} AS g, sum(n) AS w FROM "
            f"(SELECT *, {set_} AS part FROM pr WHERE round = {k % p.rounds}) GROUP BY 1, 2) c "
            f"JOIN negatives ON negatives.batch_id = c.g + {k} * (SELECT groups FROM sz))",
            f"vc{k} AS (SELECT x, t, label, w, i.w_in AS u, o.w_out AS v, o.b AS b FROM rw{k} JOIN st{k} i ON i.id = x JOIN st{k} o ON o.id = t)",
            f"hp{k} AS (SELECT *, {helper} FROM vc{k})",
            f"lg{k} AS (SELECT *, {logit} AS logit FROM hp{k})",
            f"er{k} AS (SELECT *, w * (1 / (1 + exp(-logit)) - label) AS e, "
            f"w * (greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))) AS xent FROM lg{k})",
            f"sd{k} AS (SELECT x AS id, {', '.join(f'{q} AS a{i}' for i, q in zip(at_ids, gu))}, "
            f"{', '.join(f'0.0::DOUBLE AS c{i}' for i in at_ids)}, 0.0::DOUBLE AS gb, w AS n_in, 0.0::DOUBLE AS n_out, xent, w * label AS real FROM er{k} "
            f"UNION ALL SELECT t, {zero}, {', '.join(gv)}, e, 0.0, w, 0.0, 0.0 FROM er{k})",
            f"sm{k} AS (SELECT id, {', '.join(f'sum(a{i}) AS a{i}, sum(c{i}) AS c{i}' for i in at_ids)}, sum(gb) AS gb, sum(n_in) AS n_in, "
            f"sum(n_out) AS n_out, sum(xent) AS xent, sum(real) AS real FROM sd{k} GROUP BY id)",
            f"log{k} AS (SELECT {k // p.rounds + 1} AS epoch, {k + 1} AS step, {lr!r}::DOUBLE AS lr, sum(xent) / sum(real) AS loss, sum(real) AS pairs FROM sm{k})",
            f"st{k + 1} AS (SELECT st{k}.id, CASE WHEN n_in > 0 THEN {_moved(p, 'w_in', mean_in, lr)} ELSE w_in END AS w_in, "
            f"CASE WHEN n_out > 0 THEN {_moved(p, 'w_out', mean_out, lr)} ELSE w_out END AS w_out, "
            f"b - {lr!r} * greatest(least(coalesce(gb / nullif(e_out, 0), 0.0), {p.max_norm}), -{p.max_norm}) AS b, e_out "
            f"FROM st{k} LEFT JOIN sm{k} ON sm{k}.id = st{k}.id)",
        ]
    return ",\n".join(parts)


def vectors_sql_of(p: Params) -> list[str]:
    """The embedding's coordinates from ``w_in``."""
    if p.geometry == "lorentz":
        return [f"w_in[{i + 1}] / (w_in[1] + 1)" for i in range(1, p.size + 1)]
    if p.geometry.startswith("polar"):
        r = "tanh(w_in[1] / 2)" if p.geometry == "polar_hyperbolic" else "w_in[1]"
        return [f"{r} * cos(w_in[2])", f"{r} * sin(w_in[2])"]
    return [f"w_in[{i}]" for i in range(1, p.size + 1)]


def final_sql(p: Params) -> str:
    """``id, v1, v2`` of a plane embedding after the last round."""
    v = vectors_sql_of(p)
    return f"SELECT id, {rs(v[0])} AS v1, {rs(v[1])} AS v2 FROM st{p.epochs * p.rounds}"


def log_sql(p: Params) -> str:
    steps = p.epochs * p.rounds
    each = " UNION ALL ".join(f"SELECT * FROM log{k}" for k in range(steps))
    return f"SELECT epoch, step, {rs('lr')} AS lr, {rs('loss')} AS loss, {rs('pairs')} AS pairs FROM ({each})"
