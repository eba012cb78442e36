"""SQL text for networks: every unit spelled out as a column, one CTE per step.

Written from the definition of back-propagation, apart from the Spark code, so
that it can serve as its oracle.
"""

from __future__ import annotations

import math

from tallygrad.network import NetworkConfig, Weights

SCALE, RATE = 1.7159, "(2.0::DOUBLE / 3)"


def act(z: str, name: str) -> str:
    if name == "sigm":
        return f"1 / (1 + exp(-({z})))"
    if name == "tanh_opt":
        return f"{SCALE}::DOUBLE * tanh(({z}) * {RATE})"
    return z


def slope(a: str, name: str) -> str:
    if name == "sigm":
        return f"({a} * (1 - {a}))"
    if name == "tanh_opt":
        return f"({SCALE}::DOUBLE * {RATE} * (1 - {a} * {a} / ({SCALE}::DOUBLE * {SCALE}::DOUBLE)))"
    return "1"


def places(config: NetworkConfig):
    return [(l, r, c) for l, (rows, cols) in enumerate(config.shapes) for r in range(rows) for c in range(cols)]


def weight_row(name: str, config: NetworkConfig, weights: Weights | None = None) -> str:
    """CTE of one row with all weights; by default cos(r + 2c) / 20."""
    cols = []
    for l, r, c in places(config):
        value = f"cos({r + 2 * c}) / 20" if weights is None else f"{float(weights[l][r, c])!r}::DOUBLE"
        cols.append(f"{value} AS w_{l}_{r}_{c}")
    return f"{name} AS MATERIALIZED (SELECT {', '.join(cols)})"


def mask_columns(config: NetworkConfig) -> list[str]:
    return [f"m{l}_{u}" for l in range(1, config.layer - 1) for u in range(config.size[l])]


def forward(source: str, weights: str, config: NetworkConfig, keep: str, masks: bool = False) -> str:
    """SELECT of ``keep``, x1.., hidden outputs a1_0.. and the output ``o`` per source row.

    With ``masks`` hidden outputs are multiplied by the source's 0/1 columns m1_0..
    """
    inputs = [f"x{i + 1}" for i in range(config.size[0])]
    carried = [keep, *inputs, *(mask_columns(config) if masks else [])]
    query = f"SELECT {', '.join(carried)} FROM {source}"
    for l, (rows, cols) in enumerate(config.shapes):
        last = l == len(config.shapes) - 1
        units = []
        for r in range(rows):
            z = " + ".join([f"w_{l}_{r}_0"] + [f"w_{l}_{r}_{c} * {inputs[c - 1]}" for c in range(1, cols)])
            a = act(z, config.output if last else config.hidden)
            if not last and masks:
                a = f"({a}) * m{l + 1}_{r}"
            elif not last and config.dropout > 0:
                a = f"({a}) * {1 - config.dropout}::DOUBLE"
            units.append(f"{a} AS {'o' if last else f'a{l + 1}_{r}'}")
        query = f"SELECT {', '.join(carried)}, {', '.join(units)} FROM ({query}) s{l}, {weights}"
        inputs = [f"a{l + 1}_{r}" for r in range(rows)]
        carried += inputs
    return query


def gradient_columns(config: NetworkConfig) -> dict[tuple[int, int, int], str]:
    """Derivative expressions per weight, over the columns of :func:`deltas`."""
    out = {}
    for l, r, c in places(config):
        before = "1" if c == 0 else (f"x{c}" if l == 0 else f"a{l}_{c - 1}")
        out[l, r, c] = f"d{l}_{r} * {before}"
    return out


def deltas(source: str, weights: str, config: NetworkConfig, keep: str, masks: bool = False) -> str:
    """:func:`forward` with the deltas d{l}_{r} of every layer step."""
    last = len(config.shapes) - 1
    passed = forward(source, weights, config, keep, masks)
    query = f"SELECT *, -(y - o) * {slope('o', config.output)} AS d{last}_0 FROM ({passed}) f"
    for l in range(last - 1, -1, -1):
        cols = []
        for r in range(config.shapes[l][0]):
            back = " + ".join(f"w_{l + 1}_{k}_{r + 1} * d{l + 1}_{k}" for k in range(config.shapes[l + 1][0]))
            mask = f" * m{l + 1}_{r}" if masks else ""
            cols.append(f"({back}) * {slope(f'a{l + 1}_{r}', config.hidden)}{mask} AS d{l}_{r}")
        # Weights come back in by a one-row join; only the new columns are added.
        query = f"SELECT b{l}.*, {', '.join(cols)} FROM ({query}) b{l}, {weights}"
    return query


def gradient_sql(
    source: str, weights: str, config: NetworkConfig, name: str, total: str = "avg", masks: bool = False
) -> str:
    cols = [
        f"{total}({e}) FILTER (WHERE NOT v) AS g_{l}_{r}_{c}" for (l, r, c), e in gradient_columns(config).items()
    ]
    cols += [
        "count(*) FILTER (WHERE NOT v) AS n",
        "0.5 * avg((y - o) * (y - o)) FILTER (WHERE NOT v) AS lt",
        "0.5 * avg((y - o) * (y - o)) FILTER (WHERE v) AS lv",
    ]
    return f"{name} AS MATERIALIZED (SELECT {', '.join(cols)} FROM ({deltas(source, weights, config, 'y, v', masks)}) q)"


def loss_sql(source: str, weights: str, config: NetworkConfig, name: str) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT 0.5 * avg((y - o) * (y - o)) FILTER (WHERE NOT v) AS lt, "
        f"0.5 * avg((y - o) * (y - o)) FILTER (WHERE v) AS lv FROM ({forward(source, weights, config, 'y, v')}) q)"
    )


def update_sql(weights: str, gradient: str, velocity: str | None, config: NetworkConfig, rate: float, name: str) -> str:
    """CTE with the weights after one step and the step s_… itself."""
    cols = []
    for l, r, c in places(config):
        g = f"g_{l}_{r}_{c}"
        if config.l2 > 0 and c > 0:
            g = f"({g} + {config.l2}::DOUBLE * w_{l}_{r}_{c})"
        step = f"{rate!r}::DOUBLE * {g}"
        if config.momentum > 0 and velocity is not None:
            step += f" + {config.momentum}::DOUBLE * s_{l}_{r}_{c}"
        cols += [f"w_{l}_{r}_{c} - ({step}) AS w_{l}_{r}_{c}", f"{step} AS s_{l}_{r}_{c}"]
    sources = f"{weights}, {gradient}"
    if velocity is not None and velocity != weights:
        sources += f", {velocity}"
    return f"{name} AS MATERIALIZED (SELECT {', '.join(cols)} FROM {sources})"


def unpivot(cte: str, config: NetworkConfig, columns: dict[str, str]) -> str:
    """Rows (layer, r, c, ...) of a one-row CTE; ``columns`` maps outputs to prefixes."""
    parts = []
    for l, r, c in places(config):
        values = ", ".join(f"{expr.format(p=f'{l}_{r}_{c}')} AS {out}" for out, expr in columns.items())
        parts.append(f"SELECT {l} AS layer, {r} AS r, {c} AS c, {values} FROM {cte}")
    return "\nUNION ALL ".join(parts)


def lehmer_sql(key: str, epoch: int, position: int, seed: int) -> str:
    """The integer draw, step by step."""
    x = f"(({key}) % 2147483647)"
    for part in (epoch, position, seed, 1):
        x = f"(({x} * 48271 + {part + 1}) % 2147483647)"
    return f"({x} / 2147483647.0::DOUBLE)"


def noise_cte(name: str, source: str, key: str, config: NetworkConfig, epoch: int, seed: int = 0) -> str:
    """The source with the masks of one epoch drawn by :func:`lehmer_sql`."""
    cols = []
    for i in range(config.size[0]):
        kept = f"{lehmer_sql(key, epoch, i, seed)} >= {config.input_mask}::DOUBLE" if config.input_mask > 0 else "true"
        cols.append(f"CASE WHEN {kept} THEN x{i + 1} ELSE 0 END AS x{i + 1}")
    for k, m in enumerate(mask_columns(config)):
        kept = f"{lehmer_sql(key, epoch, k, seed + 1)} > {config.dropout}::DOUBLE" if config.dropout > 0 else "true"
        cols.append(f"CASE WHEN {kept} THEN 1 ELSE 0 END AS {m}")
    return f"{name} AS MATERIALIZED (SELECT y, v, {', '.join(cols)} FROM {source})"


def training_ctes(
    source: str,
    config: NetworkConfig,
    epochs: int,
    restarts: dict[int, Weights] | None = None,
    noise_key: str | None = None,
) -> str:
    """CTEs of a whole run: w0, then per epoch g{e}, w{e+1} and the losses l{e+1}.

    ``restarts`` maps an epoch (from 0) to the weights it starts with. With a
    ``noise_key`` each gradient is taken under the masks of its epoch; losses never are.
    """
    restarts = restarts or {}
    ctes = [weight_row("w0", config)]
    start, velocity, rate = "w0", None, config.learning_rate
    for e in range(epochs):
        if e in restarts:
            start, velocity, rate = f"start{e}", None, config.learning_rate
            ctes.append(weight_row(start, config, restarts[e]))
        if noise_key is None:
            ctes.append(gradient_sql(source, start, config, f"g{e}"))
        else:
            ctes.append(noise_cte(f"noise{e}", source, noise_key, config, e))
            ctes.append(gradient_sql(f"noise{e}", start, config, f"g{e}", masks=True))
        ctes.append(update_sql(start, f"g{e}", velocity, config, rate, f"w{e + 1}"))
        ctes.append(loss_sql(source, f"w{e + 1}", config, f"l{e + 1}"))
        start = velocity = f"w{e + 1}"
        rate *= config.rate_decay
    return ",\n".join(ctes)


def log_sql(epochs: int) -> str:
    """Rows (iteration, train_loss, valid_loss) of :func:`training_ctes`."""
    return " UNION ALL ".join(
        f"SELECT {e} AS iteration, lt AS train_loss, lv AS valid_loss FROM l{e}" for e in range(1, epochs + 1)
    )


def differences_sql(source: str, config: NetworkConfig, name: str, step: float = 1e-4) -> str:
    """Average central difference per weight: one forward pass per sign and weight, spelled out."""
    base = {(l, r, c): math.cos(r + 2 * c) / 20 for l, r, c in places(config)}
    cols = []
    for p in places(config):
        halves = []
        for sign in (1, -1):
            o = _output(config, {**base, p: base[p] + sign * step})
            halves.append(f"0.5 * (y - ({o})) * (y - ({o}))")
        l, r, c = p
        cols.append(f"avg(({halves[0]}) - ({halves[1]})) / {2 * step!r}::DOUBLE AS e_{l}_{r}_{c}")
    return f"{name} AS (SELECT {', '.join(cols)} FROM {source})"


def _output(config: NetworkConfig, w: dict) -> str:
    inputs = [f"x{i + 1}" for i in range(config.size[0])]
    for l, (rows, cols) in enumerate(config.shapes):
        last = l == len(config.shapes) - 1
        inputs = [
            act(
                " + ".join(
                    [f"{w[l, r, 0]!r}::DOUBLE"] + [f"{w[l, r, c]!r}::DOUBLE * {inputs[c - 1]}" for c in range(1, cols)]
                ),
                config.output if last else config.hidden,
            )
            for r in range(rows)
        ]
    return inputs[0]
