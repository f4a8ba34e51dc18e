"""Pieces of SQL from which the oracles are put together; written apart from the column expressions that they check."""

from __future__ import annotations


def ramp(x: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN ({x}) <= ({lo}) THEN 0.0E0 WHEN ({x}) >= ({hi}) THEN 1.0E0 ELSE (({x}) - ({lo})) / (({hi}) - ({lo})) END)"


def gmean(values: list[str], weights: list[float]) -> str:
    logs = " + ".join(f"CAST({float(w)!r} AS DOUBLE) * ln(least(1.0E0, greatest(1e-6, {v})))" for v, w in zip(values, weights, strict=True))
    return f"exp(({logs}) / CAST({float(sum(weights))!r} AS DOUBLE))"


def r9(x: str) -> str:
    return f"(round({x}, 9) + 0.0E0)"


def radius(p: str, ax: str, ay: str) -> str:
    return f"({p}.hx * abs({p}.ux * ({ax}) + {p}.uy * ({ay})) + {p}.hy * abs(-{p}.uy * ({ax}) + {p}.ux * ({ay})))"


def middle(p: str, ax: str, ay: str) -> str:
    return f"({p}.cx * ({ax}) + {p}.cy * ({ay}))"


def span(p: str, ax: str, ay: str) -> tuple[str, str]:
    return f"({middle(p, ax, ay)} - {radius(p, ax, ay)})", f"({middle(p, ax, ay)} + {radius(p, ax, ay)})"


def tall(p: str) -> tuple[str, str]:
    return f"({p}.cz - {p}.hz)", f"({p}.cz + {p}.hz)"


def lap(a: tuple[str, str], b: tuple[str, str]) -> str:
    return f"greatest(0.0E0, least({a[1]}, {b[1]}) - greatest({a[0]}, {b[0]}))"


def gap(a: tuple[str, str], b: tuple[str, str]) -> str:
    return f"greatest({b[0]} - {a[1]}, {a[0]} - {b[1]}, -{lap(a, b)})"


def box_gap(a: str, b: str) -> str:
    axes = [(f"{a}.ux", f"{a}.uy"), (f"-{a}.uy", f"{a}.ux"), (f"{b}.ux", f"{b}.uy"), (f"-{b}.uy", f"{b}.ux")]
    return "greatest(" + ", ".join(gap(span(a, x, y), span(b, x, y)) for x, y in axes) + f", {gap(tall(a), tall(b))})"


def share(a: str, b: str) -> str:
    """Footprint overlap; extents here are never near zero."""
    parts = [f"{lap(span(a, x, y), span(b, x, y))} / ({span(a, x, y)[1]} - {span(a, x, y)[0]})" for x, y in ((f"{b}.ux", f"{b}.uy"), (f"-{b}.uy", f"{b}.ux"))]
    return f"least({', '.join(parts)})"


def reach(p: str) -> str:
    return f"sqrt({p}.hx * {p}.hx + {p}.hy * {p}.hy)"


def contact(g: str, tol: str) -> str:
    return f"(CASE WHEN abs({g}) <= {tol} THEN 1.0E0 ELSE least(1.0E0, greatest(0.0E0, 1.0E0 - (abs({g}) - {tol}) / (2 * {tol}))) END)"


PAIRS = "FROM fx_objects t JOIN fx_objects a ON t.scene_id = a.scene_id AND t.id <> a.id"


def pairs(columns: str, ids: str = "t.scene_id, t.id AS target_id, a.id AS anchor_id") -> str:
    return f"SELECT {ids}, {columns} {PAIRS}"


#: Egocentric axes at the anchor a, seen from (3, -1).
EGO = "(SELECT o.*, (o.cx - 3.0E0) / sqrt((o.cx - 3.0E0) * (o.cx - 3.0E0) + (o.cy + 1.0E0) * (o.cy + 1.0E0)) AS lx, (o.cy + 1.0E0) / sqrt((o.cx - 3.0E0) * (o.cx - 3.0E0) + (o.cy + 1.0E0) * (o.cy + 1.0E0)) AS ly FROM fx_objects o)"


def projective(direction: str) -> dict[str, str]:
    """Terms over rows of a table p with px, py, tr0, tr1, ar0, ar1, gap and both boxes' heights."""
    axis, sign = {"left": (0, -1), "right": (0, 1), "front": (1, 1), "behind": (1, -1)}[direction]
    al, ac = ("px", "py") if axis == 0 else ("py", "px")
    tr, ar, to, ao = f"tr{axis}", f"ar{axis}", f"tr{1 - axis}", f"ar{1 - axis}"
    cone = f"(CASE WHEN sqrt(px * px + py * py) < 1e-6 THEN 0.0E0 ELSE 1.0E0 - {ramp(f'degrees(atan2(abs({ac}), ({sign}) * {al}))', '25.0E0', '55.0E0')} END)"
    over = f"greatest(0.0E0, ({al} + {tr}) - greatest({al} - {tr}, {ar})) / (2 * {tr})" if sign > 0 else f"greatest(0.0E0, least({al} + {tr}, -{ar}) - ({al} - {tr})) / (2 * {tr})"
    side = gap((f"({ac} - {to})", f"({ac} + {to})"), (f"(-{ao})", f"({ao})"))
    ref = "greatest(0.35E0, a_reach)"
    return {
        "cone": cone,
        "separation": ramp(over, "0.05E0", "0.75E0"),
        "depth": f"(CASE WHEN {side} <= 0 THEN 1.0E0 ELSE 1.0E0 - {ramp(side, '0.0E0', '0.45E0')} END)",
        "height": f"(CASE WHEN zlap > 1e-3 THEN 1.0E0 ELSE 1.0E0 - {ramp('dz', '1.1E0', '2.2E0')} END)",
        "preference": f"(0.3E0 + 0.7E0 * (1.0E0 - {ramp('gap', f'1.5E0 * {ref}', f'5.0E0 * {ref}')}))",
        "locality": f"(1.0E0 - {ramp('gap', f'5.0E0 * {ref}', f'8.0E0 * {ref}')})",
    }


def projective_value(direction: str) -> str:
    t = projective(direction)
    return f"{gmean([t[k] for k in ('cone', 'separation', 'depth', 'height', 'preference')], [1.0, 0.9, 0.7, 0.35, 0.35])} * {t['locality']}"


def framed(rx: str, ry: str, fx: str, fy: str, anchor: str = "fx_objects", where: str = "TRUE") -> str:
    """The table p of projective(): all pairs of a scene, with axes that are expressions over the anchor a."""
    dx, dy = "(t.cx - a.cx)", "(t.cy - a.cy)"
    return (
        f"SELECT t.scene_id, t.id AS target_id, a.id AS anchor_id, {dx} * ({rx}) + {dy} * ({ry}) AS px, {dx} * ({fx}) + {dy} * ({fy}) AS py, {radius('t', rx, ry)} AS tr0, {radius('t', fx, fy)} AS tr1, "
        f"{radius('a', rx, ry)} AS ar0, {radius('a', fx, fy)} AS ar1, greatest(0.0E0, {box_gap('t', 'a')}) AS gap, {lap(tall('t'), tall('a'))} AS zlap, abs(t.cz - a.cz) AS dz, {reach('a')} AS a_reach "
        f"FROM fx_objects t JOIN {anchor} a ON t.scene_id = a.scene_id AND t.id <> a.id WHERE {where}"
    )
