"""Scalar colour functions as SQL text that Spark and DuckDB both read. Arguments are SQL; channels run from 0 to 1 unless said otherwise."""

from __future__ import annotations

from lamina.plans.sql import Dialect, num


def clamp(e: str, low: float = 0, high: float = 1) -> str:
    return f"least(greatest({e}, {num(low)}), {num(high)})"


def finite_or(e: str, low: float, high: float, other: float) -> str:
    """Clamped, or ``other`` where the value is not finite."""
    return f"CASE WHEN isnan({e}) OR abs({e}) = CAST('Infinity' AS DOUBLE) THEN {num(other)} ELSE {clamp(e, low, high)} END"


def straight(c: str, a: str = "a") -> str:
    """A premultiplied byte channel as a share; null where the pixel is clear."""
    return f"CASE WHEN {a} > 0 THEN least({c} * 1e0 / nullif({a}, 0), 1e0) END"


def premultiplied(e: str, old: str, a: str = "a") -> str:
    """Back to a premultiplied byte; clear pixels stay as they are."""
    return f"CASE WHEN {a} = 0 THEN {old} ELSE CAST(least({a} * 1e0, greatest(0e0, round(({e}) * {a}))) AS INT) END"


def luma(r: str = "r1", g: str = "g1", b: str = "b1") -> str:
    """Rec. 709."""
    return f"(0.2126e0 * ({r}) + 0.7152e0 * ({g}) + 0.0722e0 * ({b}))"


def luma601(r: str, g: str, b: str) -> str:
    return f"(0.299e0 * ({r}) + 0.587e0 * ({g}) + 0.114e0 * ({b}))"


def luma_byte(d: Dialect, r: str, g: str, b: str) -> str:
    """Rec. 709 of bytes in whole numbers, rounded."""
    return d.div(f"2126 * {r} + 7152 * {g} + 722 * {b} + 5000", "10000")


def linear(e: str) -> str:
    """Light of an sRGB code value."""
    return f"CASE WHEN {e} <= 0.04045e0 THEN {e} / 12.92e0 ELSE pow(({e} + 0.055e0) / 1.055e0, 2.4e0) END"


def encoded(e: str) -> str:
    """The sRGB code value of light, clamped."""
    return f"CASE WHEN {e} <= 0 THEN 0e0 WHEN {e} >= 1 THEN 1e0 WHEN {e} <= 0.0031308e0 THEN {e} * 12.92e0 ELSE 1.055e0 * pow({e}, {num(1 / 2.4)}) - 0.055e0 END"


def high(*c: str) -> str:
    return f"greatest({', '.join(c)})"


def low(*c: str) -> str:
    return f"least({', '.join(c)})"


def hue_degrees(r: str, g: str, b: str, mx: str, chroma: str, least: float = 1e-6) -> str:
    """0 to 360; 0 for greys."""
    raw = f"60e0 * CASE WHEN {mx} = {r} THEN ({g} - {b}) / nullif({chroma}, 0) WHEN {mx} = {g} THEN ({b} - {r}) / nullif({chroma}, 0) + 2e0 ELSE ({r} - {g}) / nullif({chroma}, 0) + 4e0 END"
    return f"CASE WHEN {chroma} < {num(least)} OR {chroma} = 0 THEN 0e0 WHEN {raw} < 0 THEN {raw} + 360e0 ELSE {raw} END"


def hue_between(h: str, first: float, last: float) -> str:
    """Whether a hue lies in a range that may wrap."""
    inner = f"{h} >= {num(first)} {{}} {h} <= {num(last)}"
    return "(" + inner.format("AND" if first <= last else "OR") + ")"


def forward(a: str, b: str) -> str:
    """Degrees from a on to b, 0 to 360."""
    return f"((({b}) - ({a})) % 360e0 + CASE WHEN (({b}) - ({a})) % 360e0 < 0 THEN 360e0 ELSE 0e0 END)"


def circular(a: str, b: str) -> str:
    """Distance on a circle of length 1."""
    return f"least(abs(({a}) - ({b})), 1e0 - abs(({a}) - ({b})))"


def smoothstep(t: str) -> str:
    return f"(({t}) * ({t}) * (3e0 - 2e0 * ({t})))"


def smooth_between(first: float, last: float, e: str) -> str:
    return smoothstep(clamp(f"(({e}) - {num(first)}) / {num(last - first)}"))


def quantised(e: str, levels: int) -> str:
    return f"(round({clamp(e)} * {num(levels - 1)}) / {num(levels - 1)})"


def band_weight(position: str, ramp_in: float, plateau: float, span: float) -> str:
    """Ramp, plateau and ramp of a hue band, by degrees from its start; a band without span claims all."""
    if span <= 0:
        return "1e0"
    rise = f"{position} / {num(ramp_in)}" if ramp_in > 0 else "1e0"
    fall = f"({num(span)} - {position}) / {num(span - plateau)}" if span > plateau else "1e0"
    return f"CASE WHEN {position} > {num(span)} THEN 0e0 WHEN {position} < {num(ramp_in)} THEN {rise} WHEN {position} <= {num(plateau)} THEN 1e0 ELSE {fall} END"


def saturated(s: str, amount: float) -> str:
    """Saturation moved by -100 to 100, by a factor either way, so greys stay grey."""
    a = min(1.0, max(-1.0, amount / 100))
    if a <= 0:
        return f"greatest(0e0, {s} * {num(1 + a)})"
    return f"CASE WHEN {s} > 0 THEN 1e0 ELSE 0e0 END" if a >= 1 else f"least(1e0, {s} / {num(1 - a)})"


def mix32(d: Dialect, x: str) -> list[dict[str, str]]:
    """Three levels of columns, the last named ``h``: the avalanche hash of a 32-bit number."""
    return [
        {"h_1": d.mul32(d.xor(x, d.shr(x, 16)), 0x7FEB352D)},
        {"h_2": d.mul32(d.xor("h_1", d.shr("h_1", 15)), 0x846CA68B)},
        {"h": d.xor("h_2", d.shr("h_2", 16))},
    ]


def hashed(d: Dialect, x: str, name: str) -> list[dict[str, str]]:
    """``mix32`` with column names of its own, ending in ``name``."""
    one, two, three = mix32(d, x)
    rename = lambda e: e.replace("h_1", f"{name}_1").replace("h_2", f"{name}_2")
    return [{f"{name}_1": one["h_1"]}, {f"{name}_2": rename(two["h_2"])}, {name: rename(three["h"])}]


def hex_colour(d: Dialect, r: str, g: str, b: str) -> str:
    digits = lambda c: f"lpad(hex(CAST({c} AS BIGINT)), 2, '0')" if d.spark else f"lpad(upper(to_hex(CAST({c} AS BIGINT))), 2, '0')"
    return f"concat('#', {digits(r)}, {digits(g)}, {digits(b)})"
