"""Row-local colour operators on pixels (image_id, y, x, r, g, b, a), premultiplied bytes; clear pixels stay as they are.

Each function returns a ``Text`` over the frame ``px``; ``apply`` runs one on a DataFrame. Parameters are plain values, normalised here.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from lamina.functions import color as c
from lamina.plans.sql import Dialect, Text, num, run, steps

KEYS = "image_id, y, x"
RGB = ("r", "g", "b")


def apply(px: DataFrame, text: Text) -> DataFrame:
    return run(text, {"px": px})


def _written(names: tuple[str, str, str] = ("r9", "g9", "b9")) -> str:
    return KEYS + ", " + ", ".join(f"{c.premultiplied(n, o)} AS {o}" for n, o in zip(names, RGB, strict=True)) + ", a"


def pixel_map(levels: list[dict[str, str]], names: tuple[str, str, str] = ("r9", "g9", "b9")) -> str:
    """Straight channels r1, g1, b1, then ``levels``, then back to bytes."""
    return steps("{px}", [{f"{x}1": c.straight(x) for x in RGB}, *levels], _written(names))


def each(f, inputs: tuple[str, str, str] = ("r1", "g1", "b1"), outputs: tuple[str, str, str] = ("r9", "g9", "b9")) -> dict[str, str]:
    return {o: f(i, k) for k, (i, o) in enumerate(zip(inputs, outputs, strict=True))}


def looked_up(d: Dialect, e: str, table: list[float]) -> str:
    """Linear interpolation in a table over 0 to 1; the whole part is taken of the same product twice."""
    n = len(table) - 1
    values = d.array([num(v) for v in table])
    at = f"({e}) * {num(n)}"
    lo = f"CAST(floor({at}) AS INT)"
    return f"({d.at(values, lo)} + ({d.at(values, f'least({lo} + 1, {n})')} - {d.at(values, lo)}) * ({at} - floor({at})))"


# Levels and curves


def _clean(x: float, low: float, high: float, other: float) -> float:
    return min(high, max(low, x)) if math.isfinite(x) else other


def level_range(black: float = 0, gamma: float = 1, white: float = 255, out_black: float = 0, out_white: float = 255) -> tuple[float, ...]:
    """Normalised: black below white, gamma from 0.1 to 9.99."""
    black = _clean(black, 0, 254, 0)
    return black, _clean(gamma, 0.1, 9.99, 1), _clean(white, black + 1, 255, 255), _clean(out_black, 0, 255, 0), _clean(out_white, 0, 255, 255)


def level_value(x: float, r: tuple[float, ...]) -> float:
    black, gamma, white, out_black, out_white = r
    share = min(1.0, max(0.0, (x * 255 - black) / (white - black)))
    return (out_black + share ** (1 / gamma) * (out_white - out_black)) / 255


def levels(composite: dict | None = None, channels: tuple[dict, dict, dict] = ({}, {}, {})) -> Text:
    """Each channel's range, then the composite one, through 256-entry tables."""
    whole, own = level_range(**(composite or {})), [level_range(**r) for r in channels]
    tables = [[level_value(level_value(i / 255, r), whole) for i in range(256)] for r in own]
    return lambda d: pixel_map([each(lambda e, k: looked_up(d, e, tables[k]))])


def curve_value(points: list[tuple[float, float]], x: float) -> float:
    """A monotone cubic through ``points``: slopes are harmonic means of neighbouring chords, 0 where they turn."""
    rise = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(points, points[1:], strict=False)]
    slope = [rise[0], *[0.0 if p * q <= 0 else 2 * p * q / (p + q) for p, q in zip(rise, rise[1:], strict=False)], rise[-1]]
    i = max((k for k in range(len(points) - 1) if points[k][0] <= x), default=0)
    (x0, y0), (x1, y1) = points[i], points[i + 1]
    h, t = x1 - x0, min(1.0, max(0.0, (x - x0) / (x1 - x0)))
    u = 1 - t
    y = y0 * (1 + 2 * t) * u * u + slope[i] * h * t * u * u + y1 * t * t * (3 - 2 * t) - slope[i + 1] * h * t * t * u
    return min(255.0, max(0.0, y))


LINE = [(0.0, 0.0), (255.0, 255.0)]


def curve_table(own: list[tuple[float, float]], composite: list[tuple[float, float]] = LINE) -> list[float]:
    return [curve_value(composite, curve_value(own, float(i))) / 255 for i in range(256)]


def curves(composite: list[tuple[float, float]] = LINE, channels: tuple = (LINE, LINE, LINE)) -> Text:
    tables = [curve_table(list(p), list(composite)) for p in channels]
    return lambda d: pixel_map([each(lambda e, k: looked_up(d, e, tables[k]))])


def parametric_curve(shadows: float = 0, darks: float = 0, lights: float = 0, highlights: float = 0, splits: tuple[float, float, float] = (25, 50, 75)) -> list[float]:
    """256 tones of a curve bent in four regions by gamma curves, run through a smooth curve with 33 anchors."""
    strength = 1.66

    def bend(t: float, lower: float, down: float, upper: float, up: float) -> float:
        if 0 < lower and t < lower:
            return lower * (t / lower) ** (2 ** (-down / 100 * strength))
        if upper < 1 and t > upper:
            return 1 - (1 - upper) * ((1 - t) / (1 - upper)) ** (2 ** (up / 100 * strength))
        return t

    a, m, b = (s / 100 for s in splits)
    anchors = [(255 * i / 32, 255 * bend(bend(i / 32, a, shadows, b, highlights), m, darks, m, lights)) for i in range(33)]
    return [curve_value(anchors, float(i)) / 255 for i in range(256)]


def tone_table(table: list[float]) -> Text:
    return lambda d: pixel_map([each(lambda e, k: looked_up(d, e, table))])


def exposure(stops: float = 0, offset: float = 0, gamma: float = 1) -> Text:
    """In linear light: doubled ``stops`` times, moved, gamma; through a table of the 256 codes."""

    def value(i: int) -> float:
        e = i / 255
        light = e / 12.92 if e <= 0.04045 else ((e + 0.055) / 1.055) ** 2.4
        light = max(0.0, light * 2**stops + offset) ** (1 / gamma)
        return min(1.0, max(0.0, light * 12.92 if light <= 0.0031308 else 1.055 * light ** (1 / 2.4) - 0.055))

    return tone_table([value(i) for i in range(256)])


def gradient_map(dark: tuple[float, float, float], light: tuple[float, float, float]) -> Text:
    """Integer luma of the straight bytes picks a colour between two."""

    def text(d: Dialect) -> str:
        byte = {f"{x}1": f"CASE WHEN a = 255 THEN {x} ELSE least(255, {d.div(f'{x} * 255 + {d.div("a", "2")}', 'nullif(a, 0)')}) END" for x in RGB}
        level = {"l": f"least(255, {c.luma_byte(d, 'r1', 'g1', 'b1')})"}
        tone = {f"{x}9": f"CAST(least(255e0, greatest(0e0, round(({num(p)} + {num(q - p)} * (l / 255e0)) * 255e0))) AS INT)" for x, p, q in zip(RGB, dark, light, strict=True)}
        final = KEYS + ", " + ", ".join(f"CASE WHEN a = 0 THEN {x} ELSE CAST({d.div(f'{x}9 * a + 127', '255')} AS INT) END AS {x}" for x in RGB) + ", a"
        return steps("{px}", [byte, level, tone], final)

    return text


def black_white(weights: tuple[float, ...] = (0.4, 0.6, 0.4, 0.6, 0.2, 0.8), tint: tuple[float, float] | None = None) -> Text:
    """Weights of reds, yellows, greens, cyans, blues and magentas; ``tint``: hue and saturation of the grey's colour."""
    w = [num(x) for x in weights]

    def text(d: Dialect) -> str:
        mx, mn = c.high("r1", "g1", "b1"), c.low("r1", "g1", "b1")
        primary = f"CASE WHEN mx = r1 THEN {w[0]} WHEN mx = g1 THEN {w[2]} ELSE {w[4]} END"
        secondary = f"CASE WHEN mx = r1 THEN CASE WHEN g1 >= b1 THEN {w[1]} ELSE {w[5]} END WHEN mx = g1 THEN CASE WHEN r1 >= b1 THEN {w[1]} ELSE {w[3]} END ELSE CASE WHEN g1 >= r1 THEN {w[3]} ELSE {w[5]} END END"
        grey = {"grey": c.clamp(f"mn + (r1 + g1 + b1 - mx - mn - mn) * ({secondary}) + (mx - (r1 + g1 + b1 - mx - mn)) * ({primary})")}
        levels_ = [{"mx": mx, "mn": mn}, grey]
        if not tint or tint[1] <= 0:
            return pixel_map(levels_, ("grey", "grey", "grey"))
        sector = tint[0] % 360 / 60
        second = 1 - abs(sector % 2 - 1)
        share = {0: (1, second, 0), 1: (second, 1, 0), 2: (0, 1, second), 3: (0, second, 1), 4: (second, 0, 1)}.get(int(sector), (1, 0, second))
        chroma = {"ch": f"(1e0 - abs(2e0 * grey - 1e0)) * {num(tint[1])}"}
        return pixel_map([*levels_, chroma, each(lambda e, k: c.clamp(f"ch * {num(share[k])} + grey - ch / 2e0"))])

    return text


def color_balance(shadows: tuple = (0, 0, 0), midtones: tuple = (0, 0, 0), highlights: tuple = (0, 0, 0), preserve: bool = True) -> Text:
    """Shifts by three overlapping tonal weights; luminosity kept by Rec. 601."""

    def text(d: Dialect) -> str:
        def moved(e: str, k: int) -> str:
            ramp = lambda sign, at: c.clamp(f"({e} {at}) / {num(sign * 0.25)} + 0.5e0")
            dark, light = ramp(-1, "- 0.333e0"), ramp(1, "+ 0.333e0 - 1e0")
            middle = f"{ramp(1, '- 0.333e0')} * {ramp(-1, '+ 0.333e0 - 1e0')}"
            return c.clamp(f"{e} + 0.7e0 * ({num(shadows[k])} * {dark} + {num(midtones[k])} * {middle} + {num(highlights[k])} * {light})")

        moved_ = each(moved, outputs=("r2", "g2", "b2"))
        if not preserve:
            return pixel_map([moved_], ("r2", "g2", "b2"))
        ratio = {"q": f"CASE WHEN {c.luma601('r2', 'g2', 'b2')} > 0.0001e0 THEN {c.luma601('r1', 'g1', 'b1')} / {c.luma601('r2', 'g2', 'b2')} ELSE 1e0 END"}
        return pixel_map([moved_, ratio, each(lambda e, k: c.clamp(f"{e} * q"), ("r2", "g2", "b2"))])

    return text


def invert() -> Text:
    return lambda d: f"SELECT {KEYS}, " + ", ".join(f"a - {x} AS {x}" for x in RGB) + ", a FROM {px} p"


def clamp_to_alpha() -> Text:
    return lambda d: f"SELECT {KEYS}, " + ", ".join(f"least({x}, a) AS {x}" for x in RGB) + ", a FROM {px} p"


# HSL


def _hsl(least: str = "mx - mn <= 0") -> list[dict[str, str]]:
    """h (degrees), s, l of r1, g1, b1."""
    return [
        {"mx": c.high("r1", "g1", "b1"), "mn": c.low("r1", "g1", "b1")},
        {"l": "(mx + mn) / 2e0", "ch": "mx - mn"},
        {"s": "CASE WHEN ch > 0 THEN least(1e0, ch / nullif(1e0 - abs(2e0 * l - 1e0), 0)) ELSE 0e0 END", "h": c.hue_degrees("r1", "g1", "b1", "mx", "ch", 0)},
    ]


def _from_hsl(h: str, s: str, l: str) -> list[dict[str, str]]:  # noqa: E741
    """r9, g9, b9 by sectors of 60 degrees."""
    first = {"k": f"(1e0 - abs(2e0 * {l} - 1e0)) * {s}", "sector": f"{h} / 60e0"}
    second = {"k2": "k * (1e0 - abs(sector % 2e0 - 1e0))", "base": f"{l} - k / 2e0", "n": "CAST(floor(sector) AS INT)"}
    order = {"r": ("k", "k2", "0e0", "0e0", "k2", "k"), "g": ("k2", "k", "k", "k2", "0e0", "0e0"), "b": ("0e0", "0e0", "k2", "k", "k", "k2")}
    pick = lambda x: "CASE n " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(order[x][:5])) + f" ELSE {order[x][5]} END"
    return [first, second, {f"{x}9": c.clamp(f"({pick(x)}) + base") for x in RGB}]


#: For each hue range the starts and ends of falloff, range and falloff in degrees.
HUE_BANDS = {"Master": (0, 0, 0, 0), "Reds": (315, 345, 15, 45), "Yellows": (15, 45, 75, 105), "Greens": (75, 105, 135, 165), "Cyans": (135, 165, 195, 225), "Blues": (195, 225, 255, 285), "Magentas": (255, 285, 315, 345)}


def hue_response(adjustments: dict[str, tuple[float, float, float]], bands: dict[str, tuple] = HUE_BANDS) -> list[tuple[float, float, float]]:
    """Shift of hue, saturation and lightness at each degree from 0 to 360."""

    def weight(band: tuple[float, ...], hue: float) -> float:
        start, first, last, end = band
        ahead = lambda x: (x - start) % 360
        span, at, rise, flat = ahead(end), ahead(hue), ahead(first), ahead(last)
        if span <= 0:
            return 1.0
        if at > span:
            return 0.0
        if at < rise:
            return at / rise
        return 1.0 if at <= flat or span <= flat else (span - at) / (span - flat)

    return [tuple(sum(a[i] * weight(bands[name], float(degree)) for name, a in adjustments.items()) for i in range(3)) for degree in range(361)]


def hue_saturation(adjustments: dict[str, tuple[float, float, float]], colorize: tuple[float, float, float] | None = None) -> Text:
    """Hue, saturation and lightness moved by the bands that claim a hue; or all set to one hue and saturation."""

    def text(d: Dialect) -> str:
        if colorize:
            h, s, amount = num(colorize[0] % 360), num(min(1, max(0, colorize[1] / 100))), num(colorize[2] / 100)
            moved = [{"h2": h, "s2": s, "la": amount}]
        else:
            table = hue_response(adjustments)
            shift, sat, light = (d.array([num(row[i]) for row in table]) for i in range(3))
            near = "least(360, greatest(0, CAST(round(h) AS INT)))"
            moved = [
                {"at_": near},
                {"hs": d.at(shift, "at_"), "am": f"least(1e0, greatest(-1e0, {d.at(sat, 'at_')} / 100e0))", "la": f"{d.at(light, 'at_')} / 100e0"},
                {"h2": "(h + hs) % 360e0 + CASE WHEN (h + hs) % 360e0 < 0 THEN 360e0 ELSE 0e0 END", "s2": "CASE WHEN am <= 0 THEN greatest(0e0, s * (1e0 + am)) WHEN am >= 1 THEN CASE WHEN s > 0 THEN 1e0 ELSE 0e0 END ELSE least(1e0, s / nullif(1e0 - am, 0)) END"},
            ]
        lightness = {"l2": c.clamp("CASE WHEN la >= 0 THEN l + (1e0 - l) * least(1e0, la) ELSE l * (1e0 + greatest(-1e0, la)) END")}
        return pixel_map([*_hsl(), *moved, lightness, *_from_hsl("h2", "s2", "l2")])

    return text


# Raw development: light, colour, calibration, optics, effects


def _to_luminance(target: str, names: tuple[str, str, str], out: tuple[str, str, str]) -> list[dict[str, str]]:
    """Scales channels so that their luma becomes ``target`` (over ``yy``); black is lifted to grey."""
    q = out[0][:1] + "_" + out[0][1:]
    first = {f"y{q}": c.luma(*names)}
    second = {f"t{q}": c.clamp(target.replace("yy", f"y{q}"))}
    y, t = f"y{q}", f"t{q}"
    third = {o: f"CASE WHEN abs({t} - {y}) < 1e-8 THEN {i} WHEN {y} < 1e-8 THEN CASE WHEN {t} > {y} THEN {t} ELSE {i} END ELSE {c.clamp(f'{i} * ({t} / nullif({y}, 0))')} END" for i, o in zip(names, out, strict=True)}
    return [first, second, third]


def _named(n: int) -> tuple[str, str, str]:
    return f"r{n}", f"g{n}", f"b{n}"


def _saturate(names: tuple[str, str, str], out: tuple[str, str, str], factor: str, luma: str) -> list[dict[str, str]]:
    return [{luma: c.luma(*names)}, {o: c.clamp(f"{luma} + ({i} - {luma}) * ({factor})") for i, o in zip(names, out, strict=True)}]


def camera_raw(gains: tuple[float, float, float] = (1, 1, 1), exposure: float = 0, contrast: float = 0, highlights: float = 0, shadows: float = 0, whites: float = 0, blacks: float = 0, vibrance: float = 0, saturation: float = 0) -> Text:
    """White balance gains and exposure in light; contrast, four tonal ranges, vibrance that spares skin, and saturation in code values."""

    def tone(kind: str, amount: float) -> str:
        a = num(amount / 100)
        t = c.clamp("(yy - 0.5e0) / 0.5e0") if kind == "highlights" else c.clamp("(0.5e0 - yy) / 0.5e0")
        if kind == "highlights":
            return f"yy + {a} * {t} * {t} * " + ("(1e0 - yy)" if amount >= 0 else "(yy - 0.5e0)")
        if kind == "shadows":
            return f"yy + {a} * {t} * {t} * " + ("(0.5e0 - yy)" if amount >= 0 else "yy")
        if kind == "whites":
            return f"CASE WHEN yy <= 0.75e0 THEN yy ELSE {c.clamp(f'0.75e0 + (yy - 0.75e0) * {num(1 + amount / 100)}')} END"
        return f"CASE WHEN yy >= 0.25e0 THEN yy ELSE {c.clamp(f'0.25e0 + (yy - 0.25e0) * {num(1 - amount / 100)}')} END"

    def text(d: Dialect) -> str:
        light = 2.0**exposure
        out = [{f"{x}2": c.clamp(f"({c.linear(f'{x}1')}) * {num(g * light)}") for x, g in zip(RGB, gains, strict=True)}]
        out += [{f"{x}3": c.encoded(f"{x}2") for x in RGB}, {f"{x}4": c.clamp(f"0.5e0 + ({x}3 - 0.5e0) * {num(1 + contrast / 100)}") for x in RGB}]
        n = 4
        for kind, amount in (("highlights", highlights), ("shadows", shadows), ("whites", whites), ("blacks", blacks)):
            out += _to_luminance(tone(kind, amount), _named(n), _named(n + 10))
            n += 10
        r, g, b = _named(n)
        out += [{"mx": c.high(r, g, b), "mn": c.low(r, g, b)}, {"ch": "mx - mn"}, {"sat": "CASE WHEN mx <= 1e-8 THEN 0e0 ELSE ch / nullif(mx, 0) END", "hue": c.hue_degrees(r, g, b, "mx", "ch", 1e-8)}]
        out += [{"skin": f"CASE WHEN hue >= 10e0 AND hue <= 30e0 THEN (hue - 10e0) / 20e0 WHEN hue > 30e0 AND hue <= 50e0 THEN (50e0 - hue) / 20e0 ELSE 0e0 END * {c.clamp('(sat - 0.15e0) / 0.35e0')}"}]
        spare = "(1e0 - 0.7e0 * skin)" if vibrance > 0 else "1e0"
        out += _saturate((r, g, b), _named(98), f"1e0 + {num(vibrance / 100)} * (1e0 - sat) * {spare}", "lu1")
        out += _saturate(_named(98), _named(99), num(1 + saturation / 100), "lu2")
        return pixel_map(out, _named(99))

    return text


def calibration(tint: float = 0, red: tuple[float, float] = (0, 0), green: tuple[float, float] = (0, 0), blue: tuple[float, float] = (0, 0), version: int = 6) -> Text:
    """Shadow tint, and hue and saturation of the primaries; older process versions act less."""
    scale = {0: 0.55, 1: 0.55, 2: 0.65, 3: 0.75, 4: 0.85, 5: 0.92}.get(version, 1.0)

    def text(d: Dialect) -> str:
        turn = tint / 100 * scale * 0.06 * 360
        shifts = [x[0] / 100 * 15 * scale for x in (red, green, blue)]
        factors = [1 + x[1] / 100 * 0.45 * scale for x in (red, green, blue)]
        pick = lambda values: f"CASE WHEN ch <= 1e-5 THEN {{}} WHEN r1 >= g1 AND r1 >= b1 THEN {num(values[0])} WHEN g1 >= r1 AND g1 >= b1 THEN {num(values[1])} ELSE {num(values[2])} END"
        wrap = lambda e: f"CASE WHEN {e} < 0 THEN {e} + 360e0 WHEN {e} >= 360 THEN {e} - 360e0 ELSE {e} END"
        moved = [{"h_a": f"CASE WHEN l < 0.35e0 THEN h + {num(turn)} ELSE h END"}, {"h_b": wrap("h_a")}, {"h_c": "h_b + " + pick(shifts).format("0e0"), "s2": c.clamp("s * " + pick(factors).format("1e0"))}, {"h2": wrap("h_c")}]
        return pixel_map([*_hsl(), *moved, *_from_hsl("h2", "s2", "l")])

    return text


def dehaze(amount: float) -> Text:
    d_ = amount / 100

    def text(d: Dialect) -> str:
        pivot = 0.45 - 0.1 * max(d_, 0)
        first = c.clamp(f"{num(pivot)} + (yy - 0.45e0) * {num(1 + 0.8 * d_)}")
        target = f"{first} + {num(-d_)} * (1e0 - {first}) * 0.45e0" if d_ < 0 else f"{first} - {num(d_)} * greatest(0e0, 0.4e0 - {first})"
        return pixel_map([*_to_luminance(target, _named(1), _named(2)), *_saturate(_named(2), _named(9), num(1 + 0.7 * d_), "lu")])

    return text


def vignette_mask(width: float, height: float, midpoint: float, roundness: float, feather: float, x: str = "(x + 0.5e0)", y: str = "(y + 0.5e0)") -> list[dict[str, str]]:
    """Columns ending in ``mask``: 0 in the frame's middle, 1 past its edges."""
    shape, start, soft = (1 - roundness / 100) * 0.5, midpoint / 100 * 0.85, max(0.05, feather / 100)
    return [
        {"nx": f"{x} / {num(width)} * 2e0 - 1e0", "ny": f"{y} / {num(height)} * 2e0 - 1e0"},
        {"circle": f"sqrt(nx * nx + ny * ny) / {num(math.sqrt(2))}", "square": "greatest(abs(nx), abs(ny))"},
        {"t_": c.clamp(f"(circle + (square - circle) * {num(shape)} - {num(start)}) / {num(soft)}")},
        {"mask": c.smoothstep("t_")},
    ]


def vignette(width: int, height: int, amount: float, midpoint: float = 50, roundness: float = 0, feather: float = 50, highlights: float = 0, style: int = 0) -> Text:
    """Styles: 0 spares bright pixels as it darkens, 1 takes colour away as well, 2 paints only."""

    def text(d: Dialect) -> str:
        bright = c.clamp(f"({c.luma()} - 0.45e0) / 0.55e0")
        eased = f" * CASE WHEN {num(amount)} < 0 THEN 1e0 - {num(highlights / 100)} * {bright} ELSE 1e0 END" if style == 0 else ""
        out = [*vignette_mask(width, height, midpoint, roundness, feather), {"ef": f"{num(amount / 100)} * mask{eased}"}]
        out += [each(lambda e, k: f"CASE WHEN ef < 0 THEN {e} * (1e0 + ef) ELSE {e} + (1e0 - {e}) * ef END", outputs=_named(2))]
        if style == 1:
            out += [{"lu": c.luma("r2", "g2", "b2"), "q": f"1e0 - 0.75e0 * mask * {num(abs(amount / 100))}"}]
            return pixel_map([*out, each(lambda e, k: f"CASE WHEN mask > 0 THEN {c.clamp(f'lu + ({e} - lu) * q')} ELSE {e} END", _named(2))])
        return pixel_map(out, _named(2))

    return text


def colored_vignette(frame: tuple[float, float, float, float], amount: float, color: tuple[float, float, float], midpoint: float = 50, roundness: float = 0, feather: float = 50, highlights: float = 0, fills_clear: bool = False) -> Text:
    """A colour painted towards a frame's edges; it may take hold of clear pixels too."""
    fx, fy, fw, fh = frame

    def text(d: Dialect) -> str:
        strength = min(1.0, max(0.0, amount / 100))
        straight0 = {f"{x}1": f"CASE WHEN a = 0 THEN 0e0 ELSE {c.straight(x)} END" for x in RGB}
        bright = {"bright": f"CASE WHEN a = 0 THEN 0e0 ELSE {c.clamp(f'({c.luma()} - 0.45e0) / 0.55e0')} END"}
        mask = vignette_mask(fw, fh, midpoint, roundness, feather, f"(x + 0.5e0 - {num(fx)})", f"(y + 0.5e0 - {num(fy)})")
        effect = {"ef": f"{num(strength)} * mask * (1e0 - {num(highlights / 100)} * bright)"}
        if not fills_clear:
            return steps("{px}", [straight0, bright, *mask, effect, {f"{x}9": f"{x}1 + ({num(k)} - {x}1) * ef" for x, k in zip(RGB, color, strict=True)}], _written())
        over = {"oa": "a / 255e0 + ef * (1e0 - a / 255e0)"}
        mixed = {f"{x}9": f"({num(k)} * ef + {x}1 * (a / 255e0) * (1e0 - ef)) / nullif(oa, 0)" for x, k in zip(RGB, color, strict=True)}
        alpha = {"a9": "CASE WHEN mask <= 0 OR oa <= 0 THEN a ELSE CAST(least(255e0, round(oa * 255e0)) AS INT) END"}
        final = KEYS + ", " + ", ".join(f"CASE WHEN mask <= 0 OR oa <= 0 THEN {x} ELSE CAST(least(a9 * 1e0, greatest(0e0, round({x}9 * a9))) AS INT) END AS {x}" for x in RGB) + ", a9 AS a"
        return steps("{px}", [straight0, bright, *mask, effect, over, mixed, alpha], final)

    return text


def lens_vignette(width: int, height: int, amount: float, midpoint: float = 50) -> Text:
    start = midpoint / 100 * 0.85

    def text(d: Dialect) -> str:
        out = [{"nx": f"(x + 0.5e0) / {num(width)} * 2e0 - 1e0", "ny": f"(y + 0.5e0) / {num(height)} * 2e0 - 1e0"}, {"t_": c.clamp(f"(sqrt(nx * nx + ny * ny) / {num(math.sqrt(2))} - {num(start)}) / 0.35e0")}, {"lift": f"{num(amount / 100)} * {c.smoothstep('t_')}"}]
        return pixel_map([*out, each(lambda e, k: f"CASE WHEN lift > 0 THEN {c.clamp(f'{e} + (1e0 - {e}) * lift')} ELSE {e} * (1e0 + lift) END")])

    return text


def defringe(purple: float = 0, purple_hues: tuple[float, float] = (270, 330), green: float = 0, green_hues: tuple[float, float] = (60, 120)) -> Text:
    def text(d: Dialect) -> str:
        p = f"CASE WHEN {c.hue_between('hue', *purple_hues)} THEN {num(max(0, purple) / 100)} ELSE 0e0 END"
        g = f"CASE WHEN {c.hue_between('hue', *green_hues)} THEN {num(max(0, green) / 100)} ELSE 0e0 END"
        out = [{"mx": c.high(*_named(1)), "mn": c.low(*_named(1))}, {"ch": "mx - mn"}, {"hue": c.hue_degrees(*_named(1), "mx", "ch")}, {"q": f"CASE WHEN ch < 1e-6 THEN 1e0 ELSE 1e0 - greatest({p}, {g}) * (ch / nullif(mx, 0)) END", "lu": c.luma()}]
        return pixel_map([*out, each(lambda e, k: f"CASE WHEN q = 1 THEN {e} ELSE {c.clamp(f'lu + ({e} - lu) * q')} END")])

    return text


def clip_overlay(shadows: bool = True, highlights: bool = True) -> Text:
    """Clipped shadows turn blue, clipped highlights red."""

    def text(d: Dialect) -> str:
        dark = " OR ".join(f"{x}1 <= {num(0.5 / 255)}" for x in RGB)
        light = " OR ".join(f"{x}2 >= {num(254.5 / 255)}" for x in RGB)
        one = {f"{x}2": f"CASE WHEN {dark} THEN {x}1 * 0.35e0{' + 0.65e0' if x == 'b' else ''} ELSE {x}1 END" if shadows else f"{x}1" for x in RGB}
        two = {f"{x}9": f"CASE WHEN {light} THEN {x}2 * 0.35e0{' + 0.65e0' if x == 'r' else ''} ELSE {x}2 END" if highlights else f"{x}2" for x in RGB}
        return pixel_map([one, two])

    return text


# Noise, grain, dithers


def _u32(e: str) -> str:
    return f"(CAST({e} AS BIGINT) & 4294967295)"


def add_noise(amount: float, gaussian: bool = False, mono: bool = False, seed: int = 7, origin: tuple[int, int] = (0, 0)) -> Text:
    """A hash of place and seed gives each channel a uniform or normal offset."""
    spread = amount / 100 * 127.5

    def text(d: Dialect) -> str:
        out = [{"py": _u32(f"y + {origin[1]}"), "px_": _u32(f"x + {origin[0]}")}]
        out += c.hashed(d, d.mul32("py", 0x85EBCA6B), "hy")
        out += [{"kx": d.xor(d.mul32("px_", 0x9E3779B9), "hy")}, *c.hashed(d, "kx", "hx"), {"ks": d.xor(str(seed), "hx")}, *c.hashed(d, "ks", "base_")]
        final = {}
        for k, x in enumerate(RGB):
            key = f"key_{x}"
            out += [{key: "base_" if mono else f"((base_ + {k * 0x9E3779B9 & 0xFFFFFFFF}) & 4294967295)"}, *c.hashed(d, key, f"u_{x}")]
            unit = f"({d.shr(f'u_{x}', 8)} / 16777216e0)"
            if gaussian:
                out += [{f"alt_{x}": d.xor(key, str(0x68E31DA4))}, *c.hashed(d, f"alt_{x}", f"v_{x}")]
                noise = f"sqrt(-2e0 * ln(1e0 - {unit})) * cos(6.2831853e0 * ({d.shr(f'v_{x}', 8)} / 16777216e0)) * {num(spread * 2 / 3)}"
            else:
                noise = f"({unit} * 2e0 - 1e0) * {num(spread)}"
            final[f"{x}9"] = f"least(255e0, greatest(0e0, {x} * 255e0 / nullif(a, 0) + {noise}))"
        done = KEYS + ", " + ", ".join(f"CASE WHEN a = 0 THEN {x} ELSE CAST(round({x}9 * a / 255e0) AS INT) END AS {x}" for x in RGB) + ", a"
        return steps("{px}", [*out, final], done)

    return text


def grain(amount: float, size: float = 2, roughness: float = 40, seed: int = 7, origin: tuple[float, float] = (0, 0), unit: float = 1) -> Text:
    """Smooth noise on a lattice of ``size`` and a finer one, strongest in midtones."""
    strength, rough, fine = min(1.0, amount / 100) * 0.35 * 255, min(1.0, max(0.0, roughness / 100)), max(0.5, size * 0.35)

    def field(d: Dialect, name: str, scale: float, seed: str) -> list[dict[str, str]]:
        out = [
            {f"{name}u": f"({num(origin[0])} + (x + 0.5e0) * {num(unit)}) / {num(scale)}", f"{name}v": f"({num(origin[1])} + (y + 0.5e0) * {num(unit)}) / {num(scale)}"},
            {f"{name}x": f"floor({name}u)", f"{name}y": f"floor({name}v)"},
            {f"{name}tx": c.smoothstep(f"({name}u - {name}x)"), f"{name}ty": c.smoothstep(f"({name}v - {name}y)")},
        ]
        for j in (0, 1):
            row = f"{name}r{j}"
            out += [{f"{row}k": d.xor(d.mul32(_u32(f"{name}y + {j}"), 0x85EBCA77), seed)}, *c.hashed(d, f"{row}k", row)]
            for i in (0, 1):
                cell = f"{name}c{i}{j}"
                out += [{f"{cell}k": d.xor(d.mul32(_u32(f"{name}x + {i}"), 0x9E3779B1), row)}, *c.hashed(d, f"{cell}k", cell)]
        value = lambda i, j: f"(({name}c{i}{j} & 65535) / 65535e0 + {d.shr(f'{name}c{i}{j}', 16)} / 65535e0 - 1e0)"
        across = lambda j: f"({value(0, j)} + ({value(1, j)} - {value(0, j)}) * {name}tx)"
        return [*out, {name: f"({across(0)} + ({across(1)} - {across(0)}) * {name}ty) * 1.6e0"}]

    def text(d: Dialect) -> str:
        seeds = [{"sd": d.xor(str(seed), str(0xA511E9B3))}, *c.hashed(d, "sd", "fs")]
        out = [*seeds, *field(d, "n", size, str(seed)), *field(d, "m", fine, "fs")]
        out += [{f"{x}1": f"{x} * 255e0 / nullif(a, 0)" for x in RGB}, {"lv": f"least(1e0, {c.luma()} / 255e0)"}]
        out += [{"dl": f"(n + (m - n) * {num(rough)}) * {num(strength)} * (0.4e0 + 2.4e0 * lv * (1e0 - lv))"}]
        final = KEYS + ", " + ", ".join(f"CASE WHEN a = 0 THEN {x} ELSE CAST(floor(least(255e0, greatest(0e0, {x}1 + dl)) * (a / 255e0) + 0.5e0) AS INT) END AS {x}" for x in RGB) + ", a"
        return steps("{px}", out, final)

    return text


def bayer(side: int) -> list[int]:
    """The recursive ordered-dither matrix, row by row; smaller ones are its nested corners."""
    m = [[0]]
    while len(m) < side:
        m = [[4 * v for v in row] + [4 * v + 2 for v in row] for row in m] + [[4 * v + 3 for v in row] + [4 * v + 1 for v in row] for row in m]
    return [v for row in m for v in row]


def tone_curve(e: str, density: float = 0, contrast: float = 0) -> str:
    """Density as a gamma, contrast about middle grey."""
    slope = 1 / (1 - 0.95 * contrast) if contrast >= 0 else 1 + contrast
    return c.clamp(f"(pow({c.clamp(e)}, {num(2 ** (density * 1.5))}) - 0.5e0) * {num(slope)} + 0.5e0")


def _dithered(d: Dialect, levels_: list[dict[str, str]], mark: str) -> str:
    """Black and white from ``mark``, by the tone ``tn``."""
    return pixel_map([{"tn": tone_curve(c.luma())}, *levels_, {"q": mark}], ("q", "q", "q"))


def ordered_dither(side: int = 8, levels_: int = 2) -> Text:
    def text(d: Dialect) -> str:
        cell = d.at(d.array([str(v) for v in bayer(side)]), f"(y % {side}) * {side} + x % {side}")
        mark = f"least({num(levels_ - 1)}, floor({c.clamp('tn')} * {num(levels_ - 1)} + ({cell} + 0.5e0) / {num(side * side)})) / {num(levels_ - 1)}"
        return _dithered(d, [], mark)

    return text


def halftone(shape: str = "dots", cell: float = 4, degrees: float = 45) -> Text:
    """Dots, lines or diamonds that grow from a rotated cell's middle as the tone darkens."""
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    grown = {"dots": "3.14159265e0 * (u * u + v * v)", "lines": "abs(v) * 2e0", "diamonds": "abs(u) + abs(v)"}[shape]

    def text(d: Dialect) -> str:
        turned = {"u0": f"((x + 0.5e0) * {num(cos)} + (y + 0.5e0) * {num(sin)}) / {num(cell)}", "v0": f"((y + 0.5e0) * {num(cos)} - (x + 0.5e0) * {num(sin)}) / {num(cell)}"}
        inner = {"u": "u0 - floor(u0) - 0.5e0", "v": "v0 - floor(v0) - 0.5e0"}
        return _dithered(d, [turned, inner], f"CASE WHEN {grown} <= 1e0 - tn THEN 0e0 ELSE 1e0 END")

    return text


#: Fixed values, which must be these for right results: 8 x 8 fill patterns, a byte for each row, from the sparsest to the fullest.
PATTERNS = (
    (0x00, 0x00, 0x00, 0x00, 0x00, 0x00, 0x00, 0x00),
    (0x80, 0x00, 0x00, 0x00, 0x08, 0x00, 0x00, 0x00),
    (0x88, 0x00, 0x22, 0x00, 0x88, 0x00, 0x22, 0x00),
    (0x80, 0x40, 0x20, 0x10, 0x08, 0x04, 0x02, 0x01),
    (0x88, 0x22, 0x88, 0x22, 0x88, 0x22, 0x88, 0x22),
    (0x00, 0xFF, 0x00, 0x00, 0x00, 0xFF, 0x00, 0x00),
    (0x11, 0x22, 0x44, 0x88, 0x11, 0x22, 0x44, 0x88),
    (0xAA, 0x00, 0xAA, 0x00, 0xAA, 0x00, 0xAA, 0x00),
    (0x88, 0x55, 0x22, 0x55, 0x88, 0x55, 0x22, 0x55),
    (0xFF, 0x80, 0x80, 0x80, 0xFF, 0x08, 0x08, 0x08),
    (0xAA, 0x55, 0xAA, 0x55, 0xAA, 0x55, 0xAA, 0x55),
    (0x81, 0x42, 0x24, 0x18, 0x18, 0x24, 0x42, 0x81),
    (0x77, 0xAA, 0xDD, 0xAA, 0x77, 0xAA, 0xDD, 0xAA),
    (0xEE, 0xDD, 0xBB, 0x77, 0xEE, 0xDD, 0xBB, 0x77),
    (0x77, 0xFF, 0xDD, 0xFF, 0x77, 0xFF, 0xDD, 0xFF),
    (0x7F, 0xFF, 0xFF, 0xFF, 0xF7, 0xFF, 0xFF, 0xFF),
    (0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF),
)


def pattern_fill() -> Text:
    """The pattern whose place among all is the darkness; its bits are marked."""
    rows = [row for pattern in PATTERNS for row in pattern]

    def text(d: Dialect) -> str:
        which = f"CAST(least({num(len(PATTERNS) - 1)}, floor((1e0 - tn) * {num(len(PATTERNS) - 1)} + 0.5e0)) AS INT)"
        bits = d.at(d.array([str(v) for v in rows]), "pt * 8 + y % 8")
        power = d.at(d.array([str(1 << (7 - i)) for i in range(8)]), "x % 8")
        return _dithered(d, [{"pt": f"coalesce({which}, 0)"}, {"bit": f"{d.div(bits, power)} % 2"}], "CASE WHEN bit = 1 THEN 0e0 ELSE 1e0 END")

    return text


def quantize(levels_: int) -> Text:
    return lambda d: pixel_map([each(lambda e, k: c.quantised(e, levels_))])


def dot_matrix(cell: int = 4, gap: float = 0.2) -> Text:
    """Round cells with dark gaps between them."""

    def text(d: Dialect) -> str:
        u, v = (f"(({x} % {cell} + 0.5e0) / {num(cell)} - 0.5e0)" for x in ("x", "y"))
        return pixel_map([{"inside": f"CASE WHEN sqrt({u} * {u} + {v} * {v}) <= {num(0.5 * (1 - gap))} THEN 1e0 ELSE 0e0 END"}, each(lambda e, k: f"{e} * inside")])

    return text


# Filling


def fill(color: tuple[int, int, int], opacity: float = 1.0) -> Text:
    """A colour drawn over all pixels."""
    s = opacity

    def text(d: Dialect) -> str:
        over = ", ".join(f"CAST(round({num(k * s)} + {x} * {num(1 - s)}) AS INT) AS {x}" for x, k in zip(RGB, color, strict=True))
        return f"SELECT {KEYS}, {over}, CAST(round({num(255 * s)} + a * {num(1 - s)}) AS INT) AS a FROM {{px}} p"

    return text


def gradient(first: tuple[int, int, int], last: tuple[int, int, int], start: tuple[float, float], end: tuple[float, float], radial: bool = False) -> Text:
    """Two stops between two points, or around the first; both ends go on."""
    dx, dy = end[0] - start[0], end[1] - start[1]

    def text(d: Dialect) -> str:
        u, v = f"(x + 0.5e0 - {num(start[0])})", f"(y + 0.5e0 - {num(start[1])})"
        along = f"sqrt({u} * {u} + {v} * {v}) / {num(math.hypot(dx, dy))}" if radial else f"({u} * {num(dx)} + {v} * {num(dy)}) / {num(dx * dx + dy * dy)}"
        mixed = ", ".join(f"CAST(round({num(p)} + {num(q - p)} * t_) AS INT) AS {x}" for x, p, q in zip(RGB, first, last, strict=True))
        return f"SELECT {KEYS}, {mixed}, 255 AS a FROM (SELECT *, {c.clamp(along)} AS t_ FROM {{px}} p) t"

    return text


#: Operators by the name a layer gives them; adjustments that return their input for neutral settings are left out of plans by callers.
ADJUSTMENTS = {"Levels": levels, "Curves": curves, "Exposure": exposure, "Gradient Map": gradient_map, "Black & White": black_white, "Color Balance": color_balance, "Invert": invert, "Hue/Saturation": hue_saturation, "Camera Raw": camera_raw, "Noise": add_noise, "Grain": grain, "Vignette": vignette}


def adjust(px: DataFrame, kind: str, **settings) -> DataFrame:
    """Dispatch by kind."""
    return apply(px, ADJUSTMENTS[kind](**settings))
