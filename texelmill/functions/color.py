"""Colour arithmetic as plain ``Column`` expressions.

Channels are INT 0..255. Nothing here shuffles and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: sRGB (D65) to XYZ, the D65 white point and the CIELAB constants -------------------------
SRGB_TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
D65_WHITE = (0.95047, 1.0, 1.08883)
LAB_EPSILON = 0.008856
LAB_SLOPE = 7.787
LINEAR_LUMINANCE = (0.2126, 0.7152, 0.0722)
# ---- fixed values: 8x8 ordered-dither thresholds, row by row ------------------------------------------------
BAYER_8X8 = (
    0, 48, 12, 60, 3, 51, 15, 63,
    32, 16, 44, 28, 35, 19, 47, 31,
    8, 56, 4, 52, 11, 59, 7, 55,
    40, 24, 36, 20, 43, 27, 39, 23,
    2, 50, 14, 62, 1, 49, 13, 61,
    34, 18, 46, 30, 33, 17, 45, 29,
    10, 58, 6, 54, 9, 57, 5, 53,
    42, 26, 38, 22, 41, 25, 37, 21,
)
# ---- fixed values: colour weights of the palette reducer ----------------------------------------------------
FREQUENCY_EXPONENT = 0.85
CHROMA_BOOST = 0.6
COVERAGE_BOOST = 0.25
# -------------------------------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside one expression."""
    return F.transform(F.array(value), body)[0]


def linear_channel(c: Column) -> Column:
    """sRGB byte to linear light."""
    s = c / F.lit(255.0)
    return F.when(s > 0.04045, F.pow((s + 0.055) / 1.055, F.lit(2.4))).otherwise(s / 12.92)


def with_lab(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", prefix: str = "lab_") -> DataFrame:
    """Add CIELAB columns ``<prefix>l, <prefix>a, <prefix>b`` for an RGB triple."""
    lin = [f"_lin_{i}" for i in range(3)]
    fxyz = [f"_f_{i}" for i in range(3)]
    out = df.withColumns({n: linear_channel(F.col(c)) for n, c in zip(lin, (r, g, b))})

    def f(row: tuple[float, float, float], white: float) -> Column:
        t = sum((F.col(n) * w for n, w in zip(lin[1:], row[1:])), F.col(lin[0]) * row[0]) / white
        return F.when(t > LAB_EPSILON, F.cbrt(t)).otherwise(t * LAB_SLOPE + 16.0 / 116.0)

    out = out.withColumns({n: f(row, w) for n, row, w in zip(fxyz, SRGB_TO_XYZ, D65_WHITE)})
    fx, fy, fz = (F.col(n) for n in fxyz)
    return out.withColumns(
        {prefix + "l": fy * 116.0 - 16.0, prefix + "a": (fx - fy) * 500.0, prefix + "b": (fy - fz) * 200.0}
    ).drop(*lin, *fxyz)


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue_angle(a: Column, b: Column) -> Column:
    """Hue in degrees, 0 <= h < 360."""
    deg = F.degrees(F.atan2(b, a))
    return F.when(deg < 0, deg + 360.0).otherwise(deg)


def delta_e76(l1: Column, a1: Column, b1: Column, l2: Column, a2: Column, b2: Column) -> Column:
    return F.sqrt(F.pow(l1 - l2, 2) + F.pow(a1 - a2, 2) + F.pow(b1 - b2, 2))


# CIEDE2000 in five steps; each step maps a name lookup to new named columns.
def _de_step1(v):
    c7 = F.pow((chroma(v("a1"), v("b1")) + chroma(v("a2"), v("b2"))) / 2, 7)
    return {"c7": c7}


def _de_step2(v):
    g = F.lit(1.5) - F.sqrt(v("c7") / (v("c7") + 6103515625.0)) * 0.5
    return {"p1": v("a1") * g, "p2": v("a2") * g}


def _de_step3(v):
    return {
        "c1": chroma(v("p1"), v("b1")),
        "c2": chroma(v("p2"), v("b2")),
        "h1": hue_angle(v("p1"), v("b1")),
        "h2": hue_angle(v("p2"), v("b2")),
    }


def _de_step4(v):
    grey = v("c1") * v("c2") == 0
    diff, total = v("h2") - v("h1"), v("h1") + v("h2")
    far = F.abs(diff) > 180
    dh = F.when(grey, 0.0).when(~far, diff).when(diff > 180, diff - 360).otherwise(diff + 360)
    hm = F.when(grey, total).when(~far, total / 2).when(total < 360, total / 2 + 180).otherwise(total / 2 - 180)
    return {
        "dh": F.sqrt(v("c1") * v("c2")) * F.sin(F.radians(dh) / 2) * 2,
        "hm": hm,
        "cm": (v("c1") + v("c2")) / 2,
        "lm": F.pow((v("l1") + v("l2")) / 2 - 50, 2),
    }


def _de_step5(v):
    h, c7 = v("hm"), F.pow(v("cm"), 7)

    def cos(times: int, shift: float) -> Column:
        return F.cos(F.radians(h * times + shift))

    t = F.lit(1.0) - cos(1, -30.0) * 0.17 + cos(2, 0.0) * 0.24 + cos(3, 6.0) * 0.32 - cos(4, -63.0) * 0.20
    turn = F.radians(F.exp(-F.pow((h - 275) / 25, 2)) * 60)
    return {
        "tl": (v("l2") - v("l1")) / (v("lm") * 0.015 / F.sqrt(v("lm") + 20) + 1.0),
        "tc": (v("c2") - v("c1")) / (v("cm") * 0.045 + 1.0),
        "th": v("dh") / (v("cm") * t * 0.015 + 1.0),
        "rt": -F.sin(turn) * F.sqrt(c7 / (c7 + 6103515625.0)) * 2,
    }


def _de_total(v) -> Column:
    tl, tc, th = v("tl"), v("tc"), v("th")
    return F.sqrt(F.greatest(tl * tl + tc * tc + th * th + v("rt") * tc * th, F.lit(0.0)))


_DE_STEPS = (_de_step1, _de_step2, _de_step3, _de_step4, _de_step5)
_DE_INPUTS = ("l1", "a1", "b1", "l2", "a2", "b2")


def with_delta_e2000(df: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], out: str) -> DataFrame:
    """Add the CIEDE2000 difference of two Lab triples of the same row as nested projections (codegen path)."""
    df = df.withColumns({f"_de_{n}": F.col(c) for n, c in zip(_DE_INPUTS, first + second)})
    look = lambda n: F.col(f"_de_{n}")
    for step in _DE_STEPS:
        df = df.withColumns({f"_de_{n}": c for n, c in step(look).items()})
    return df.withColumn(out, _de_total(look)).drop(*[c for c in df.columns if c.startswith("_de_")])


def delta_e2000(*lab: Column) -> Column:
    """CIEDE2000 as one expression (l1, a1, b1, l2, a2, b2); usable inside array lambdas."""

    def run(known: dict[str, Column], rest) -> Column:
        if not rest:
            return _de_total(known.__getitem__)
        made = rest[0](known.__getitem__)
        names = list(made)
        packed = F.struct(*[c.alias(n) for n, c in made.items()])
        return let(packed, lambda s: run({**known, **{n: s[n] for n in names}}, rest[1:]))

    return run(dict(zip(_DE_INPUTS, lab)), _DE_STEPS)


def with_hsv(df: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Add ``h`` in [0,1), ``s``, ``v``. When two channels share the maximum the later one decides the hue."""
    df = df.withColumns({"_hi": F.greatest(r, g, b), "_lo": F.least(r, g, b)})
    rc, gc, bc, hi, d = F.col(r), F.col(g), F.col(b), F.col("_hi"), F.col("_hi") - F.col("_lo")
    sextant = (
        F.when(d == 0, 0.0)
        .when(bc == hi, (rc - gc) / d + 4.0)
        .when(gc == hi, (bc - rc) / d + 2.0)
        .otherwise(F.pmod((gc - bc) / d, F.lit(6.0)))
    )
    return df.withColumns(
        {"h": F.pmod(sextant / 6.0, F.lit(1.0)), "s": F.when(hi > 0, d / hi).otherwise(0.0), "v": hi / 255.0}
    ).drop("_hi", "_lo")


def luma601(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")


def grey_lab(lab_l: Column) -> Column:
    """8-bit lightness."""
    return F.round(lab_l * 255.0 / 100.0).cast("int")


def linear_luminance(r: Column, g: Column, b: Column) -> Column:
    wr, wg, wb = LINEAR_LUMINANCE
    return linear_channel(r) * wr + linear_channel(g) * wg + linear_channel(b) * wb


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """24-bit key; ordering by it equals ordering by (r, g, b)."""
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def unpack_rgb(key: Column) -> dict[str, Column]:
    return {
        "r": F.shiftright(key, 16).bitwiseAND(255),
        "g": F.shiftright(key, 8).bitwiseAND(255),
        "b": key.bitwiseAND(255),
    }


def color3_to_argb(r: Column, g: Column, b: Column) -> Column:
    """Unit floats to opaque packed ARGB (LONG)."""

    def byte(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c * 255.0).cast("long"))).cast("long")

    return byte(r) * 65536 + byte(g) * 256 + byte(b) + F.lit(255 * 16777216)


def argb_to_color3(argb: Column) -> dict[str, Column]:
    parts = unpack_rgb(argb)
    return {n: c / F.lit(255.0) for n, c in parts.items()}


def index_to_display(idx: Column, size: Column | int) -> Column:
    """Stretch palette indices 0..size-1 over 0..255, truncating; a single-entry palette shows 0."""
    k = F.lit(size) if isinstance(size, int) else size
    return F.when(k > 1, F.floor(idx * 255 / F.greatest(k - 1, F.lit(1)))).otherwise(0).cast("int")


def eff_weight(freq: Column, chroma_: Column, chroma_max: Column, coverage: Column) -> Column:
    boost = chroma_ / F.greatest(chroma_max, F.lit(1e-6)) * CHROMA_BOOST + 1.0
    return F.pow(freq, FREQUENCY_EXPONENT) * boost + coverage * COVERAGE_BOOST


def hue_bin(deg: Column, bins: int = 24) -> Column:
    return F.pmod(F.floor(deg / (360.0 / bins)), F.lit(bins)).cast("int")


def hue_value_bin(h: Column, s: Column, bins: int = 12, min_saturation: float = 0.05) -> Column:
    """Bin of an HSV hue in [0,1); weakly saturated colours share the extra bin ``bins``."""
    return F.when(s < min_saturation, bins).otherwise(F.least(F.floor(h * bins), F.lit(bins - 1))).cast("int")


def bayer_dither(idx: Column, x: Column, y: Column, size: int, amount: float) -> Column:
    """Ordered dither of palette indices."""
    if size <= 1 or amount <= 0:
        return idx
    table = F.array(*[F.lit((t + 0.5) / 64.0) for t in BAYER_8X8])
    cell = F.pmod(y, F.lit(8)) * 8 + F.pmod(x, F.lit(8)) + 1
    moved = idx / F.lit(float(size - 1)) + (F.element_at(table, cell.cast("int")) - 0.5) * amount
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved))
    return F.bround(F.round(unit * float(size - 1), 9)).cast("int")


def fit_scale(w: Column, h: Column, max_w: Column, max_h: Column) -> Column:
    """Shrink factor that fits (w, h) in the box; never above 1."""
    return F.least(F.lit(1.0), max_w / w, max_h / h)


def fit_dims(w: Column, h: Column, max_side: int) -> dict[str, Column]:
    return fit_within(w, h, max_side, max_side)


def fit_within(w: Column, h: Column, max_w: int, max_h: int) -> dict[str, Column]:
    """New width and height: aspect kept, no enlargement, half-to-even rounding, at least one pixel."""
    k = fit_scale(w, h, F.lit(float(max_w)), F.lit(float(max_h)))
    side = lambda n: F.when(k >= 1.0, n).otherwise(F.greatest(F.lit(1), F.bround(n * k).cast("int")))
    return {"new_w": side(w), "new_h": side(h)}


def next_power_of_2(n: Column) -> Column:
    """Smallest power of two that is at least ``n`` (1 for n <= 1), by integer bit length."""
    bits = F.length(F.conv(F.greatest(n - 1, F.lit(0)).cast("string"), 10, 2))
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), bits).cast("long"))


#: Odd multipliers below 2 ** 31: products with 32-bit words stay in 63 bits.
JITTER = (1597334677, 2020292263)


def jitter_channel(c: Column, seed: Column, salt: int, max_change: int = 10) -> Column:
    """Move a channel by -max..+max, reproducibly from the integer ``seed``, clamped to a byte. Plain 32-bit arithmetic, so that any engine gives the same steps."""
    word = lambda x: F.pmod(x, F.lit(1 << 32))
    x = word(word(seed.cast("long") + salt * 0x9E3779B9) * JITTER[0])
    x = word(x.bitwiseXOR(F.shiftright(x, 15)) * JITTER[1])
    step = x.bitwiseXOR(F.shiftright(x, 13)) % (2 * max_change + 1) - max_change
    return F.greatest(F.lit(0), F.least(F.lit(255), c + step)).cast("int")


def modify_color(r: Column, g: Column, b: Column, seed: Column, max_change: int = 10) -> dict[str, Column]:
    return {n: jitter_channel(c, seed, i, max_change) for i, (n, c) in enumerate((("r", r), ("g", g), ("b", b)))}


def uv_to_px(u: Column, v: Column, w: Column, h: Column, wrap: bool = True) -> dict[str, Column]:
    """Texture coordinates to pixel coordinates, wrapped into [0,1) or clamped to [0,1]."""
    one = F.lit(1.0)
    unit = (lambda t: F.pmod(t, one)) if wrap else (lambda t: F.greatest(F.lit(0.0), F.least(one, t)))
    return {"px": unit(u) * (w - 1), "py": unit(v) * (h - 1)}


def expand_quarter_uv(t: Column) -> Column:
    return (t - 0.5) * 2.0
