"""Column functions: randomness keyed by content, clipping, binning, classes, formats."""

from __future__ import annotations

from pyspark.sql import functions as F


def uniform(*keys):
    """[0, 1) from keys, the same on any partitioning: eight hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def gaussian(u1, u2):
    """Box-Muller; u1 may be 0."""
    return F.sqrt(-2 * F.log(F.greatest(u1, F.lit(2.0**-33)))) * F.cos(2 * F.lit(3.141592653589793) * u2)


def clip(x, low: float, high: float):
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x, places: int):
    """A double rounded as SQL engines do in doubles, halves of x * 10^places away from zero; `round` decides by x's shortest decimal."""
    v = x * 10.0**places
    whole = F.when(F.abs(v - F.rint(v)) == 0.5, v + 0.5 * F.signum(v)).otherwise(F.rint(v))  # rint: halves to even
    return F.when(F.abs(whole) == float("inf"), x).otherwise(whole / 10.0**places)


def digitize(x, edges):
    """How many edges (array) are at or below x: bins open to the right."""
    return F.size(F.filter(edges, lambda e: x >= e))


def three_way(x, low: float, high: float, names=("low", "medium", "high")):
    return F.when(x < low, names[0]).when(x < high, names[1]).otherwise(names[2])


def mode(clustered, polarization, third: str = "milling"):
    """dispersed under half clustered; migrating above .6; else milling or forming."""
    return F.when(clustered < 0.5, "dispersed").when(polarization > 0.6, "migrating").otherwise(third)


def cost_label(cost):
    """Free, or with 4, 3 or 2 decimals as the cost grows."""
    return F.when(cost == 0, "Free").when(cost < 0.01, F.format_string("$%.4f", cost)).when(cost < 1, F.format_string("$%.3f", cost)).otherwise(F.format_string("$%.2f", cost))


def escape_html(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def polarization(vx, vy):
    """Aggregate: norm of the mean unit velocity; a zero speed counts as 1e-10."""
    speed = F.sqrt(vx * vx + vy * vy)
    speed = F.when(speed == 0, 1e-10).otherwise(speed)
    return F.sqrt(F.pow(F.avg(vx / speed), 2) + F.pow(F.avg(vy / speed), 2))


def cohens_d(value, before, *, population: bool = False):
    """Aggregate: (mean after - mean before) / pooled deviation; null under two rows a side, 0 without deviation. `population`:
    variances by n, and 0 under two rows a side."""
    var = F.var_pop if population else F.var_samp
    a, b = F.when(before, value), F.when(~before, value)
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(((na - 1) * var(a) + (nb - 1) * var(b)) / (na + nb - 2))
    return F.when((na < 2) | (nb < 2), 0.0 if population else None).when(pooled < 1e-10, 0.0).otherwise((F.avg(b) - F.avg(a)) / pooled)
