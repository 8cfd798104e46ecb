"""Time-domain features from sums over one channel of one epoch.

Samples are taken relative to the epoch's first one, which keeps the sums of
squares small where the signal rides on a large offset. All deviations are
population ones. Everything here is SQL text: the terms over exploded samples
(``signal``, ``_j``, ``_x``), the features over their sums.
"""

from __future__ import annotations

# A variance below this share of the mean square is rounding noise: the signal is flat.
FLAT = 1e-13

OFFSET_FREE = "(_x - get(signal, 0))"
DIFF = "(get(signal, _j + 1) - _x)"
DIFF2 = "(get(signal, _j + 2) - 2 * get(signal, _j + 1) + _x)"

SAMPLE_TERMS = {
    "n": "if(_x IS NULL, NULL, 1)",
    "x0": "if(_j = 0, _x, NULL)",
    "s1": OFFSET_FREE,
    "s2": f"{OFFSET_FREE} * {OFFSET_FREE}",
    "sj": f"(_j - (size(signal) - 1) / 2D) * {OFFSET_FREE}",
    "dx1": DIFF,
    "dx2": f"{DIFF} * {DIFF}",
    "ddx1": DIFF2,
    "ddx2": f"{DIFF2} * {DIFF2}",
}

SHAPE_TERMS = {
    "s3": f"{OFFSET_FREE} * {OFFSET_FREE} * {OFFSET_FREE}",
    "s4": f"{OFFSET_FREE} * {OFFSET_FREE} * {OFFSET_FREE} * {OFFSET_FREE}",
}

SLOPE = "coalesce(try_divide(sj, n * (n * cast(n AS double) - 1) / 12D), 0D)"


def _flattened(var: str, mean_square: str) -> str:
    # NaN compares as equal to itself and must come through.
    return f"if({var} <= {mean_square} * {FLAT}D AND NOT isnan({var}), 0D, {var})"


def _variance(s2: str, s1: str, n: str) -> str:
    """Population variance from sums; null without samples, 0 where only rounding is left."""
    mean_square = f"try_divide({s2}, cast({n} AS double))"
    mean = f"try_divide({s1}, cast({n} AS double))"
    var = f"({mean_square} - {mean} * {mean})"
    return _flattened(var, mean_square)


def feature_stages(detrended: bool, shape: bool = False) -> list[dict[str, str]]:
    """Features in stages; a stage may use the columns of the stages before it."""
    first = {
        "_raw": _variance("s2", "s1", "n"),
        "_dvar": _variance("dx2", "dx1", "(n - 1)"),
        "_ddvar": _variance("ddx2", "ddx1", "(n - 2)"),
    }
    if detrended:
        # Differences do not depend on the line: it only shifts their mean.
        left = f"(_raw - {SLOPE} * sj / n)"
        second = {"Variance": _flattened(left, "s2 / n"), "Mean": "0D * s1"}
    else:
        second = {"Variance": "_raw", "Mean": "x0 + s1 / n"}
    third = {
        "Std": "sqrt(Variance)",
        "RMS": "sqrt(Variance + Mean * Mean)",
        "HjorthMobility": "sqrt(try_divide(_dvar, Variance))",
    }
    if shape:
        third |= {
            # Biased skewness and excess kurtosis; null for a flat signal.
            "Skewness": (
                "try_divide(s3 / n - 3 * (s1 / n) * (s2 / n) + 2 * power(s1 / n, 3),"
                " Variance * sqrt(Variance))"
            ),
            "Kurtosis": (
                "try_divide(s4 / n - 4 * (s1 / n) * (s3 / n)"
                " + 6 * (s1 / n) * (s1 / n) * (s2 / n) - 3 * power(s1 / n, 4),"
                " Variance * Variance) - 3"
            ),
        }
    fourth = {
        "HjorthComplexity": "try_divide(sqrt(try_divide(_ddvar, _dvar)), HjorthMobility)",
    }
    return [first, second, third, fourth]


HJORTH_INDEX = "2 * HjorthComplexity + try_divide(100D, 2 * HjorthMobility)"
