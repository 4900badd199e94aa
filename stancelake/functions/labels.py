"""Score bucketing and label maps (H18-H23, H26) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
FINAL_THRESHOLDS_5 = (0.2, 0.4, 0.6, 0.8)       # algorithms 1-3: labels 1..5
FINAL_THRESHOLDS_4 = (0.25, 0.5, 0.75)          # algorithm 4: labels 1..4, then remapped
TOPIC_THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)
ALGORITHMS = ("algorithm_1", "algorithm_2", "algorithm_3",
              "algorithm_4_min_num_tweets_3", "algorithm_4_min_num_tweets_2")
STANCE_TO_INT = {
    "completely disagree": 1,
    "disagree": 2,
    "neither disagree nor agree": 3,
    "agree": 4,
    "completely agree": 5,
}
NEUTRAL = "neither disagree nor agree"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def missing(c) -> Column:
    """Null or NaN: both count as 'below every threshold' (Python semantics)."""
    c = _c(c)
    return c.isNull() | F.isnan(c)


def bucket(c, thresholds) -> Column:
    """1 + number of thresholds reached (inclusive), missing -> 1."""
    c = _c(c)
    out = F.lit(1)
    for i, t in enumerate(sorted(thresholds)):
        out = F.when(c >= F.lit(float(t)), F.lit(i + 2)).otherwise(out)
    return F.when(missing(c), F.lit(1)).otherwise(out).cast("int")


def label5(c) -> Column:
    return bucket(c, FINAL_THRESHOLDS_5)


def label4(c) -> Column:
    return bucket(c, FINAL_THRESHOLDS_4)


def remap_algorithm4(c) -> Column:
    """Labels 3 -> 4 and 4 -> 5 after the 4-way vote (so 3 means 'too few posts')."""
    c = _c(c)
    return F.when(c == 3, 4).when(c == 4, 5).otherwise(c).cast("int")


def half_even(c) -> Column:                     # H23: Python round()
    return F.bround(_c(c), 0).cast("int")


def three_derived(c) -> Column:                 # H20: 1,2 -> 1; 3 -> 2; else 3
    c = _c(c)
    return F.when(c.isin(1, 2), 1).when(c == 3, 2).otherwise(3).cast("int")


def three_calculated(c) -> Column:              # H21: 4 -> 3; 3 -> 2; 2 -> 1; else null
    c = _c(c)
    return F.when(c == 4, 3).when(c == 3, 2).when(c == 2, 1).cast("int")


def stance_to_int(c) -> Column:                 # H22
    c = _c(c)
    out = None
    for word, n in STANCE_TO_INT.items():
        out = F.when(c == word, n) if out is None else out.when(c == word, n)
    return out.cast("int")


def algorithm_min_posts(c) -> Column:           # H26
    return F.regexp_extract(_c(c), r"_4_min_num_tweets_(\d)", 1)


def parse_algorithm(name: str) -> tuple[int, int | None]:
    """Driver-side check of an algorithm parameter: (number, min posts)."""
    import re
    for k in (1, 2, 3):
        if f"algorithm_{k}" in name:
            return k, None
    if "algorithm_4" in name:
        m = re.search(r"_4_min_num_tweets_(\d)", name)
        if not m or int(m.group(1)) == 0:
            raise ValueError(f"algorithm_4 needs a minimum number of posts: {name}")
        return 4, int(m.group(1))
    raise ValueError(f"algorithm not implemented: {name}")
