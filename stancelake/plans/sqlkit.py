"""DuckDB SQL snippets for the oracle side (plain per-row / per-threshold SQL).

The oracle is written the naive way on purpose (a join on ``score >= t`` per
threshold, CASE chains per algorithm) so that it checks the band design of
the Spark operators independently.
"""

from __future__ import annotations

from ..functions.labels import FINAL_THRESHOLDS_4, FINAL_THRESHOLDS_5, TOPIC_THRESHOLDS

WORD = r"[\p{L}\p{N}_]"
WS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
EMOJI = r"[\x{200D}\x{231A}\x{23CF}\x{23E9}\x{24C2}-\x{10FFFF}]+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def bucket(x: str, thresholds) -> str:
    parts = [f"WHEN {x} IS NULL OR isnan({x}) THEN 1"]
    ts = sorted(thresholds)
    for i in range(len(ts) - 1, -1, -1):
        parts.append(f"WHEN {x} >= {dbl(ts[i])} THEN {i + 2}")
    return "CAST(CASE " + " ".join(parts) + " ELSE 1 END AS INTEGER)"


def label5(x: str) -> str:
    return bucket(x, FINAL_THRESHOLDS_5)


def label4(x: str) -> str:
    return bucket(x, FINAL_THRESHOLDS_4)


def majority(prefix: str, labels, s: str, n: str = "n") -> str:
    counts = [f"{prefix}{k}" for k in labels]
    top = f"greatest({', '.join(counts)})"
    n_top = " + ".join(f"CAST({c} = {top} AS INTEGER)" for c in counts)
    winner = "CASE " + " ".join(f"WHEN {c} = {top} THEN {k}" for k, c in zip(labels, counts)) + " END"
    return (f"CAST(CASE WHEN {n_top} = 1 THEN {winner} "
            f"ELSE round_even({s} / {n}, 0) END AS INTEGER)")


def remap4(x: str) -> str:
    return f"CAST(CASE WHEN {x} = 3 THEN 4 WHEN {x} = 4 THEN 5 ELSE {x} END AS INTEGER)"


def thresholds_list(thresholds=TOPIC_THRESHOLDS) -> str:
    return "[" + ", ".join(dbl(t) for t in thresholds) + "]"


def counts_cte(src: str, keys, thresholds=TOPIC_THRESHOLDS, w: str = "score_topic",
               v: str = "score_sentence", grid_src: str | None = None) -> str:
    """CTE body: per keys x threshold counts over ``src`` (naive join form)."""
    k = ", ".join(keys)
    on = " AND ".join(f"l.{c} = g.{c}" for c in keys)
    gk = ", ".join(f"g.{c}" for c in keys)
    c5 = ",\n    ".join(f"count(*) FILTER (WHERE l.l5 = {i}) AS c5_{i}" for i in range(1, 6))
    c4 = ",\n    ".join(f"count(*) FILTER (WHERE l.l4 = {i}) AS c4_{i}" for i in range(1, 5))
    return f"""
  SELECT {gk}, g.threshold_topic,
    count(l.w) AS n, sum(l.w) AS sw, sum(l.v * l.w) AS svw, sum(l.l5) AS s5, sum(l.l4) AS s4,
    {c5},
    {c4}
  FROM (SELECT DISTINCT {k}, unnest({thresholds_list(thresholds)}) AS threshold_topic
        FROM {grid_src or src}) g
  LEFT JOIN (SELECT {k}, {w} AS w, {v} AS v, {label5(v)} AS l5, {label4(v)} AS l4 FROM {src}) l
    ON {on} AND l.w >= g.threshold_topic
  GROUP BY ALL"""


def algorithm_select(name: str, src: str, keys) -> str:
    from ..functions.labels import parse_algorithm
    k, min_posts = parse_algorithm(name)
    cols = ", ".join(keys)
    if k == 1:
        avg = "round(svw / sw, 12)"
        avg_out = f"CASE WHEN n > 0 THEN round({avg}, 6) END"
        level = f"CASE WHEN n > 0 THEN {label5(avg)} ELSE 3 END"
    else:
        avg_out = "CAST(NULL AS DOUBLE)"
        if k == 2:
            lv = "CAST(round_even(s5 / n, 0) AS INTEGER)"
        elif k == 3:
            lv = majority("c5_", range(1, 6), "s5")
        else:
            lv = f"CASE WHEN n < {min_posts} THEN 3 ELSE {remap4(majority('c4_', range(1, 5), 's4'))} END"
        level = f"CASE WHEN n > 0 THEN {lv} ELSE 3 END"
    return (f"SELECT {cols}, {lit(name)} AS algorithm, threshold_topic, {avg_out} AS avg_agreement, "
            f"CAST({level} AS INTEGER) AS agreement_level, CAST(n AS BIGINT) AS num_tweets FROM {src}")


def known_topics_cte(statements: str = "fx_statements") -> str:
    return (f"SELECT election, topic, min_by(sentence, topic_ix) AS sentence "
            f"FROM {statements} GROUP BY election, topic")


# --- text cleaning twins (RE2 classes equal to the Java ones) ---------------

def rx(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}, 'g')"


def rx1(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)})"


def rep(x: str, a: str, b: str) -> str:
    def q(s):
        if s == "\n":
            return "chr(10)"
        if s == "\r":
            return "chr(13)"
        return lit(s)
    return f"replace({x}, {q(a)}, {q(b)})"


def h1(x):
    return rx1(x, rf"^RT (@{WORD}+ ?)+: ")


def h2(x):
    return f"replace(replace({x}, chr(8294), ''), chr(8297), '')"


def h3(x):
    return rx1(x, rf"^(@{WORD}+ )+")


def h4(x):
    return rx(x, rf"#{WORD}+")


def h5(x):
    return rx(x, r"https?://[^\n]*[\r\n]*")


def h6(x):
    return rep(x, "++", "")


def h8(x):
    return rep(x, "\n", " ")


def h9(x):
    for a, b in (("\n", " "), ("\r", " "), ("&amp;", "&"), ("&gt;", ">"),
                 ("&gt", ">"), ("&lt;", "<"), ("&lt", "<")):
        x = rep(x, a, b)
    return x


def h10(x):
    return rep(rep(x, "&gt", ""), "&lt", "")


def h12(x):
    return f"lower({x})"


def h13(x):
    return rx(x, EMOJI)


def h14(x):
    x = rx(x, WS + "{2,}", " ")
    x = rx1(x, "^" + WS + "+")
    return rx1(x, WS + "+$")


def h15(x):
    return rx1(x, WS + "+$")


def h17(x):
    return f"len(string_split({x}, ' '))"


def clean_p1(x, tags=True):
    x = h2(h1(x))
    if tags:
        x = h4(h3(x))
    x = h12(h10(h8(h6(h5(x)))))
    if tags:
        x = h13(x)
    return h14(x)


def clean_p2(x, emoji=False):
    x = h12(h9(h5(h2(h1(x)))))
    if emoji:
        x = h13(x)
    return h14(x)


def clean_p3(x):
    return h14(rep(h8(h5(x)), "\r", " "))


def tokens(x: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(lower({x}), "
            f"{lit(r'[^\p{L}\p{N}_]+')}), lambda t: t <> ''))")
