"""Cleaning profiles against a pure-Python twin on adversarial strings."""

import re

from stancelake.functions import text as T

# Pure-Python twins of the cleaning rules (Python re: \w and \s are Unicode).
EMOJI_PY = re.compile("[‍⌚⏏⏩Ⓜ-\U0010ffff]+")


def ws_py(t):
    t = re.sub(r"\s{2,}", " ", t, flags=re.M)
    t = re.sub(r"^\s+", "", t, flags=re.M)
    return t.strip()


def p1_py(t, tags=True):
    t = re.sub(r"^RT (@\w+ ?)+: ", "", t)
    t = t.replace("⁦", "").replace("⁩", "")
    if tags:
        t = re.sub(r"^(@\w+ )+", "", t)
        t = re.sub(r"#\w+", "", t)
    t = re.sub(r"https?://.*[\r\n]*", "", t).replace("++", "").replace("\n", " ")
    t = t.replace("&gt", "").replace("&lt", "").lower()
    if tags:
        t = EMOJI_PY.sub("", t)
    return ws_py(t)


def p2_py(t, emoji=False):
    t = re.sub(r"^RT (@\w+ ?)+: ", "", t)
    t = t.replace("⁦", "").replace("⁩", "")
    t = re.sub(r"https?://.*[\r\n]*", "", t)
    for a, b in (("\n", " "), ("\r", " "), ("&amp;", "&"), ("&gt;", ">"), ("&gt", ">"), ("&lt;", "<"), ("&lt", "<")):
        t = t.replace(a, b)
    t = t.lower()
    if emoji:
        t = EMOJI_PY.sub("", t)
    return ws_py(t)


ADVERSARIAL = [
    "RT @a @b: Hello World foo bar", "RT @élu: Bonjour à tous", "RT @a:b: c", "@x @y_z hi there #Été2019 fin",
    "#a#b #", "see https://t.co/ab more text\nnext line here", "a http://x\r\nb c", "http://a\n\n\nq",
    "x &gt;&lt; y ++ z", "&amp;gt;", "漢字 text 한국 ok 🙏🏽 done ✅ ⌚", "tab\tone two three",
    "  lead\n   blanks\n on lines", "ΑΣ ΟΔΟΣ İstanbul", "⁦@mention⁩ said", "a\u0085 http://u x y",
    "\x1c\x1d\x1e\x1fsep", "trailing ideographic　", "①②Ⓜ ok", "a\r  b", "", "   ",
]


def _run(spark, fn):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ADVERSARIAL)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", fn("t").alias("o")).collect())]


def test_p1_matches_python(spark):
    assert _run(spark, T.clean_p1) == [p1_py(s) for s in ADVERSARIAL]


def test_p1_keep_tags_matches_python(spark):
    assert _run(spark, lambda c: T.clean_p1(c, False)) == [p1_py(s, False) for s in ADVERSARIAL]


def test_p2_matches_python(spark):
    assert _run(spark, T.clean_p2) == [p2_py(s) for s in ADVERSARIAL]
    assert _run(spark, lambda c: T.clean_p2(c, True)) == [p2_py(s, True) for s in ADVERSARIAL]


def test_word_count_like_python_split(spark):
    got = _run(spark, T.word_count)
    assert got == [len(s.split(" ")) for s in ADVERSARIAL]


def test_clean_posts_filters(spark):
    df = spark.createDataFrame([("1", "one two three four"), ("2", "too short"), ("3", "🙏 ✅")],
                               "tweet_id string, tweet string")
    kept = sorted(r.tweet_id for r in T.clean_posts(df, "P1").collect())
    assert kept == ["1"]
    kept2 = sorted(r.tweet_id for r in T.clean_posts(df, "P2").collect())
    assert kept2 == ["1", "2", "3"]
