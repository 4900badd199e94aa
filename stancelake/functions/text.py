"""Post cleaning as pure Column -> Column functions.

All patterns are written so that Java regex (Spark) behaves like Python's
``re`` on Unicode text:

* a word character is ``[\\p{L}\\p{N}_]`` (Java's ``\\w`` is ASCII only);
* ``.`` is written ``[^\\n]`` (Java's ``.`` also stops at ``\\r``, U+0085,
  U+2028 and U+2029, Python's only at ``\\n``);
* whitespace is the explicit class ``WS`` below, which equals Python's
  ``\\s`` (Spark's ``trim`` strips U+0020 only and is not used).

Profiles (order matters):
  P1 classifier: H1 H2 [H3 H4] H5 H6 H8 H10 H12 [H13] H14, then C5, C6
  P2 LLM:        H1 H2 H5 H9 H12 [H13] H14, then C5
  P3 stance:     H5, newline and CR to blank, H14
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
WS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The emoji class of the reference is the union of its listed ranges, which
# collapses to these four code points and everything from U+24C2 upwards
# (so CJK, kana and Hangul text is removed too).
# The same class as a plain string of characters, for trim().
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
            + "\u2028\u2029\u202f\u205f\u3000")
EMOJI = r"[\x{200D}\x{231A}\x{23CF}\x{23E9}\x{24C2}-\x{10FFFF}]+"

# The same class for speed: a character below it fails at one comparison.
FAST_EMOJI = r"[[^\x{00}-\x{200C}]&&[\x{200D}\x{231A}\x{23CF}\x{23E9}\x{24C2}-\x{10FFFF}]]"

# WS for speed: a character that cannot be in it fails at one comparison.
FAST_WS = r"[[^!-~]&&[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
# Two or more of WS: two characters that are not printable ASCII come first, so that single blanks cost little.
FAST_WS_RUN = rf"[^!-~]{{2}}(?<={FAST_WS}{FAST_WS}){FAST_WS}*"

RT_HEADER = rf"^RT (@{WORD}+ ?)+: "
LEADING_MENTIONS = rf"^(@{WORD}+ )+"
HASHTAG = rf"#{WORD}+"
URL_REST_OF_LINE = r"https?://[^\n]*[\r\n]*"

MIN_NUM_WORDS = 4


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_rt_header(c) -> Column:                       # H1
    return F.regexp_replace(_c(c), RT_HEADER, "")


def strip_isolates(c) -> Column:                        # H2: U+2066, U+2069
    return F.replace(F.replace(_c(c), F.lit("\u2066"), F.lit("")), F.lit("\u2069"), F.lit(""))


def strip_leading_mentions(c) -> Column:                # H3
    return F.regexp_replace(_c(c), LEADING_MENTIONS, "")


def strip_hashtags(c) -> Column:                        # H4
    return F.regexp_replace(_c(c), HASHTAG, "")


def strip_urls(c) -> Column:                            # H5 (eats the rest of the line)
    return F.regexp_replace(_c(c), URL_REST_OF_LINE, "")


def drop_plus_plus(c) -> Column:                        # H6
    return F.replace(_c(c), F.lit("++"), F.lit(""))


def newline_to_space(c) -> Column:                      # H8
    return F.replace(_c(c), F.lit("\n"), F.lit(" "))


def decode_entities_p2(c) -> Column:                    # H9, in this order
    out = _c(c)
    for a, b in (("\n", " "), ("\r", " "), ("&amp;", "&"), ("&gt;", ">"),
                 ("&gt", ">"), ("&lt;", "<"), ("&lt", "<")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def drop_entities_p1(c) -> Column:                      # H10 (leaves the ';')
    out = F.replace(_c(c), F.lit("&gt"), F.lit(""))
    return F.replace(out, F.lit("&lt"), F.lit(""))


def lower(c) -> Column:                                 # H12
    return F.lower(_c(c))


def strip_emoji(c) -> Column:                           # H13
    return F.regexp_replace(_c(c), FAST_EMOJI + "+", "")


def squeeze_whitespace(c) -> Column:                    # H14
    """Runs of 2+ blanks -> one blank, then strip both ends.

    (After the first step no line can start with a blank, so stripping at
    every line start reduces to stripping at the string start.)  ``trim``
    with the explicit character set is one linear pass, unlike anchored
    end-of-string regexes.
    """
    out = F.regexp_replace(_c(c), FAST_WS_RUN, " ")
    return F.trim(out, F.lit(WS_CHARS))


def rstrip(c) -> Column:                                # H15
    return F.rtrim(_c(c), F.lit(WS_CHARS))


def word_count(c) -> Column:                            # H17: split on one blank only
    """len(text.split(' ')) = number of blanks + 1, without building the array."""
    c = _c(c)
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + F.lit(1)


def clean_p1(c, remove_tags_and_emoji: bool = True) -> Column:
    out = strip_isolates(strip_rt_header(c))
    if remove_tags_and_emoji:
        out = strip_hashtags(strip_leading_mentions(out))
    out = lower(drop_entities_p1(newline_to_space(drop_plus_plus(strip_urls(out)))))
    if remove_tags_and_emoji:
        out = strip_emoji(out)
    return squeeze_whitespace(out)


def has_tags_or_emoji(c) -> Column:
    """False only if P1 gives the same text with and without tags and emoji.

    Asked of the lowered text: lower case makes characters of the emoji class from some that are not.
    """
    return lower(c).rlike(rf"[#@{FAST_EMOJI}]")


def lowered_p2(c) -> Column:
    """P2 as far as it goes whether or not emoji are removed."""
    return lower(decode_entities_p2(strip_urls(strip_isolates(strip_rt_header(c)))))


def clean_p2(c, remove_emoji: bool = False) -> Column:
    out = lowered_p2(c)
    if remove_emoji:
        out = strip_emoji(out)
    return squeeze_whitespace(out)


def clean_p3(c) -> Column:                              # H16
    out = F.replace(newline_to_space(strip_urls(c)), F.lit("\r"), F.lit(" "))
    return squeeze_whitespace(out)


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Replace/add column ``name`` = ``expr`` so that it is evaluated once.

    Catalyst pushes a later filter on ``name`` below the projection by
    inlining ``expr``, so an expensive expression (a dozen regex passes over
    long texts) would run once for each predicate and again for the output.
    A single-element ``explode`` is a Generate node, which predicates on its
    output cannot cross: the filter then reads the computed value.
    """
    cols = [F.explode(F.array(expr)).alias(name) if c == name else F.col(c) for c in df.columns]
    if name not in df.columns:
        cols.append(F.explode(F.array(expr)).alias(name))
    return df.select(*cols)


def clean_p2_twice(df: DataFrame, text_col: str = "tweet", bare_col: str = "bare") -> DataFrame:
    """Q1 for both language models: the text column by P2, C5 applied, and ``bare_col``, P2 without emoji where that is another text, else null."""
    low = once(df, "low__", lowered_p2(text_col))
    bare = F.when(F.col("low__").rlike(FAST_EMOJI), squeeze_whitespace(strip_emoji("low__")))
    return once(low, text_col, squeeze_whitespace("low__")).filter(F.col(text_col) != "").withColumn(bare_col, bare).drop("low__")


def clean_posts(df: DataFrame, profile: str = "P1", text_col: str = "tweet",
                remove_tags_and_emoji: bool | None = None,
                min_words: int = MIN_NUM_WORDS) -> DataFrame:
    """Q1: clean the text column in place and apply C5 (and C6 for P1).

    ``remove_tags_and_emoji`` defaults to True for P1 (classifier input) and
    False for P2 (only LLM topic filtering strips emoji).
    """
    if remove_tags_and_emoji is None:
        remove_tags_and_emoji = profile == "P1"
    if profile == "P1":
        cleaned = clean_p1(text_col, remove_tags_and_emoji)
    elif profile == "P2":
        cleaned = clean_p2(text_col, remove_tags_and_emoji)
    elif profile == "P3":
        return df.withColumn(text_col, clean_p3(text_col))
    else:
        raise ValueError(f"unknown profile {profile}")
    out = once(df, text_col, cleaned).filter(F.col(text_col) != "")        # C5
    if profile == "P1" and min_words:
        out = out.filter(word_count(text_col) >= min_words)                # C6
    return out
