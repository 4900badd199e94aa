"""Parsing language-model replies (I4-I14, C8, H22) as Column expressions.

Python's ``.`` (no DOTALL) stops only at ``\\n``; Java's also stops at
``\\r``, U+0085, U+2028 and U+2029, so every ``.`` is written ``[^\\n]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import NEUTRAL, STANCE_TO_INT

# ---- fixed values that must equal the reference's for right results -------

# Stance words accepted inside a JSON-like reply, variant A (LLM-filtered posts).
STANCE_WORDS_A = [
    "completely disagree", "disagree", "neither disagree nor agree", "agree", "completely agree",
    "neutral", "none", "unknown", "neither_disagree_nor_agree", "indirectly disagree",
    "insufficient_information", "neutral leaning towards agree", "undetermined", "indeterminable",
]
# Variant B (score-filtered posts) lists more words and ends with ".+", so any
# value matches; only the five canonical words survive, the rest is neutral.
STANCE_WORDS_B = [
    "completely disagree", "disagree", "neither disagree nor agree", "agree", "completely agree",
    "neutral", "none", "unknown", "neither_disagree_nor_agree", "indirectly disagree",
    "insufficient_information", "neutral leaning towards agree", "undetermined", "indeterminable",
    "no stance provided based on the tweets", "lean agree",
    "cannot be determined from the tweets provided", "cannot be determined from the given tweets",
    "not mentioned", "undefined", "not applicable", "not available",
    "cannot be determined from the provided tweets", "not determinable from the given information",
]
# Words accepted by the free-text fallback regex (both variants).
FALLBACK_WORDS = [
    "completely disagree", "disagree", "neither disagree nor agree", "agree", "completely agree",
    "neutral", "none", "unknown", "neither_disagree_nor_agree", "indirectly disagree",
    "insufficient_information", "neutral leaning towards agree",
]
# Lead-ins of the fallback regex.
FALLBACK_LEAD_A = ["Based on the provided tweets, the"]
FALLBACK_LEAD_B = ["Based on the provided tweets", "based solely on the information provided in the tweets",
                   "based on the information provided in the tweets"]
# Replies that contain one of these phrases are accepted without a regex hit.
ALLOWED_PHRASES_A = [
    "Therefore, I cannot provide a JSON formatted response with a clear stance",
    'Based on the provided tweets, the stance is "neither disagree nor agree"',
    "Based on the provided tweet, I cannot determine any stance towards the statement",
    'Based on the provided tweets, the stance of the users towards the statement "the federal government '
    'should guarantee a minimum income for all Canadian adults regardless of whether or not they have a '
    "job\" is 'neither disagree nor agree'",
    "Based on the provided tweets, the user's stance towards \"Quebec should become an independent state\" "
    "is 'neither disagree nor agree'",
    "Based on the provided tweets, I cannot determine a clear stance",
    "Stance: neither disagree nor agree",
    "Based on the provided tweets, the stance of the user is 'neither disagree nor agree'",
    "seems to be 'neither disagree nor agree'",
    "the stance appears to be closer to 'disagree' than any other option",
]
ALLOWED_PHRASES_B = ALLOWED_PHRASES_A + ["promise to balance the budget by 2"]
# Ordered overrides applied when the reply had no JSON-like stance.
OVERRIDES_A = [("(but leans towards agree)", "agree"), ("'disagree'", "disagree")]
OVERRIDES_B = OVERRIDES_A + [("promise to balance the budget by 2", "agree")]
# Non-canonical words and the canonical stance they stand for.
NEUTRAL_WORDS = ["neutral", "neither_disagree_nor_agree", "none", "insufficient_information", "unknown",
                 "undetermined", "indeterminable"]
CANONICAL_OF = {"indirectly disagree": "disagree", "neutral leaning towards agree": "agree",
                "lean agree": "agree"}
# Reply spelling fix so that the topic matches the statement list.
SPELLING = [("centers", "centres")]

# ---------------------------------------------------------------------------

DOT = r"[^\n]"


def _alt(words) -> str:
    import re
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_model_comments(c) -> Column:                                # I4
    r = F.regexp_replace(_c(c), rf' ? // ?implied by "{DOT}*?" ?\n?', "")
    return F.regexp_replace(r, rf' ? // {DOT}*? implies "{DOT}*?" ?\n?', "")


def normalize_reply(c) -> Column:                                     # I5
    r = F.replace(_c(c), F.lit("\n"), F.lit(" "))
    for a, b in SPELLING:
        r = F.replace(r, F.lit(a), F.lit(b))
    return r


def first_list(c) -> Column:                                          # I6
    return F.regexp_extract(_c(c), rf"\[{DOT}*?\]", 0)


def parse_list(c) -> Column:                                          # I7
    """Python-list-literal parse: single or double quotes; a trailing comma is
    accepted; anything else that is not a list of strings gives no topics."""
    txt = F.regexp_replace(_c(c), r",\s*\]$", "]")
    arr = F.from_json(txt, "array<string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return F.when(txt == "", F.array().cast("array<string>")).otherwise(
        F.coalesce(arr, F.array().cast("array<string>")))


def topics_from_reply(c) -> Column:
    """The topics a topic-filtering reply lists (duplicates kept)."""
    return parse_list(first_list(normalize_reply(strip_model_comments(c))))


def canonical(word: Column) -> Column:
    """Map non-canonical stance words to the five canonical ones (D-6)."""
    out = F.when(word.isin(*NEUTRAL_WORDS), F.lit(NEUTRAL))
    for k, v in CANONICAL_OF.items():
        out = out.when(word == k, F.lit(v))
    return out.otherwise(word)


def _phrase_hit(reply: Column, phrases) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | reply.contains(p)
    return hit


def stance_from_reply(c, variant: str = "A") -> Column:
    """(stance int or null, status) of a stance reply.

    Variant A (LLM-filtered posts) accepts a closed list of words and maps
    the neutral family, 'indirectly disagree' and 'neutral leaning towards
    agree'.  Variant B (score-filtered) accepts any value and keeps only the
    five canonical words.  Without a JSON-like stance, a fallback regex and a
    list of allowed phrases decide; nothing at all gives status 'unparsed'.
    """
    r = _c(c)
    if variant == "A":
        js = F.regexp_extract(r, f'"stance": "({_alt(STANCE_WORDS_A)})"', 1)
        js_word = canonical(js)
        lead, group, phrases, overrides = FALLBACK_LEAD_A, 2, ALLOWED_PHRASES_A, OVERRIDES_A
        fb_pat = f"{_alt(lead)} ({DOT}*?) '?\"?({_alt(FALLBACK_WORDS)})'?\"?"
    else:
        js = F.regexp_extract(r, f'"stance": "({_alt(STANCE_WORDS_B)}|{DOT}+)"', 1)
        js_word = F.when(js.isin(*STANCE_TO_INT), js).otherwise(F.lit(NEUTRAL))
        lead, group, phrases, overrides = FALLBACK_LEAD_B, 3, ALLOWED_PHRASES_B, OVERRIDES_B
        fb_pat = f"({_alt(lead)}), ({DOT}*?) '?\"?({_alt(FALLBACK_WORDS)})'?\"?"
    fb = F.regexp_extract(r, fb_pat, group)
    over = None
    for phrase, word in overrides:
        cond = r.contains(phrase)
        over = F.when(cond, F.lit(word)) if over is None else over.when(cond, F.lit(word))
    fallback = over.when(fb != "", canonical(fb)).otherwise(F.lit(NEUTRAL))
    accepted = (fb != "") | _phrase_hit(r, phrases)
    word = F.when(js != "", js_word).when(accepted, fallback)
    stance = F.when(word.isNotNull(), stance_word_to_int(word))
    status = F.when(js != "", F.lit("json")).when(fb != "", F.lit("fallback")) \
              .when(accepted, F.lit("phrase")).otherwise(F.lit("unparsed"))
    return F.struct(stance.alias("stance"), status.alias("parse_status"))


def stance_word_to_int(word: Column) -> Column:                       # H22
    out = None
    for w, n in STANCE_TO_INT.items():
        out = F.when(word == w, F.lit(n)) if out is None else out.when(word == w, F.lit(n))
    return out.cast("int")
