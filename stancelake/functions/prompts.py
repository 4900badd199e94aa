"""Prompt text for the language-model steps (H27-H31) as Column expressions.

The wording is a fixed value: the same words give the same model behaviour,
so it is kept exactly as the reference states it, in natural order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "~|~"

# ---- fixed values: topic-filtering prompt (H27) ---------------------------
TOPIC_PROMPT_HEAD = "Write again the topics I'm providing you:\n\n`\"topics\"`: [\n"
TOPIC_PROMPT_ITEM = '    "{}"'
TOPIC_PROMPT_ITEM_SEP = ",\n"
TOPIC_PROMPT_MIDDLE = (
    "\n]\n"
    "\nThen, write the last topic in the list.\n\n"
    "Now you are a helpful AI topic labeller, capable of processing a text `\"text_to_analyze\"` and the "
    "`\"topics\"` above. Your job is to semantically assign zero, one or more topics from `\"topics\"` to a "
    "text `\"text_to_analyze\"`. You must meet ALL these requirements ONLY:\n"
    "- You must always respond in JSON format containing 2 fields, \"text\" and \"selected_topics\". "
    "\"text\" is the analyzed text, \"selected_topics\" is the set of topics from `\"topics\"` which are "
    "correlated with the `\"text_to_analyze\"`.\n"
    "- Your output must include only the JSON data. Do not add any explanation also in case no matching "
    "topics can be found.\n"
    "- You must only assign topics listed on `\"topics\"`, exactly as specified in the list. \n"
    "- You mustn't assign topics mentioned in the text but not in the `\"topics\"` list! For example, if "
    "the text mentions a topic <topic> which you cannot find in the `\"topics\"` list, you must not write "
    "it in \"selected_topics\".\n"
    "- If a topic is not explicitly listed but is implied in the `\"text_to_analyze\"`, you don't put it "
    "inside the \"selected_topics\" list.\n"
    "- You are capable. You can reason step by step, check that every requirement is met and therefore "
    "answer correctly. \n\n"
    "```\n"
    "\"text_to_analyze\": \""
)
TOPIC_PROMPT_TAIL = "\"\n```\n"

# ---- fixed values: stance prompt (H28) ------------------------------------
STANCE_PROMPT_INTRO = (
    "Tweets by an unknown Twitter account are submitted in a block delimited by '=== TWEETS BEGIN ===' "
    "and '=== TWEETS END ==='. Each tweet is separated by the '~|~' separator. Tweets may include emojis "
    "in unicode (e.g, 🙏). Also, tweets could be in a language other than English (e.g., Italian).\n\n"
    "=== TWEETS BEGIN ===\n"
)
STANCE_PROMPT_AFTER_TWEETS = (
    "\n=== TWEETS END ===\n\n"
    "Your job is to assess the stance of the Twitter account in response to the statement \""
)
STANCE_PROMPT_AFTER_STATEMENT = (
    "\" leveraging what the account wrote (consider all tweets you've just read). The stance can assume "
    "only these "
)
STANCE_LABELS_5 = ("five", "'completely disagree', 'disagree', 'neither disagree nor agree', 'agree', "
                            "and 'completely agree'")
STANCE_LABELS_3 = ("three", "'disagree', 'neither disagree nor agree', and 'agree'")
STANCE_PROMPT_TAIL = (
    ". The 'neither disagree nor agree' case refers to cases where there are tweets about the topic but "
    "the stance is neutral.\n\n"
    "The stance for the statement must be in JSON format like this:\n\n"
    "{\n"
    "\t\"stance\": <the stance>,\n"
    "\t\"statement\": <the_statement>\n"
    "}\n\n"
    "In your analysis, rely exclusively on the information present in the tweets, possibly drawing "
    "conclusions only based on what has been shown to you. Do not use any external information to draw "
    "your conclusions.\n"
)

# ---- fixed values: instruction wrapper (H30) and statement block (H29) ----
INSTRUCTION_OPEN = "[INST] "
INSTRUCTION_CLOSE = " [/INST]"
STATEMENTS_OPEN = "\n\nstatements: ["
STATEMENT_ITEM = '{{"id":{id},"statement":"{statement}"}}'

# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def topic_list_block(topics_sorted: Column) -> Column:
    """The quoted, lower-cased topic lines of H27 from an ordered array."""
    head, tail = TOPIC_PROMPT_ITEM.split("{}")
    items = F.transform(topics_sorted, lambda t: F.concat(F.lit(head), F.lower(t), F.lit(tail)))
    return F.array_join(items, TOPIC_PROMPT_ITEM_SEP)


def post_for_topic_prompt(text) -> Column:
    """The post as the topic prompt embeds it: '"', '[' and ']' removed."""
    return F.translate(_c(text), '"[]', "")


def topic_prompt(topics_block: Column, text) -> Column:              # H27
    return F.concat(F.lit(TOPIC_PROMPT_HEAD), topics_block, F.lit(TOPIC_PROMPT_MIDDLE),
                    post_for_topic_prompt(text), F.lit(TOPIC_PROMPT_TAIL))


def stance_frame(num_labels: int = 5) -> tuple[str, str, str]:
    """The stance prompt before its posts, between them and the sentence, and after that."""
    word, labels = STANCE_LABELS_5 if num_labels == 5 else STANCE_LABELS_3
    return STANCE_PROMPT_INTRO, STANCE_PROMPT_AFTER_TWEETS, f"{STANCE_PROMPT_AFTER_STATEMENT}{word} values: {labels}{STANCE_PROMPT_TAIL}"


def stance_prompt(posts_joined, sentence, num_labels: int = 5) -> Column:   # H28
    before, between, after = stance_frame(num_labels)
    return F.concat(F.lit(before), _c(posts_joined), F.lit(between), _c(sentence), F.lit(after))


def stance_prompt_overhead(sentence, num_labels: int = 5) -> Column:
    """The stance prompt with no posts (used for the token budget)."""
    return stance_prompt(F.lit(""), sentence, num_labels)


def instruction_wrap(prompt) -> Column:                               # H30
    return F.concat(F.lit(INSTRUCTION_OPEN), _c(prompt), F.lit(INSTRUCTION_CLOSE))


def statement_block(statements_sorted: Column) -> Column:             # H29
    """``statements: [{"id":0,"statement":"..."},...]`` from an array of
    sentences in list order (written without JSON escaping, as in the
    reference)."""
    items = F.transform(statements_sorted, lambda s, i: F.concat(
        F.lit('{"id":'), i.cast("string"), F.lit(',"statement":"'), s, F.lit('"}')))
    return F.concat(F.lit(STATEMENTS_OPEN), F.array_join(items, ","), F.lit("]"))


def stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    from .text import WS
    return F.regexp_replace(F.regexp_replace(text, "^" + WS + "+", ""), WS + r"+\z", "")


def translation_join(parts: Column) -> Column:                        # H31
    """Sentences of a translation, each stripped, joined with one blank (the
    reference leaves one trailing blank, removed again by H15)."""
    return F.array_join(F.transform(parts, stripped), " ")
