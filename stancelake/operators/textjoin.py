"""Score table from text: an exact containment join with a threshold.

The score of a label for a post is the share of the label's distinct tokens
that the post holds.  Only pairs that reach a threshold matter to a topic
filter, and they are found without meeting all pairs:

1. A label's tokens are ordered by how many posts hold them, rare ones first.
   If a post holds at least ``need`` of the label's n tokens, it holds at least
   ``k`` of its first n - need + k, for any k up to need.  Only these prefixes are
   joined with the posts' tokens, and a pair is a candidate with k of them.
2. Candidates are verified against the whole token sets.

Of a post only the tokens that some label holds are kept, so what is written,
joined and shuffled hangs on the labels' vocabulary and not on the texts' length.
The vocabulary goes to every task if it is small; a larger one keeps all tokens,
with the same result.  The token join is an equi-join, split by AQE where a token
is hot and broadcast if the prefixes are measured to be small; a pair of texts
meets only if it is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stored
from .joins import small
from .score import SENTENCE_TEMPLATE, hypothesis, template_for, tokens, words

PREFIX_HITS = 3         # k: a longer prefix, but far fewer candidates
KNOWN_MAX_ROWS = 500_000        # tokens of the labels that are sent to every task
KNOWN_MAX_BYTES = 16 << 20


def label_prefixes(held: DataFrame, labels: DataFrame, threshold: float, on: Sequence[str], label_keys: Sequence[str],
                   label_text: str, hits: int = PREFIX_HITS) -> DataFrame:
    """(on, label_keys, token, required): rarest tokens of every label, and how many of them a candidate holds.

    ``held`` is (on, tokens) of the posts.  A label without a token has no row.
    """
    named = labels.select(*on, *label_keys, F.explode(tokens(label_text)).alias("token"))
    posts = held.select(*on, F.explode("tokens").alias("token"))
    wanted = small(named.select(*on, "token").distinct())
    frequency = posts.join(wanted, [*on, "token"], "left_semi").groupBy(*on, "token").agg(F.count(F.lit(1)).alias("n_posts"))
    label = Window.partitionBy(*on, *label_keys)
    ranked = (named.join(frequency, [*on, "token"], "left")
              .withColumn("n", F.count(F.lit(1)).over(label))
              .withColumn("pos", F.row_number().over(label.orderBy(F.coalesce("n_posts", F.lit(0)), "token"))))
    need = F.greatest(F.ceil(F.col("n") * F.lit(float(threshold)) - F.lit(1e-9)), F.lit(1))
    required = F.least(need, F.lit(hits))
    kept = (ranked.withColumn("required", required.cast("int"))
            .filter(F.col("pos") <= F.col("n") - need + F.col("required"))
            .select(*on, *label_keys, "token", "required"))
    return stored(kept, "label-prefixes")


def candidate_pairs(held: DataFrame, prefixes: DataFrame, on: Sequence[str], post_keys: Sequence[str], label_keys: Sequence[str]) -> DataFrame:
    """(on, post_keys, label_keys): pairs that share enough of the label's prefix."""
    hits = held.select(*on, *post_keys, F.explode("tokens").alias("token")).join(small(prefixes), [*on, "token"])
    return (hits.groupBy(*on, *post_keys, *label_keys).agg(F.count(F.lit(1)).alias("shared"), F.max("required").alias("required"))
            .filter("shared >= required").drop("shared", "required"))


def vocabulary(known: DataFrame) -> tuple[np.ndarray, pa.Array, np.ndarray] | None:
    """Keys, tokens and codes of their pairs, all distinct, of (key, token); None if they are too many for every task."""
    known = known.select("key", "token").distinct()
    n, n_bytes = known.limit(KNOWN_MAX_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length("token"))).first()
    if n > KNOWN_MAX_ROWS or (n_bytes or 0) > KNOWN_MAX_BYTES:
        return None
    rows = known.toArrow()
    keys, at = np.unique(rows["key"].to_numpy(), return_inverse=True)
    words = rows["token"].combine_chunks().cast(pa.string()).unique()
    return keys, words, np.unique(at * max(1, len(words)) + np.asarray(pc.index_in(rows["token"], value_set=words)))


def only_known(rows: DataFrame, wanted: tuple[np.ndarray, pa.Array, np.ndarray]) -> DataFrame:
    """``rows`` with the distinct words (last column) that labels of their key (the column before, dropped) hold; null gives none."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def place(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_values):
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
        return at, sorted_values[at] == x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, known, pairs = shared.value
        size = max(1, len(known))
        for b in batches:
            *kept, key, held = b.columns
            found = pc.index_in(held.flatten(), value_set=known)
            at = np.flatnonzero(np.asarray(found.is_valid()))
            lengths = np.asarray(pc.fill_null(pc.list_value_length(held), 0))
            row = np.repeat(np.arange(b.num_rows), lengths)[at]
            token = np.asarray(found.take(pa.array(at, pa.int64()))).astype(np.int64)
            # distinct first: few are left to look up
            row, token = np.divmod(np.unique(row * size + token), size)
            code, own = place(keys, np.asarray(key)[row])
            own &= place(pairs, code * size + token)[1]
            row, token = row[own], token[own]
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.take(pa.array(token, pa.int64())))
            yield pa.RecordBatch.from_arrays([*kept, held], names=names)

    out = StructType([f for f in rows.schema.fields if f.name != rows.columns[-2]])
    names = out.names
    return rows.mapInArrow(run, out)


def held_tokens(posts: DataFrame, on: Sequence[str], post_keys: Sequence[str], text_col: str, keep: Sequence[str] = (),
                known: DataFrame | None = None) -> DataFrame:
    """(on, post_keys, keep, tokens) of every post, written once and read by every step.

    ``known`` has the labels' tokens (columns of ``on``, token) if others may be left out; every post keeps its row.
    """
    # equal keys have equal hashes; where others meet, a token more stays
    keys = [] if known is None else [c for c in known.columns if c != "token"]
    key = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    wanted = None if known is None else vocabulary(known.select(key.alias("key"), "token"))
    if wanted is None:
        held = posts.select(*on, *post_keys, *keep, tokens(text_col).alias("tokens"))
    else:
        held = only_known(posts.select(*on, *post_keys, *keep, key.alias("key of labels"), words(text_col).alias("tokens")), wanted)
    return stored(held, "post-tokens")


def contained_labels(posts: DataFrame, labels: DataFrame, threshold: float, post_keys: Sequence[str], label_keys: Sequence[str],
                     post_text: str = "tweet", label_text: str = "label_text", on: Sequence[str] = ()) -> DataFrame:
    """``on + post_keys + label_keys + score`` of every pair whose score reaches ``threshold`` (above 0).

    Equal to filtering all pairs.  Post and label keys name rows; a null text has
    no token, and a label without tokens no pair.
    """
    if not threshold > 0:
        raise ValueError("the threshold must be above 0; use lexical_scores for all pairs that share a token")
    on, post_keys, label_keys = list(on), list(post_keys), list(label_keys)
    held = held_tokens(posts, on, post_keys, post_text, known=labels.select(*on, F.explode(tokens(label_text)).alias("token")))
    found = candidate_pairs(held, label_prefixes(held, labels, threshold, on, label_keys, label_text), on, post_keys, label_keys)
    whole = labels.select(*on, *label_keys, tokens(label_text).alias("label_tokens"))
    score = F.size(F.array_intersect("tokens", "label_tokens")) / F.size("label_tokens")
    return (found.join(held, [*on, *post_keys]).join(whole, [*on, *label_keys])
            .select(*on, *post_keys, *label_keys, score.alias("score")).filter(F.col("score") >= F.lit(float(threshold))))


def score_topics(statements: DataFrame, models: Sequence[tuple[str, str]]) -> DataFrame:
    """The statements for every (model, suffix), with ``label_text``: the topic as the hypothesis that the model's template makes of its label."""
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(x).alias("suffix")) for m, x in models))
    return statements.select("*", F.inline(each)).withColumn("label_text", hypothesis(template_for("model"), F.col("topic_label")))


def scored_posts(posts: DataFrame, statements: DataFrame, models: Sequence[tuple[str, str]], text_col: str = "tweet",
                 keep: Sequence[str] = ("user_id", "created_at")) -> DataFrame:
    """(election, suffix, screen_name, tweet_id, ``keep``, tokens) of every post in every variant, for ``score_table``.

    posts (election, suffixes, screen_name, tweet_id, tweet, ``keep``): ``suffixes`` names the
    variants that the text is of, so that a text shared by variants is split once.
    """
    texts = score_topics(statements, models).select("election", F.explode(F.array("label_text", hypothesis(F.lit(SENTENCE_TEMPLATE), F.col("sentence")))).alias("text"))
    known = texts.select("election", F.explode(tokens("text")).alias("token"))
    held = held_tokens(posts, ["election", "suffixes"], ["screen_name", "tweet_id"], text_col, keep, known)
    return held.select("election", F.explode("suffixes").alias("suffix"), "screen_name", "tweet_id", *keep, "tokens")


def score_table(held: DataFrame, statements: DataFrame, models: Sequence[tuple[str, str]], threshold: float,
                keep: Sequence[str] = ("user_id", "created_at")) -> DataFrame:
    """T6 from text: scores of topic and sentence for every post, topic and model whose topic score reaches ``threshold``.

    ``scored_posts``, statements (election, topic, topic_label, sentence) and the (model, suffix) pairs to score ->
    (election, model, suffix, screen_name, tweet_id, ``keep``, topic, score_topic,
    sentence, score_sentence).  A topic is scored as the hypothesis that the
    model's template makes of its label (H24), a sentence as it stands; the two
    are independent.  Pairs below the threshold have no row: no topic filter with that
    or a higher threshold keeps them, and the dense grid (D7) restores empty groups.
    """
    on, post_keys, label_keys = ["election", "suffix"], ["screen_name", "tweet_id"], ["model", "topic"]
    topics = score_topics(statements, models)
    found = candidate_pairs(held, label_prefixes(held, topics, threshold, on, label_keys, "label_text"), on, post_keys, label_keys)
    whole = topics.select(*on, *label_keys, "sentence", tokens("label_text").alias("topic_tokens"),
                          tokens(hypothesis(F.lit(SENTENCE_TEMPLATE), F.col("sentence"))).alias("sentence_tokens"))
    share = lambda c: F.try_divide(F.size(F.array_intersect("tokens", c)).cast("double"), F.size(c))
    return (found.join(held, [*on, *post_keys]).join(whole, [*on, *label_keys])
            .select("election", "model", "suffix", *post_keys, *keep, "topic", share("topic_tokens").alias("score_topic"),
                    "sentence", share("sentence_tokens").alias("score_sentence"))
            .filter(F.col("score_topic") >= F.lit(float(threshold))))
