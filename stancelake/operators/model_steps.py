"""Language-model steps as Spark jobs.

Model calls are a caller-supplied ``complete(prompts: list[str]) -> list[str]``
run by ``mapInPandas`` over *distinct* prompts that are not already in the
replies ledger (K1, G2): replies are committed in batches before anything reads
them, so no prompt is asked twice, by several readers or by a run started again.
Every text aggregation is bounded before ``collect_list``: the posts of a group are
dealt into prompts that fit the context, by a prefix sum that splits hot groups.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.replies import stance_from_reply, topics_from_reply
from ..functions.text import WS
from ..session import shared_path, stored
from ..sources.ledger import Ledger
from .joins import small, top_n_per_group

# Context limits in tokens (fixed values of the reference: the model's window
# minus room for the answer).
CONTEXT_LIMITS = {"mixtral": 32300, "GPT4": 127488}
BATCH_CHARS = 10000

# Default token counter (J8): words and single punctuation marks.
TOKEN_PATTERN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS[1:-1]}]"

Completer = Callable[[list[str]], list[str]]


def token_count(c) -> Column:
    """J8 default: number of word / punctuation tokens (counted, not materialized)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_count(c, F.lit(TOKEN_PATTERN))


def recency_order(time_col: str = "created_at", id_col: str = "tweet_id"):
    return [F.col(time_col).desc(), F.col(id_col)]


def recent_top_n(posts: DataFrame, n: int, group_cols=("election", "party", "topic"),
                 time_col: str = "created_at", id_col: str = "tweet_id") -> DataFrame:
    """the n most recent posts per group (ties by id)."""
    return top_n_per_group(posts, group_cols, recency_order(time_col, id_col), n, "recency_rank")


AGE_BITS = 64           # of the age of a post, in microseconds
STEP_BITS = 16          # a round tells 65,536 stretches apart


def budget_cutoff(costed: DataFrame, group_cols, limit_col: str) -> DataFrame:
    """(group, from_age, spent): the first age that does not fit whole, and the cost of all younger posts.

    ``costed`` is (group, age, cost, limit): ages from 0, young ones first.  A round sums the cost of
    each group's undecided stretch by 2^STEP_BITS parts with map-side combine, and goes on
    with the part in which the budget ends; after AGE_BITS / STEP_BITS rounds that is
    one age.  A group of any size is at most 65,536 sums a round; no group is
    sorted or sent to one task.  Groups that fit whole have no row.
    """
    group = list(group_cols)
    edge = (costed.groupBy(*group).agg(F.sum("cost").alias("total"), F.max(limit_col).alias("budget"))
            .filter("total > budget").select(*group, "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("spent")))
    edge = stored(edge, "budget-edge")
    if edge.isEmpty():
        return edge.select(*group, F.col("prefix").alias("from_age"), "spent", "budget")
    for shift in range(AGE_BITS - STEP_BITS, -1, -STEP_BITS):
        part = F.shiftrightunsigned("age", shift)
        inside = costed.join(edge, group).filter(F.shiftrightunsigned("age", min(shift + STEP_BITS, 63)) == F.col("prefix") if shift + STEP_BITS < AGE_BITS else F.lit(True))
        sums = inside.groupBy(*group, "budget", "spent", part.alias("part")).agg(F.sum("cost").alias("cost"))
        w = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        upto = sums.withColumn("before", F.col("spent") + F.coalesce(F.sum("cost").over(w), F.lit(0)))
        first = upto.filter(F.col("before") + F.col("cost") > F.col("budget")).groupBy(*group, "budget").agg(F.min(F.struct("part", "before")).alias("x"))
        edge = stored(first.select(*group, "budget", F.col("x.part").alias("prefix"), F.col("x.before").alias("spent")), "budget-edge")
    return edge.select(*group, F.col("prefix").alias("from_age"), "spent", "budget")


def token_budget(posts: DataFrame, limit: int, overhead: Column,
                 group_cols=("election", "party", "topic"), text_col: str = "tweet",
                 time_col: str = "created_at", id_col: str = "tweet_id",
                 tokens: Callable[[Column], Column] = token_count,
                 token_col: str | None = None, separator_cost: int | None = None) -> DataFrame:
    """the longest most-recent prefix whose prompt fits ``limit`` tokens.

    prompt tokens = overhead + sum(post tokens) + ``separator_cost`` per separator (by
    default the separator's own tokens; 0 if the caller's tokenizer has it free, and
    a post may be free too).  The cut-off of each group is found by ``budget_cutoff``; what is
    ordered afterwards is the posts that fit and those of the one age at the edge.
    ``token_col`` names a precomputed token count.  A null text counts 0 tokens, a null
    time as the oldest; a post listed twice in a group counts once.
    """
    group = list(group_cols)
    sep = len(token_count_py(P.SEPARATOR)) if separator_cost is None else separator_cost
    n_tok = F.coalesce(F.col(token_col) if token_col else tokens(F.col(text_col)), F.lit(0))
    age = F.coalesce(F.lit(2**62) - F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(2**63 - 1))
    costed = posts.withColumns({"age__": age, "cost__": (n_tok + F.lit(sep)).cast("long"), "room__": (F.lit(limit + sep) - overhead).cast("long")})
    thin = costed.select(*group, id_col, F.col("age__").alias("age"), F.col("cost__").alias("cost"), F.col("room__").alias("room"))
    thin = stored(thin.dropDuplicates([*group, id_col]), "budget-costs")
    edge = budget_cutoff(thin, group, "room")
    near = thin.join(edge, group, "left").filter(F.col("from_age").isNull() | (F.col("age") <= F.col("from_age")))
    kept = running_sum(near.select(*group, "age", id_col, "cost", "room"), group, ["age", id_col], "cost", "upto", exclusive=False)
    room = thin.groupBy(*group).agg(F.max("room").alias("room"))
    fits = kept.join(room, group).filter("upto <= room").select(*group, id_col, (F.col("upto") - F.col("room") + F.lit(limit)).alias("prompt_tokens"))
    return posts.join(fits, [*group, id_col])


def prompt_overhead(statements: DataFrame, num_labels: int = 5) -> DataFrame:
    """(election, topic, sentence, overhead): tokens of the stance prompt
    without posts, computed once per statement (the skeleton is constant and
    token counts add up across the blank-separated parts)."""
    return statements.select("election", "topic", "sentence",
                             token_count(P.stance_prompt_overhead(F.col("sentence"), num_labels))
                             .alias("overhead"))


def token_count_py(text: str) -> list[str]:
    import regex
    return regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", text)


HOME = ["election", "party", "home", "share"]


def prompts_at_home(posts, prompts):
    """Arrow tables of a home: its texts in order (bytes), and (topic, batch_no, sentence, group_posts, members) of each of its prompts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    order = pc.sort_indices(posts, [("age", "ascending"), ("tweet_id", "ascending"), ("piece", "ascending")])
    posts = posts.select(["tweet", "stands"]).take(order)
    stands = posts["stands"].combine_chunks()
    post, (topic, batch) = pc.list_parent_indices(stands).to_numpy(), stands.flatten().flatten()
    topic, batch = topic.dictionary_encode(), batch.to_numpy()
    code = topic.indices.to_numpy()
    place = np.lexsort((post, batch, code))
    first = np.flatnonzero(np.append(True, (np.diff(code[place]) != 0) | (np.diff(batch[place]) != 0)))
    names = topic.dictionary.to_pylist()
    members = {(names[code[place[i]]], batch[place[i]]): part for i, part in zip(first, np.split(post[place], first[1:]))}
    told = [(r["topic"], r["batch_no"], r["sentence"], r["group_posts"], members[r["topic"], r["batch_no"]]) for r in prompts.select(["topic", "batch_no", "sentence", "group_posts"]).to_pylist()]
    return posts["tweet"].cast(pa.binary()).to_pylist(), told


def joined(texts, members) -> bytes:
    """The texts of a prompt, most recent first, separated."""
    return P.SEPARATOR.encode().join([texts[i] for i in members])


def _keys_schema(df: DataFrame) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in HOME)


def join_posts(dealt: DataFrame, prompts: DataFrame) -> DataFrame:
    """(election, party, topic, batch_no, group_posts, num_posts, sentence, posts_joined), the posts of every prompt joined with '~|~', most recent first.

    ``dealt`` and ``prompts`` as of ``dealt_posts``.  A text reaches its home once, however many prompts hold it, and a home is bounded."""
    def join(key, posts, prompts):
        import pyarrow as pa
        texts, told = prompts_at_home(posts, prompts)
        topic, batch, sentence, size, members = zip(*told)
        n = len(told)
        return pa.table({**{c: pa.array([k.as_py()] * n, k.type) for c, k in zip(HOME, key)}, "topic": pa.array(topic, pa.string()), "batch_no": pa.array(batch, pa.int32()),
                         "group_posts": pa.array(size, pa.int64()), "num_posts": pa.array([len(x) for x in members], pa.int32()),
                         "sentence": pa.array(sentence, pa.string()), "posts_joined": pa.array([joined(texts, x) for x in members], pa.binary()).cast(pa.string())})

    schema = f"{_keys_schema(dealt)}, topic string, batch_no int, group_posts long, num_posts int, sentence string, posts_joined string"
    return dealt.groupBy(*HOME).cogroup(prompts.groupBy(*HOME)).applyInArrow(join, schema).drop("home", "share")


def prompt_homes(dealt: DataFrame, prompts: DataFrame, num_labels: int) -> DataFrame:
    """(election, party, home, share, texts, prompts): a row a home, its texts in order, and its prompts with their digests and the texts they hold.

    A prompt is written as the places of its texts: it is several times shorter than itself, and read where its texts lie."""
    before, between, after = (x.encode() for x in P.stance_frame(num_labels))

    def gather(key, posts, prompts):
        import hashlib
        import pyarrow as pa

        def digest(members, sentence):
            out = hashlib.md5(before, usedforsecurity=False)
            out.update(joined(texts, members))
            out.update(between + sentence.encode() + after)
            return out.hexdigest()

        texts, told = prompts_at_home(posts, prompts)
        rows = [{"topic": topic, "batch_no": batch, "sentence": sentence, "group_posts": size, "num_posts": len(members), "members": members.astype("int32"),
                 "prompt_md5": digest(members, sentence)} for topic, batch, sentence, size, members in told]
        kind = pa.struct([("topic", pa.string()), ("batch_no", pa.int32()), ("sentence", pa.string()), ("group_posts", pa.int64()), ("num_posts", pa.int32()),
                          ("prompt_md5", pa.string()), ("members", pa.list_(pa.int32()))])
        return pa.table({**{c: pa.array([k.as_py()], k.type) for c, k in zip(HOME, key)}, "texts": pa.array([texts], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                         "prompts": pa.array([rows], pa.list_(kind))})

    schema = (f"{_keys_schema(dealt)}, texts array<string>, prompts array<struct<topic: string, batch_no: int, sentence: string, group_posts: bigint, "
              "num_posts: int, prompt_md5: string, members: array<int>>>")
    return dealt.groupBy(*HOME).cogroup(prompts.groupBy(*HOME)).applyInArrow(gather, schema)


ASK_BYTES = 4 << 20         # of prompts handed to a model at once


def ask_at_home(homes: DataFrame, complete: Completer, num_labels: int) -> DataFrame:
    """Replies (prompt_md5, reply, seconds) to the prompts that ``asks`` names by their place in a home of ``prompt_homes``."""
    import time
    before, between, after = (x.encode() for x in P.stance_frame(num_labels))

    def ask(md5s, prompts):
        import pyarrow as pa
        t0 = time.perf_counter()
        replies = list(complete(prompts))
        per = (time.perf_counter() - t0) / len(prompts)
        return pa.RecordBatch.from_pydict({"prompt_md5": pa.array(md5s, pa.string()), "reply": pa.array(replies, pa.string()), "seconds": pa.array([per] * len(prompts), pa.float64())})

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for i in range(batch.num_rows):
                texts = batch.column("texts")[i].values.cast(pa.binary()).to_pylist()
                told, md5s, prompts, size = batch.column("prompts")[i].values, [], [], 0
                for place in batch.column("asks")[i].as_py():
                    one = told[place]
                    prompt = b"".join((before, joined(texts, one["members"].values.to_numpy()), between, one["sentence"].as_py().encode(), after))
                    md5s.append(one["prompt_md5"].as_py())
                    prompts.append(prompt.decode())
                    size += len(prompt)
                    if size >= ASK_BYTES:
                        yield ask(md5s, prompts)
                        md5s, prompts, size = [], [], 0
                if prompts:
                    yield ask(md5s, prompts)

    return homes.select("texts", "prompts", "asks").mapInArrow(run, REPLIES_SCHEMA)


def running_sum(df: DataFrame, group_cols, order_cols, value_col: str, out_col: str,
                exclusive: bool = True, chunks: int | None = None, carry=()) -> DataFrame:
    """Skew-safe prefix sum of ``value_col`` per group in ``order_cols`` order.

    A plain window would put a whole group in one task.  Instead rows are
    range-partitioned on (group, order) into balanced chunks (a hot group is
    split across many chunks), the narrow (keys, value, chunk) projection is
    written to the shared folder so every branch sees the same chunks,
    chunk totals give per-chunk offsets, and a window inside each chunk adds
    the local running sum.  Columns in ``carry`` go along.
    """
    spark = df.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_names = [c for c in order_cols]
    narrow = (df.select(*group_cols, *order_names, value_col, *carry)
              .repartitionByRange(n, *group_cols, *order_names)
              .withColumn("__chunk", F.spark_partition_id()))
    narrow = stored(narrow, "chunks")
    totals = narrow.groupBy(*group_cols, "__chunk").agg(F.sum(value_col).alias("__tot"))
    wo = Window.partitionBy(*group_cols).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__tot").over(wo), F.lit(0))).drop("__tot")
    wl = (Window.partitionBy(*group_cols, "__chunk").orderBy(*order_names)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = narrow.withColumn("__loc", F.sum(value_col).over(wl))
    out = local.join(small(offsets), [*group_cols, "__chunk"])
    total = F.col("__off") + F.col("__loc")
    if exclusive:
        total = total - F.col(value_col)
    return out.select(*group_cols, *order_names, value_col, *carry, total.alias(out_col))


def char_batches(posts: DataFrame, group_cols=("election", "party"), text_col: str = "tweet",
                 time_col: str = "created_at", id_col: str = "tweet_id",
                 batch_chars: int = BATCH_CHARS) -> DataFrame:
    """batch number of every post when the posts of a group are written
    one after another (text + '~|~') in time order: floor(chars before / 10,000).
    Lossless: every post gets a batch."""
    sized = posts.select(*group_cols, time_col, id_col,
                         (F.length(text_col) + F.lit(len(P.SEPARATOR))).alias("chars"))
    cum = running_sum(stored(sized, "sized-chars"), group_cols, [time_col, id_col], "chars", "chars_before")
    return cum.withColumn("batch_no", F.floor(F.col("chars_before") / F.lit(batch_chars)).cast("int"))


REPLIES_SCHEMA = "prompt_md5 string, reply string, seconds double"


def replies_ledger(spark, path: str | None = None) -> Ledger:
    """The table of replies by prompt; without a path, one for this run in the shared folder."""
    return Ledger(spark, path or shared_path(spark, "replies"), REPLIES_SCHEMA, ["prompt_md5"])


def complete_distinct(prompts: DataFrame, complete: Completer, prompt_col: str = "prompt",
                      done: DataFrame | None = None, ledger: Ledger | None = None, batches: int = 4,
                      copy: bool = True) -> DataFrame:
    """J6/J7 core: call the model once per distinct prompt not yet answered.

    Returns (prompt_md5, reply, seconds).  Replies are committed to ``ledger`` batch by batch
    and read from it; a ledger of earlier runs skips what it holds (K1), so does ``done``, a
    table of replies from elsewhere, whose rows are kept.  A null prompt is not asked.  ``seconds`` is
    the model time per prompt (batch time / batch size) for the progress report (E17, see ``call_stats``).
    Prompts that are a table of ``numbered`` (with these ``batches``) need no ``copy``: which to ask is found without their texts.
    """
    import time
    ledger = ledger or replies_ledger(prompts.sparkSession)
    told = prompts.filter(F.col(prompt_col).isNotNull())
    if copy:
        keyed = told.select(F.md5(F.col(prompt_col)).alias("prompt_md5"), F.col(prompt_col).alias("prompt"))
        todo = keyed.dropDuplicates(["prompt_md5"])
    else:
        todo = keyed = told.select("prompt_md5", "prompt_row", F.col(prompt_col).alias("prompt"), "bucket__")
    if done is not None:
        todo = todo.join(done.select("prompt_md5"), "prompt_md5", "left_anti")

    def run(parts):
        for pdf in parts:
            t0 = time.perf_counter()
            replies = complete(pdf["prompt"].tolist()) if len(pdf) else []
            per = (time.perf_counter() - t0) / max(len(pdf), 1)
            yield pd.DataFrame({"prompt_md5": pdf["prompt_md5"], "reply": list(replies),
                                "seconds": [per] * len(pdf)})

    ledger.advance(todo, lambda part: part.select("prompt_md5", "prompt").mapInPandas(run, REPLIES_SCHEMA), batches, copy, None if copy else "prompt_row")
    return replies_of(keyed, ledger, done)


def numbered(prompts: DataFrame, ledger: Ledger, batches: int, name: str) -> DataFrame:
    """``prompts`` written with their digest (prompt_md5) and a number of their own (prompt_row), in a folder for each batch that will be asked."""
    keyed = prompts.withColumn("prompt_md5", F.md5("prompt")).withColumn("prompt_row", F.monotonically_increasing_id())
    return stored(keyed.select("*", ledger.bucket(batches)), name, by="bucket__")


def replies_of(keyed: DataFrame, ledger: Ledger, done: DataFrame | None = None) -> DataFrame:
    """(prompt_md5, reply, seconds) of the prompts in ``keyed``, and of all in ``done``."""
    told = ledger.read().join(keyed.select("prompt_md5").distinct(), "prompt_md5", "left_semi").select("prompt_md5", "reply", "seconds")
    if done is None:
        return told
    old = done.select("prompt_md5", "reply",
                      (F.col("seconds") if "seconds" in done.columns else F.lit(None).cast("double")).alias("seconds"))
    return told.unionByName(old)


def call_stats(replies: DataFrame) -> DataFrame:
    """Number of model calls, refused calls and mean seconds per call."""
    return replies.agg(F.count(F.lit(1)).alias("calls"),
                       F.count_if(F.col("reply") == "Bad Request").alias("refused"),
                       F.avg("seconds").alias("avg_seconds"))


TOPIC_BATCHES = 4       # in which a run of the topic model is committed


def model_topics(posts: DataFrame, statements: DataFrame, complete: Completer,
               done: DataFrame | None = None, ledger: Ledger | None = None) -> DataFrame:
    """Topic filtering.  posts (election, party, tweet_id, tweet) ->
    (election, party, topic, tweet_id), one row per topic the reply lists and
    the statement list knows (C8; duplicates in a reply are kept)."""
    ordered = (statements.groupBy("election")
               .agg(F.array_sort(F.collect_list(F.struct("topic_ix", "topic"))).alias("s"))
               .select("election", P.topic_list_block(F.transform("s", lambda x: x["topic"])).alias("block")))
    with_prompt = posts.join(small(ordered), "election").withColumn(
        "prompt", P.topic_prompt(F.col("block"), F.col("tweet")))
    # cleaned, built and hashed once, for the model and for the way back
    ledger = ledger or replies_ledger(posts.sparkSession)
    prompted = numbered(with_prompt.select("election", "party", "tweet_id", "prompt"), ledger, TOPIC_BATCHES, "topic-prompts")
    replies = complete_distinct(prompted, complete, done=done, ledger=ledger, batches=TOPIC_BATCHES, copy=False)
    parsed = (prompted.select("election", "party", "tweet_id", "prompt_md5")
              .join(replies, "prompt_md5")
              .select("election", "party", "tweet_id", F.explode(topics_from_reply("reply")).alias("t")))
    known = small(statements.select("election", "topic", F.lower("topic").alias("t")).distinct())
    return parsed.join(known, ["election", "t"]).select("election", "party", "topic", "tweet_id")


LONG_TOKENS = 1 << 13


def sized_posts(posts: DataFrame) -> DataFrame:
    """The posts with a text, with n_tok and n_bytes, cleaned and counted once: a written table for any number of runs.

    Posts that some prompt may not hold whole are in a folder of their own (``long``)."""
    sized = posts.filter(F.col("tweet").isNotNull()).select("*", *_sizes()).withColumn("long", (F.col("n_tok") > LONG_TOKENS).cast("int"))
    return stored(sized, "sized-posts", by="long")


def _sizes():
    return token_count("tweet").alias("n_tok"), F.octet_length("tweet").alias("n_bytes")


def split_posts(posts: DataFrame, most: int) -> DataFrame:
    """(tweet_id, created_at, piece, tweet, n_tok, n_bytes): posts of more than ``most`` tokens cut into pieces of at most so many; a null text is no post.

    ``posts`` may be a table of ``sized_posts``."""
    sized = posts if "n_tok" in posts.columns else sized_posts(posts)
    over = F.col("n_tok") > most if most < LONG_TOKENS or "long" not in sized.columns else (F.col("long") == 1) & (F.col("n_tok") > most)
    columns = ["tweet_id", "created_at", F.lit(0).alias("piece"), "tweet"]

    def cut(batches):
        import regex
        token = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                starts = [m.start() for m in token.finditer(r.tweet)][::most] or [0]
                for k, lo in enumerate(starts):
                    hi = starts[k + 1] if k + 1 < len(starts) else len(r.tweet)
                    rows.append((r.tweet_id, r.created_at, k, r.tweet[0 if k == 0 else lo:hi].strip()))
            yield pd.DataFrame(rows, columns=["tweet_id", "created_at", "piece", "tweet"])

    # cut once, for all that read the pieces
    long = sized.filter(over).select(*columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.schema.fields)
    pieces = stored(long.mapInPandas(cut, schema).select("*", *_sizes()), "long-post-pieces")
    return sized.filter(F.coalesce(F.col("n_tok") <= most, F.lit(True))).select(*columns, "n_tok", "n_bytes").unionByName(pieces)


HOME_PROMPTS = 12       # a party's posts are dealt into stretches as long as so many prompts
HOME_TOPICS = 64        # and a home holds the prompts that begin in a stretch, of so many topics
SLICE_TOKENS = 1 << 24      # a slice of the prompts may hold so many tokens, or all posts once


def prompt_batches(cand: DataFrame, statements: DataFrame, limit: int, stretch: int) -> DataFrame:
    """(election, party, topic, tweet_id, piece, age, batch_no, num_posts, stretch): every member of every prompt, without texts.

    ``cand`` (election, party, age, tweet_id, piece, cost, weight, topics) has a row a piece, ``statements`` (election, topic, overhead).
    A group (election, party, topic) that fits ``limit`` is one batch; else a batch holds
    the pieces that start in its part of the group's running sum, and the
    part leaves room for the group's longest piece.  Nothing is left out.  The pieces of a party
    are ordered by age once, and dealt into stretches; a group's running sum is that
    inside a stretch after the totals of the stretches before, so no group is in one task."""
    sep, group = len(token_count_py(P.SEPARATOR)), ["election", "party", "topic"]
    ordered = running_sum(cand, ["election", "party"], ["age", "tweet_id", "piece"], "weight", "before", carry=["cost", "topics"])
    placed = stored(ordered.withColumn("stretch", F.floor(F.col("before") / F.lit(stretch)).cast("long")).drop("before", "weight"), "prompt-places")
    members = lambda df: df.withColumn("topic", F.explode("topics")).drop("topics").join(statements, ["election", "topic"])
    sums = members(placed).groupBy(*group, "stretch").agg(F.sum("cost").alias("cost"), F.max("cost").alias("longest"), F.max("overhead").alias("overhead"),
                                                          F.count_if(F.col("piece") == 0).alias("n"))
    whole = Window.partitionBy(*group)
    ahead = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(limit + sep) - F.max("overhead").over(whole)
    sums = sums.select(*group, "stretch", F.coalesce(F.sum("cost").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(whole).alias("num_posts"),
                       F.when(F.sum("cost").over(whole) > room, F.greatest(room - F.max("longest").over(whole), F.lit(1))).alias("part"))
    inside = Window.partitionBy("election", "party", "stretch", "topic").orderBy("age", "tweet_id", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = members(placed.repartition("election", "party", "stretch")).withColumn("upto", F.sum("cost").over(inside) - F.col("cost"))
    batch = F.coalesce(F.floor((F.col("ahead") + F.col("upto")) / F.col("part")), F.lit(0))
    return local.join(small(stored(sums, "prompt-parts")), [*group, "stretch"]) \
                .select(*group, "tweet_id", "piece", "age", batch.cast("int").alias("batch_no"), "num_posts", "stretch")


def dealt_posts(filtered: DataFrame, posts: DataFrame, statements: DataFrame, limit: int, num_labels: int) -> tuple[DataFrame, DataFrame, int]:
    """(dealt, prompts, slices): posts at their homes, each with the prompts of the home that it stands in, and the prompts without texts.

    A post stands in the prompts of several statements, so all prompts are several times the posts; they hold
    ``slices`` times the tokens of all posts, or of SLICE_TOKENS.  A prompt's home (election, party, home, share of the topics) is the stretch
    of the party's posts in which it begins: prompts of one time and party hold the same posts, so a text goes
    to few homes, where it meets all prompts that hold it.  A home is bounded by HOME_PROMPTS and HOME_TOPICS."""
    st = small(prompt_overhead(statements.select("election", "topic", "sentence"), num_labels))
    per = st.groupBy("election").agg(F.max("overhead").alias("overhead"), F.count(F.lit(1)).alias("n"))
    overhead, topics = per.agg(F.max("overhead"), F.max("n")).first()
    sep = len(token_count_py(P.SEPARATOR))
    pieces = split_posts(posts, max(1, (limit + sep - (overhead or 0)) // 2 - sep))
    of_post = filtered.groupBy("election", "party", "tweet_id").agg(F.collect_list("topic").alias("topics"))
    cost = F.col("n_tok") + F.lit(sep)
    cand = of_post.join(pieces.select("tweet_id", "created_at", "piece", "n_tok", "n_bytes"), "tweet_id").select(
        "election", "party", F.coalesce(-F.unix_micros(F.col("created_at")), F.lit(2**63 - 1)).alias("age"), "tweet_id", "piece",
        cost.alias("cost"), (cost + F.shiftright("n_bytes", 4)).cast("long").alias("weight"), "topics")      # the bytes bound texts of few tokens
    cand = stored(cand, "prompt-candidates")
    most = max(pieces.agg(F.sum("n_tok")).first()[0] or 0, SLICE_TOKENS)
    slices = max(1, -(-(cand.agg(F.sum((F.col("cost") - F.lit(sep)) * F.size("topics"))).first()[0] or 0) // most))
    stretch = max(1, min(HOME_PROMPTS * limit, most // 8))
    members = stored(prompt_batches(cand, st.select("election", "topic", "overhead"), limit, stretch), "prompt-members")
    batch = ["election", "party", "topic", "batch_no"]
    share = F.pmod(F.xxhash64("topic"), F.lit(-(-(topics or 1) // HOME_TOPICS))).alias("share")
    homes = stored(members.groupBy(*batch).agg(F.min("stretch").alias("home"), F.max("num_posts").cast("long").alias("group_posts")).select("*", share), "prompt-homes")
    prompts = homes.toDF(*homes.columns).join(st.select("election", "topic", "sentence"), ["election", "topic"])
    at_home = members.join(small(homes.drop("group_posts")), batch).repartition("tweet_id", "piece")
    stands = at_home.groupBy("tweet_id", "piece", "age", *HOME).agg(F.collect_list(F.struct("topic", "batch_no")).alias("stands"))
    return stands.join(pieces.select("tweet_id", "piece", "tweet"), ["tweet_id", "piece"]), prompts, slices


def joined_batches(filtered: DataFrame, posts: DataFrame, statements: DataFrame, limit: int = CONTEXT_LIMITS["mixtral"],
                   num_labels: int = 5) -> DataFrame:
    """E13 for prompts: (election, party, topic, batch_no, group_posts, num_posts, posts_joined, sentence).

    filtered (election, party, topic, tweet_id) and posts (tweet_id, tweet, created_at): every post of a group
    is in one of its batches, and a batch is at most a prompt of ``limit`` tokens, so
    a row is bounded whatever the group.  Tokens are counted once per post, and no text is carried through the prefix sum.
    """
    return join_posts(*dealt_posts(filtered, posts, statements, limit, num_labels)[:2])


def model_stance(filtered: DataFrame, posts: DataFrame, statements: DataFrame, grid: DataFrame,
               complete: Completer, num_labels: int = 5, variant: str = "B",
               limit: int = CONTEXT_LIMITS["mixtral"], done: DataFrame | None = None, ledger: Ledger | None = None) -> DataFrame:
    """Stance per (election, party, topic).

    filtered (election, party, topic, tweet_id) and posts (tweet_id, tweet,
    created_at) -> prompts of at most ``limit`` tokens that hold all posts (``joined_batches``)
    -> prompt (H28) -> model, once a prompt (replies in ``ledger``) -> parse (I8-I12, ``variant``) -> int
    (H22); the stance of a group with several prompts is the mean of the
    parsed ones by posts, half-even; grid pairs without posts are neutral (I13).
    """
    spark = posts.sparkSession
    dealt, prompts, slices = dealt_posts(filtered, posts, statements, limit, num_labels)
    ledger = ledger or replies_ledger(spark)
    homes = prompt_homes(dealt, prompts, num_labels).withColumn("slice", F.pmod(F.xxhash64(*HOME), F.lit(slices)).cast("int"))
    # written, so the model call and the way back read the same prompts; a home is a long row, so few are read at once
    homes = stored(homes, "stance-prompts", by="slice", **{"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 4})
    told = homes.select(*HOME, "slice", F.posexplode("prompts").alias("place", "p"))
    prompted = stored(told.select(*HOME, "slice", "place", "p.topic", "p.group_posts", "p.num_posts", "p.prompt_md5"), "stance-prompt-keys")
    first = prompted.groupBy("prompt_md5").agg(F.min(F.struct("slice", *HOME, "place")).alias("at")).select("prompt_md5", "at.*")
    if done is not None:
        first = first.join(done.select("prompt_md5"), "prompt_md5", "left_anti")
    left = stored(ledger.todo(first), "stance-prompt-asks")
    for k in sorted(r[0] for r in left.select("slice").distinct().collect()):            # at most one row a slice
        asks = left.filter(F.col("slice") == k).groupBy(*HOME).agg(F.collect_list("place").alias("asks"))
        ledger.commit(ask_at_home(homes.filter(F.col("slice") == k).join(small(asks), HOME), complete, num_labels))
    replies = replies_of(prompted, ledger, done)
    told = F.col("p.stance").isNotNull()
    weight = F.when(told, F.col("num_posts"))
    parsed = (prompted.join(replies, "prompt_md5")
              .withColumn("p", stance_from_reply(F.col("reply"), variant))
              .groupBy("election", "party", "topic")
              .agg(F.max("group_posts").alias("num_posts"),
                   F.bround(F.sum(F.col("p.stance") * weight) / F.sum(weight)).alias("stance"),
                   F.coalesce(F.min(F.when(told, F.col("p.parse_status"))), F.min("p.parse_status")).alias("parse_status")))
    out = grid.select("election", "party", "topic").distinct().join(parsed, ["election", "party", "topic"], "left")
    return out.select("election", "party", "topic",
                      F.coalesce("num_posts", F.lit(0)).alias("num_posts"),
                      F.when(F.col("parse_status").isNull(), F.lit(3)).otherwise(F.col("stance"))
                      .cast("int").alias("stance"),
                      F.coalesce("parse_status", F.lit("no_posts")).alias("parse_status"))
