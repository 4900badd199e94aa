"""Translation memory and language detection.

J4: English posts are copied.  A post of MAX_CHARS characters or more is split
into its sentences, so that no request exceeds the service's limit, and its translations
are rejoined in order (H31).  Pieces are looked up in a content-addressed memory, a ledger
keyed by the digest of language and text; only misses go to the caller's translator,
each distinct piece once, and are committed before anything reads them, so a second run
calls the translator for nothing.  Joins run on digests, not on texts.  Every post gets a status instead of aborting the run.

J5: a character-trigram language profile learned from labelled posts.  A post's score is one
vector, a value per language, summed in the stage that reads the text: what is
shuffled is a row per post and task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..session import shared_path
from ..sources.languages import LANGUAGES
from ..sources.ledger import Ledger

MAX_CHARS = 5000          # C12: texts this long are not sent whole (fixed value of the reference)
SENTENCE = r"[^.!?\n]+[.!?]*|[.!?]+"
MEMORY_SCHEMA = "digest string, lang string, text string, translation string, error string"
NO_LANGUAGE = "none"      # J5: of a post that shares no trigram with any profile
Translator = Callable[[list[str], str], list[str]]


def language_name(code) -> Column:
    """Code -> name; unknown codes fall back to 'auto'."""
    c = F.col(code) if isinstance(code, str) else code
    m = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, c), F.lit("auto"))


def known_language(code) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return c.isin(*LANGUAGES.keys())


def status_of_error(err) -> Column:
    """A translator error mentioning 429 is a rate limit."""
    e = F.col(err) if isinstance(err, str) else err
    return F.when(e.contains("429"), F.lit("rate_limited")).otherwise(F.lit("error"))


def translation_pieces(text) -> Column:
    """A text the service takes is one piece; a longer one its sentences, and a longer sentence slices."""
    t = F.col(text) if isinstance(text, str) else text
    most = MAX_CHARS - 1
    sentences = F.filter(F.transform(F.regexp_extract_all(t, F.lit(SENTENCE), 0), P.stripped), lambda x: x != "")
    slices = F.flatten(F.transform(sentences, lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(x) - 1) / F.lit(most)).cast("int")), lambda i: F.substring(x, i * most + 1, F.lit(most)))))
    return F.when(F.length(t) < MAX_CHARS, F.array(t)).otherwise(slices)


def piece_digest(lang, text) -> Column:
    """Content address of a piece in the memory."""
    return F.sha2(F.concat_ws("\u001f", lang, text), 256)


def translation_memory(spark: SparkSession, path: str | None = None) -> Ledger:
    """The memory under ``path`` (without one, a memory of this run in the shared folder); pieces with an error are tried again."""
    return Ledger(spark, path or shared_path(spark, "translation-memory"), MEMORY_SCHEMA, ["digest"], finished="error IS NULL")


def remember(memory: Ledger, rows: DataFrame) -> None:
    """Commit known translations (lang, text, translation)."""
    memory.commit(rows.select(piece_digest("lang", "text").alias("digest"), "lang", "text", "translation", F.lit(None).cast("string").alias("error")))


def translate(posts: DataFrame, translator: Translator, memory: Ledger | None = None,
              text_col: str = "tweet", lang_col: str = "lang", target: str = "en",
              retries: int = 10, retry_sleep_s: float = 0.0, batches: int = 4) -> tuple[DataFrame, Ledger]:
    """J4.  Returns (translated posts, memory).

    Output columns: the input columns with ``tweet`` replaced by the English
    text, ``original_tweet`` (B1) and ``translation_status`` in
    {copied, empty, memory, ok, error, rate_limited}: memory if every piece was known before,
    an error if any piece failed (the text is then null).  A failing
    piece is retried ``retries`` more times (11 attempts by default) before it
    gets an error; the run goes on either way, and a later run asks for it again.
    A null text stays null and counts as empty; a null language goes to the translator as null.
    """
    if target not in LANGUAGES:
        raise ValueError(f"unknown target language {target}")
    memory = memory or translation_memory(posts.sparkSession)
    t, src = F.col(text_col), F.col(lang_col)
    route = (F.when(src == target, F.lit("copied"))                      # C7
             .when(F.length(F.coalesce(t, F.lit(""))) == 0, F.lit("empty"))                      # C12
             .otherwise(F.lit("translate")))
    cut = posts.withColumn("route_", route).withColumn("pieces_", F.when(F.col("route_") == "translate", translation_pieces(t)))
    digests = F.transform("pieces_", lambda x: piece_digest(src, x))
    path = shared_path(posts.sparkSession, "translation-pieces")
    cut = cut.withColumn("digests_", digests).withColumn("row_", F.monotonically_increasing_id())
    cut.write.parquet(path)
    cut = posts.sparkSession.read.schema(cut.schema).parquet(path)
    pieces = cut.select(F.col(lang_col).alias("lang"), F.inline(F.arrays_zip(F.col("digests_").alias("digest"), F.col("pieces_").alias("text"))))
    before = memory.batches().select("batch")
    known = [r.batch for r in before.toLocalIterator()]                 # a row a committed batch

    def one(texts, lang):
        try:
            return list(translator(texts, lang)), [None] * len(texts)
        except Exception as e:  # noqa: BLE001 - status column instead of aborting
            if len(texts) == 1:
                import time
                err = str(e)
                for _ in range(retries):
                    if retry_sleep_s:
                        time.sleep(retry_sleep_s)
                    try:
                        return list(translator(texts, lang)), [None]
                    except Exception as e2:  # noqa: BLE001
                        err = str(e2)
                return [None], [err]
            outs, errs = [], []
            for t1 in texts:                     # isolate the failing text
                o, er = one([t1], lang)
                outs += o
                errs += er
            return outs, errs

    def run(parts):
        for b in parts:
            langs, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            outs, errs = [None] * len(texts), [None] * len(texts)
            for lang in dict.fromkeys(langs):
                at = [i for i, x in enumerate(langs) if x == lang]
                for i, o, e in zip(at, *one([texts[i] for i in at], lang)):
                    outs[i], errs[i] = o, e
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(outs, pa.string()), pa.array(errs, pa.string())],
                                             names=["digest", "lang", "text", "translation", "error"])

    memory.advance(pieces.dropDuplicates(["digest"]), lambda part: part.select("digest", "lang", "text").mapInArrow(run, MEMORY_SCHEMA), batches)
    old = F.col("batch").isin(*known) if known else F.lit(False)
    told = (memory.rows().groupBy("digest")
            .agg(F.max("translation").alias("translation"), F.max(F.when(F.col("translation").isNull(), F.col("error"))).alias("error"),
                 F.max((old & F.col("error").isNull()).cast("int")).alias("old")))
    wanted = cut.filter("route_ = 'translate'").select("row_", F.posexplode("digests_").alias("pos", "digest")).join(told, "digest", "left")
    # a post's pieces, in their order: bounded by its own text
    whole = wanted.groupBy("row_").agg(
        F.array_sort(F.collect_list(F.struct("pos", "translation"))).alias("parts"),
        F.max(F.when(F.col("translation").isNull(), F.coalesce("error", F.lit("no translation")))).alias("error"), F.min("old").alias("old"))
    joined = cut.join(whole, "row_", "left")
    status = (F.when(F.col("route_") != "translate", F.col("route_"))
              .when(F.col("error").isNotNull(), status_of_error("error"))
              .when(F.col("old") == 1, F.lit("memory")).otherwise(F.lit("ok")))
    english = (F.when(F.col("route_") == "copied", t)
               .when(F.col("route_") == "empty", F.lit(""))
               .when(F.col("error").isNotNull(), F.lit(None).cast("string"))
               .otherwise(P.translation_join(F.transform(F.coalesce("parts", F.array()), lambda x: x["translation"]))))
    out = joined.select(*(english.alias(c) if c == text_col else F.col(c) for c in posts.columns),
                        t.alias("original_tweet"), status.alias("translation_status"))
    return out, memory


# ------------------------------------------------------------------ J5 -----

def trigrams(c) -> Column:
    """Character trigrams of the lower-cased text, every position, in one
    linear regex pass (a zero-width lookahead captures overlapping windows;
    per-position substring would be quadratic on long UTF-8 texts)."""
    x = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.regexp_extract_all(x, F.lit("(?s)(?=(.{3}))"), 1)


class LanguageProfile:
    """Trigram profile: ``table`` (tri, gains array<double>), with a value per language of ``languages``.

    A gain is how much more the log-probability of the trigram in the language is than
    that of an unseen one (0 if the language never saw it); ``unseen`` is the latter.
    """

    def __init__(self, table: DataFrame, languages: list[str], unseen: list[float]):
        self.table, self.languages, self.unseen = table, languages, unseen


def language_profile(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageProfile:
    """Profile with add-one smoothing; posts without a text or a language teach nothing.

    Counts are summed per task before they are shuffled, and written once; the driver
    gets a row per language, of which there are as many as LANGUAGES names, or few more.
    """
    spark = labelled.sparkSession
    occ = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(trigrams(text_col)).alias("tri"))
    path = shared_path(spark, "trigram-counts")
    occ.groupBy("lang", "tri").agg(F.count(F.lit(1)).alias("c")).write.parquet(path)
    counts = spark.read.schema("lang string, tri string, c long").parquet(path)
    v = counts.agg(F.count_distinct("tri")).first()[0]
    totals = {r.lang: r.c for r in counts.groupBy("lang").agg(F.sum("c").alias("c")).collect()}     # a row a language
    languages = sorted(totals)
    gains = [F.log(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("c"))), F.lit(0)) + 1) for x in languages]
    path = shared_path(spark, "trigram-profile")
    counts.groupBy("tri").agg(F.array(*gains).alias("gains") if gains else F.array().cast("array<double>").alias("gains")).write.parquet(path)
    table = spark.read.schema("tri string, gains array<double>").parquet(path)
    return LanguageProfile(table, languages, [-math.log(totals[x] + v) for x in languages])


def detect_language(posts: DataFrame, profile: LanguageProfile, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, predicted_lang, predicted_name) of each post.

    score(lang) = sum over trigram occurrences of their log-probability, an unseen one
    counting ``unseen``; languages that share no trigram with the post are no candidates, and
    a post without a candidate is NO_LANGUAGE.  Ties go to the language last by code.
    """
    occ = posts.select(id_col, F.explode_outer(trigrams(text_col)).alias("tri"))
    hits = occ.join(profile.table, "tri", "left")
    n = len(profile.languages)
    sums = [F.sum(F.coalesce(F.get("gains", F.lit(i)), F.lit(0.0))).alias(f"gain_{i}") for i in range(n)]
    per_post = hits.groupBy(id_col).agg(F.count("tri").alias("n_tri"), *sums)
    scored = [F.struct((F.col(f"gain_{i}") + F.col("n_tri") * F.lit(profile.unseen[i])).alias("score"), F.lit(profile.languages[i]).alias("lang"),
                       (F.col(f"gain_{i}") > 0).alias("shares")) for i in range(n)]
    if not scored:
        return per_post.select(id_col, F.lit(NO_LANGUAGE).alias("predicted_lang"), language_name(F.lit(NO_LANGUAGE)).alias("predicted_name"))
    best = F.array_max(F.filter(F.array(*scored), lambda x: x["shares"]))
    lang = F.coalesce(best["lang"], F.lit(NO_LANGUAGE))
    return per_post.select(id_col, lang.alias("predicted_lang"), language_name(lang).alias("predicted_name"))
