"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters by language and hash bucket; each
task sums its own counts before they are shuffled.  The matrix of log
probabilities (buckets x languages) is broadcast in blocks of at most
``LANGS_PER_BLOCK`` languages, so a block is at most 32 MB whatever the data.
Scoring turns a batch of texts into one sparse row of n-grams per document and
adds up its log probabilities in numpy, language by language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BUCKETS = 1 << 15
ORDERS = 3
LANGS_PER_BLOCK = 128
BATCH_CHARS = 400_000
MIX = np.uint32(0x9E3779B1)     # an odd multiplier; any would do
UNKNOWN = "und"
DIGITS = re.compile(r"\S*\d\S*")
PLAIN = re.compile(r"[\W_]+")
FIT_QUANTILE = 0.005            # of the fit of a language's labelled documents
FIT_MARGIN = 1.0                # nats an n-gram below that quantile from which a text is of no learned language
FIT_SPREAD = 2.0                # what chance takes from the fit of a text, times the root of its characters


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BATCH_CHARS characters; a longer text is a run of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def hashed_ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (bucket of every n-gram, end of each text in that array)."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) for t in lower])
    h = codes * MIX
    alive = np.ones(len(codes), dtype=bool)         # n-grams don't cross from text to text
    for order in range(1, ORDERS + 1):
        if order > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * MIX + codes[order - 1:] if len(h) else h
            alive[np.maximum(ends - order + 1, 0)[ends - order + 1 < len(alive)]] = False
        mixed = (h ^ np.uint32(order)) * MIX
        bucket = (mixed >> np.uint32(32 - 15)).astype(np.int64)
        keep = alive[:len(bucket)]
        upto = np.concatenate([[0], np.cumsum(keep)])
        yield bucket[keep], upto[np.minimum(ends, len(bucket))]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n): n-grams by language and bucket; bucket -1 counts documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, g in b.groupby("lang"):
                total = sums.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                texts = g["text"].tolist()
                total[-1] += len(texts)
                for lo, hi in _batches(texts):
                    for bucket, _ in hashed_ngrams(texts[lo:hi]):
                        total[:-1] += np.bincount(bucket, minlength=BUCKETS)
            if len(sums) > LANGS_PER_BLOCK:         # many languages: pass on what there is
                yield from _counts(sums)
                sums = {}
        yield from _counts(sums)

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return (rows.mapInPandas(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def _counts(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": np.where(at == BUCKETS, -1, at).astype(np.int32), "n": total[at]})


def _matrix(counts: DataFrame, langs: list[str], documents: int) -> np.ndarray:
    """Log probabilities (languages x buckets + 1); the last column holds the log priors."""
    t = counts.filter(F.col("lang").isin(langs)).select("lang", "bucket", "n").toArrow()
    row = {lang: i for i, lang in enumerate(langs)}
    m = np.zeros((len(langs), BUCKETS + 1))
    at = np.fromiter((row[x] for x in t["lang"].to_pylist()), dtype=np.int64, count=t.num_rows)
    m[at, t["bucket"].to_numpy()] = t["n"].to_numpy()
    priors = np.log(m[:, -1] / documents)
    grams = m[:, :-1] + 1.0                          # add-one smoothing
    out = np.log(grams / grams.sum(axis=1, keepdims=True))
    return np.column_stack([out, priors])


def _scores(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Log likelihood plus log prior, texts x languages."""
    out = np.tile(matrix[:, -1], (len(texts), 1))
    for lo, hi in _batches(texts):
        for bucket, ends in hashed_ngrams(texts[lo:hi]):
            for k, row in enumerate(matrix):
                sums = np.concatenate([[0.0], np.cumsum(row.take(bucket))])[ends]
                out[lo:hi, k] += np.diff(np.concatenate([[0.0], sums]))
    return out


def _fits(texts: list[str], matrix: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """Mean log probability of an n-gram of each text in its language ``pred``, plus what chance takes from a short text.

    Numbers, addresses and marks tell no language: only words without digits
    count, if there are any.
    """
    words = [PLAIN.sub(" ", DIGITS.sub(" ", t)).strip() or t for t in texts]
    out = np.zeros(len(texts))
    for k in np.unique(pred):
        at = np.flatnonzero(pred == k)
        total = _scores([words[i] for i in at], matrix[[k]])[:, 0] - matrix[k, -1]
        chars = np.array([len(words[i].lower()) for i in at], dtype=np.float64)
        n = sum(np.maximum(chars - j, 0) for j in range(ORDERS))
        out[at] = total / n + FIT_SPREAD / np.sqrt(chars)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """Log probabilities of the learned languages, in blocks small enough for every task."""

    def __init__(self, training: DataFrame, text_col: str = "text", lang_col: str = "lang"):
        counts = staged(train(training, text_col, lang_col), "langid-counts")
        totals = counts.filter("bucket = -1").select("lang", "n").toArrow()
        langs, documents = sorted(totals["lang"].to_pylist()), sum(totals["n"].to_pylist())
        blocks = [langs[a:a + LANGS_PER_BLOCK] for a in range(0, len(langs), LANGS_PER_BLOCK)]
        context = training.sparkSession.sparkContext
        self.shared = [context.broadcast((block, _matrix(counts, block, documents))) for block in blocks]


def told(docs: DataFrame, model: Model, text_col: str = "text", with_fit: bool = False) -> DataFrame:
    """(whole, lang_pred, score, fit) of every row, whole being the row itself; see ``identify``."""
    low = F.lit(float("-inf"))
    out = docs.select(F.struct(*docs.columns).alias("whole"), F.lit(UNKNOWN).alias("lang_pred"), low.alias("best"), low.alias("lse"),
                      F.lit(None).cast("double").alias("fit"))
    names, schema = out.columns, out.schema
    for shared in model.shared:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, matrix = shared.value
            for b in batches:
                texts = [t or "" for t in pc.struct_field(b.column(0), text_col).to_pylist()]
                at = np.array([i for i, t in enumerate(texts) if has_letter(t)], dtype=np.int64)
                pred, old, lse, fit = (np.array(b.column(i).to_pylist(), dtype=kind) for i, kind in enumerate((object, np.float64, np.float64, np.float64), 1))
                if len(at):
                    s = _scores([texts[i] for i in at], matrix)
                    top = s.argmax(axis=1)
                    best = s[np.arange(len(at)), top]
                    better = best > old[at]
                    pred[at[better]] = np.array(known, dtype=object)[top[better]]
                    if with_fit:
                        fit[at[better]] = _fits([texts[i] for i in at[better]], matrix, top[better])
                    lse[at] = np.logaddexp(lse[at], np.logaddexp.reduce(s, axis=1))
                    old[at] = np.maximum(old[at], best)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred.tolist(), pa.string()), pa.array(old), pa.array(lse),
                                                  pa.array(fit, from_pandas=True)], names=names)

        out = out.mapInArrow(run, schema)
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(F.least(F.exp(F.col("best") - F.col("lse")), F.lit(1.0)))
    return out.select("whole", "lang_pred", score.alias("score"), "fit")


def identify(docs: DataFrame, is_training: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All of ``docs`` with lang_pred and score (posterior probability of lang_pred, 0 to 1).

    The model is learned from the text and non-null language of rows where
    ``is_training`` holds; nothing but the text enters a prediction.  A text that
    is null or has no letter, or any text if nothing could be learned, is ``und``
    with score 0.  Ties go to the language first in order of code points.  Very long
    texts are read whole.  Repeated rows are told each, and count as often in training.
    Rows and columns of ``docs`` are kept as they are and two are added; a column of
    theirs called lang_pred or score is replaced.  An empty table gives an empty result.
    """
    out = told(docs, Model(docs.filter(is_training), text_col, lang_col), text_col)
    kept = [F.col("whole").getField(c).alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return out.select(*kept, "lang_pred", "score")


def in_learned_language(docs: DataFrame, is_training: Column, least_score: float, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose language is told with ``least_score`` or more and whose text fits it, whatever their columns are called.

    The posterior only compares the learned languages; a text of none of them,
    or junk, gets one too, near 1.  So the fit of its words has to come within
    FIT_MARGIN of what all but FIT_QUANTILE of the language's labelled documents
    reach (all, if they are too few for that quantile).  Unlike the score, the fit
    doesn't grow with the text's length.  A null text or one without a letter goes.
    """
    # texts are scored twice, the labelled ones for the limits and all for the filter: that costs less than to
    # write all texts once more
    model = Model(docs.filter(is_training), text_col, lang_col)
    whole = lambda c: F.col("whole").getField(c).alias(c)
    value = F.round("fit", 4)                          # a bounded number of distinct values
    labelled = told(docs.filter(is_training).select(text_col, lang_col), model, text_col, with_fit=True)
    same = labelled.select("lang_pred", "fit", whole(lang_col)).filter(F.col("lang_pred") == F.col(lang_col))
    limit = F.when(F.count(F.lit(1)) < round(1 / FIT_QUANTILE), F.min(value)).otherwise(F.percentile(value, F.lit(FIT_QUANTILE)))
    limits = staged(same.groupBy(F.col("lang_pred").alias("known")).agg((limit - FIT_MARGIN).alias("least")), "langid-limits")
    kept = told(docs, model, text_col, with_fit=True).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    kept = kept.join(limits, F.col("lang_pred") == F.col("known"), "left")
    return kept.filter(F.coalesce(F.col("fit") >= F.col("least"), F.lit(True))).select(*(whole(c) for c in docs.columns))
