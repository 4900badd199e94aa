"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is an n-gram model over UTF-8 bytes (order 5), so an n-gram is an
exact 40-bit number and no word is out of vocabulary.  It is trained on trusted
documents, each distinct text once; one in four calibrates instead.  The side of
a text hangs on the smallest hash of its shingles, so that copies, and most near
copies, of a training text never calibrate.

Scoring is a join, not a broadcast model:

1. Documents are packed into blocks of about ``BLOCK_BYTES`` of text.  A block
   asks for each of its distinct n-grams once, in one request per shard; shards
   are chosen by the third and fourth byte, so that every count a probability
   needs (orders 5, 4, 3: the n-gram, its contexts, their continuations) lies in
   the same shard.  Orders 2 and 1 are at most 65,536 numbers and go everywhere.
   The number of shards follows the number of distinct n-grams; two bytes fixed, a
   shard's pairs have at most 2^24 n-grams each.
2. Requests and counts are cogrouped by shard; where a shard has more than
   ``GROUP_GRAMS`` requested n-grams it is answered by several groups, each with the
   shard's counts.  A group reads its counts once.
3. Answers and blocks are cogrouped by block: a block looks its n-grams up and
   sums them by document.

What is shuffled is the compressed text once, and distinct n-grams by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import staged

ORDER = 5
SHARD_GRAMS = 1 << 19           # distinct n-grams of the model in a shard
GROUP_GRAMS = 1 << 23           # requested n-grams that one group answers
BLOCK_BYTES = 12 << 20
PART_BYTES = 2 << 20            # n-grams of so many bytes at once
BROADCAST_IDS = 2_000_000       # trusted ids (at most 16 MB as numbers) that are sent to every executor
SHINGLE = 40                    # bytes of a shingle of the split between training and calibration
CALIBRATION_FOLDS = 4           # one of so many calibrates
QUANTILE = 0.995
LEAST_DISCOUNT = 0.02
LOW_ORDERS = 1 << 16


# ---- n-grams ---------------------------------------------------------------

def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-gram of every byte, number of bytes of each text); a text begins after four zero bytes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    pad = bytes(ORDER - 1)
    a = np.frombuffer(pad + pad.join(raw), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    n = max(0, len(a) - ORDER + 1)
    g = np.zeros(n, dtype=np.int64)
    for i in range(ORDER):
        g |= a[i:i + n] << (8 * (ORDER - 1 - i))
    # of the pads between texts no n-gram is wanted
    starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    keep = np.ones(n, dtype=bool)
    for k in range(ORDER - 1):
        at = starts[1:] - (ORDER - 1) + k
        keep[at[at < n]] = False
    return g[keep], sizes


def parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PART_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def distinct(texts: list[str]) -> np.ndarray:
    found = [pd.unique(ngrams(texts[a:b])[0]) for a, b in parts(texts)]
    return np.sort(pd.unique(np.concatenate(found))) if found else np.zeros(0, dtype=np.int64)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts."""
    grams, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for a, b in parts(texts):
        g, c = np.unique(ngrams(texts[a:b])[0], return_counts=True)
        grams, at = np.unique(np.concatenate([grams, g]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n, c]), minlength=len(grams)).astype(np.int64)
    return grams, n


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return (((grams >> 8) & 0xFFFF) * 40503 & 0xFFFF) * shards >> 16


def squeeze(a: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences, byte by byte."""
    d = np.diff(a, prepend=0).astype("<i8")
    return zstandard.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unsqueeze(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel())


# ---- blocks ----------------------------------------------------------------

def packed(batch: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_table(batch)
    # repeats far apart in a block are found too
    far = zstandard.ZstdCompressionParameters.from_level(6, window_log=24, enable_ldm=True)
    return zstandard.ZstdCompressor(compression_params=far).compress(sink.getvalue())


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(blob)).read_all()


BLOCKS = "block long, blob binary, n_grams long, requests array<struct<shard:int,grams:binary>>"


def held_texts(batches: Iterator[pa.RecordBatch], text_of) -> Iterator[pa.Table]:
    """Rows of a task gathered until they hold BLOCK_BYTES of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(text_of(b)), 0))
        first = 0
        while first < b.num_rows:       # a block ends at the first row that fills it
            fits = int(np.searchsorted(np.cumsum(lengths[first:]), max(1, BLOCK_BYTES - size))) + 1
            part = b.slice(first, fits)
            held.append(part)
            size += int(lengths[first:first + fits].sum())
            first += part.num_rows
            if size >= BLOCK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def text_in(whole, text_col: str):
    """The text column of a column of whole rows; of chunks or one array."""
    return pc.struct_field(whole, text_col)


def make_blocks(rows: DataFrame, text_col: str, shards: int) -> DataFrame:
    """Blocks of a one-column table of whole rows (structs)."""
    kind = pa.list_(pa.struct([("shard", pa.int32()), ("grams", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, t in enumerate(held_texts(batches, lambda b: text_in(b.column(0), text_col))):
            grams = distinct([x or "" for x in text_in(t.column(0), text_col).to_pylist()])
            shard = shard_of(grams, shards)
            requests = [{"shard": int(s), "grams": squeeze(grams[shard == s])} for s in np.unique(shard)]
            cols = [pa.array([(task << 32) + n], pa.int64()), pa.array([packed(t)], pa.binary()), pa.array([len(grams)], pa.int64()), pa.array([requests], kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "blob", "n_grams", "requests"])

    return rows.mapInArrow(run, BLOCKS)


# ---- model -----------------------------------------------------------------

def count_ngrams(texts: DataFrame) -> DataFrame:
    """(gram, n) of a one-column table of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in held_texts(batches, lambda b: b.column(0)):
            g, n = counted([x or "" for x in t.column(0).to_pylist()])
            for a in range(0, len(g), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(g[a:a + (1 << 17)]), pa.array(n[a:a + (1 << 17)])], names=["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def continuations(counts: DataFrame, order: int) -> DataFrame:
    """(gram, n) one order lower: how many different bytes stand before each n-gram."""
    return counts.groupBy(F.col("gram").bitwiseAND((1 << 8 * order) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2, 3 and more, held between a little and the count: no byte gets probability 0."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [0.0, 1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
    return np.clip(d, [0.0, LEAST_DISCOUNT, LEAST_DISCOUNT, LEAST_DISCOUNT], [0.0, 1.0, 2.0, 3.0])


class Level:
    """One order of interpolation: alpha of n-grams, gamma of contexts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, d: np.ndarray):
        self.grams = grams
        self.contexts, at = np.unique(grams >> 8, return_inverse=True)
        total = np.bincount(at, weights=n, minlength=len(self.contexts))
        cut = d[np.minimum(n, 3)]
        self.gamma = np.bincount(at, weights=cut, minlength=len(self.contexts)) / np.maximum(total, 1)
        self.alpha = np.maximum(n - cut, 0) / total[at]

    @staticmethod
    def at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), missing)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[i] == wanted, values[i], missing)

    def interpolate(self, wanted: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """p(w | h) = alpha(h w) + gamma(h) p(w | shorter h); a context never seen leaves it all to the lower order."""
        return self.at(self.grams, self.alpha, wanted, 0.0) + self.at(self.contexts, self.gamma, wanted >> 8, 1.0) * lower


def lower(grams: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams & ((1 << 8 * order) - 1), return_counts=True)


class Model:
    """Discounts by order and the table of p(w | one byte), small enough for every task."""

    def __init__(self, counts: DataFrame):
        levels = {ORDER: counts}
        for order in range(ORDER - 1, 0, -1):
            levels[order] = continuations(levels[order + 1], order)
        n = [F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
        self.discounts = {}
        for order, t in levels.items():
            r = t.agg(*n).first()
            self.discounts[order] = discounts(r.n1, r.n2, r.n3, r.n4)
        tables = {order: levels[order].toArrow() for order in (1, 2)}    # at most 256 and 65,536 rows
        p = np.full(256, 1 / 256)
        wanted = np.arange(256, dtype=np.int64)
        for order in (1, 2):
            g, c = tables[order]["gram"].to_numpy(), tables[order]["n"].to_numpy()
            by = np.argsort(g)
            if order == 2:
                wanted = np.arange(LOW_ORDERS, dtype=np.int64)
                p = p[wanted & 0xFF]
            p = Level(g[by], c[by], self.discounts[order]).interpolate(wanted, p)
        self.low = p

    def log_probabilities(self, grams: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Of ``wanted`` n-grams of one shard, given the shard's counts (ascending)."""
        levels = [(ORDER, grams, n)]
        for order in (4, 3):
            levels.append((order, *lower(levels[-1][1], order)))
        p = self.low[wanted & 0xFFFF]
        for order, g, c in reversed(levels):
            p = Level(g, c, self.discounts[order]).interpolate(wanted & ((1 << 8 * order) - 1), p)
        return np.log(p)


def answer(blocks: DataFrame, counts: DataFrame, model: Model, shards: int) -> DataFrame:
    """(block, shard, log_p): log probabilities of the n-grams of each request, in their order."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    asked = blocks.agg(F.sum("n_grams")).first()[0] or 0
    salts = max(1, -(-asked // (shards * GROUP_GRAMS)))

    def run(requests: pa.Table, known: pa.Table) -> pa.Table:
        g, n = known.column("gram").to_numpy(), known.column("n").to_numpy()
        by = np.argsort(g)
        g, n = g[by], n[by]
        out = [shared.value.log_probabilities(g, n, unsqueeze(x.as_py())).astype("<f4").tobytes() for x in requests.column("grams")]
        return pa.table({"block": requests.column("block"), "shard": requests.column("shard"), "log_p": pa.array(out, pa.binary())})

    middle = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    shard = F.shiftright((middle * 40503).bitwiseAND(0xFFFF) * shards, 16).cast("int")
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    requests = blocks.select("block", salt.alias("salt"), F.inline("requests")).groupBy("shard", "salt")
    known = counts.select("gram", "n", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).groupBy("shard", "salt")
    return requests.cogroup(known).applyInArrow(run, "block long, shard int, log_p binary")


def score_rows(texts: list[str], shards: int, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cross entropy in nats a byte, bytes) of each text; an empty text has none (NaN)."""
    grams = distinct(texts)
    shard = shard_of(grams, shards)
    log_p = np.zeros(len(grams))
    for s in np.unique(shard):
        log_p[shard == s] = np.frombuffer(answers[int(s)], "<f4")
    out, n_bytes = np.full(len(texts), np.nan), np.zeros(len(texts), dtype=np.int64)
    for a, b in parts(texts):
        g, sizes = ngrams(texts[a:b])
        sums = np.concatenate([[0.0], np.cumsum(log_p[np.searchsorted(grams, g)])])
        ends = np.cumsum(sizes)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[a:b] = -(sums[ends] - sums[ends - sizes]) / sizes
        n_bytes[a:b] = sizes
    return out, n_bytes


class Scorer:
    """The counts of a model, staged, and how to score rows with them."""

    def __init__(self, texts: DataFrame):
        self.counts = staged(count_ngrams(texts), "quality-counts")
        self.shards = min(LOW_ORDERS, max(1, -(-self.counts.count() // SHARD_GRAMS)))
        self.model = Model(self.counts)

    def scored(self, rows: DataFrame, text_col: str) -> DataFrame:
        """(whole, n_bytes, entropy) of a one-column table of whole rows."""
        shards = self.shards
        blocks = staged(make_blocks(rows, text_col, shards), "quality-blocks")
        answers = answer(blocks, self.counts, self.model, shards)

        def run(block: pa.Table, answered: pa.Table) -> pa.Table:
            t = unpacked(block.column("blob")[0].as_py())
            texts = [x or "" for x in text_in(t.column(0), text_col).to_pylist()]
            entropy, n_bytes = score_rows(texts, shards, dict(zip(answered.column("shard").to_pylist(), answered.column("log_p").to_pylist())))
            return pa.table({"whole": t.column(0), "n_bytes": pa.array(n_bytes), "entropy": pa.array(entropy, from_pandas=True)})

        out = StructType([*rows.schema.fields, StructField("n_bytes", LongType()), StructField("entropy", DoubleType())])
        return blocks.select("block", "blob").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, out)


# ---- classifier --------------------------------------------------------------

def stirred(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def smallest_shingle(raw: bytes) -> int:
    """Smallest hash of the text's SHINGLE-byte shingles (of the padded text, if it is shorter)."""
    a = np.frombuffer(raw.ljust(SHINGLE, b"\0"), dtype=np.uint8)
    low = np.uint64(2**64 - 1)
    for first in range(0, len(a) - SHINGLE + 1, PART_BYTES):
        part = a[first:first + PART_BYTES + SHINGLE - 1]
        w = np.zeros(len(part) - 7, dtype=np.uint64)
        for i in range(8):
            w |= part[i:i + len(w)].astype(np.uint64) << np.uint64(8 * i)
        n = len(part) - SHINGLE + 1
        h = np.full(n, 7, dtype=np.uint64)
        for at in range(0, SHINGLE, 8):
            h = stirred(h, w[at:at + n])
        low = min(low, stirred(h, np.uint64(SHINGLE)).min())
    return int(low)


def trusted_texts(docs: DataFrame, labels: DataFrame, trusted: Column | str, id_col: str, text_col: str, lang_col: str,
                  side: bool | None = None) -> DataFrame:
    """(lang, text, calibrates) of every distinct trusted text that is not empty, or of those of one ``side``; of its languages, the first.

    The side is told before anything is shuffled, so that each side can be read by its only
    consumer and no trusted text need be written.  The ids are broadcast if they are at most
    BROADCAST_IDS, else the join shuffles the texts; of the texts, trusted ones are shuffled,
    copies of a task combined before.
    """
    ids = staged(labels.filter(trusted).filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct(), "quality-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            calibrates = pa.array([smallest_shingle(x.as_py()) % CALIBRATION_FOLDS == 0 for x in b.column(1).cast(pa.binary())], pa.bool_())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), calibrates], names=["lang", "text", "calibrates"])
            yield out if side is None else out.filter(pc.equal(calibrates, side))

    texts = docs.filter(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sides = texts.join(ids, "id").select("lang", "text").mapInArrow(run, "lang string, text string, calibrates boolean")
    return (sides.groupBy(F.xxhash64("text").alias("mark")).agg(F.min("lang").alias("lang"), F.any_value("text").alias("text"), F.any_value("calibrates").alias("calibrates"))
            .drop("mark"))


def adjusted(entropy: Column, n_bytes: Column) -> Column:
    """Entropy less what chance adds to a short text: its spread falls with the root of the length."""
    return entropy - F.lit(SPREAD) / F.sqrt(n_bytes.cast("double"))


SPREAD = 2.0


def judged(docs: DataFrame, labels: DataFrame, trusted: Column | str, quantile: float = QUANTILE,
           id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(whole, perplexity, threshold, accepted) of every row, whole being the row itself; see ``classify``."""
    scorer = Scorer(trusted_texts(docs, labels, trusted, id_col, text_col, lang_col, side=False).select("text"))
    held_back = trusted_texts(docs, labels, trusted, id_col, text_col, lang_col, side=True)
    calibration = scorer.scored(held_back.select(F.struct("lang", "text").alias("whole")), "text")
    calibration = staged(calibration.select(F.col("whole.lang").alias("lang"), "entropy", "n_bytes"), "quality-calibration")
    # rounded, so that the aggregate holds a bounded number of distinct values
    value = F.percentile(F.round(adjusted(F.col("entropy"), F.col("n_bytes")), 5), F.lit(quantile)).alias("limit")
    least = round(1 / (1 - quantile)) if quantile < 1 else 1
    by_lang = calibration.filter("lang is not null").groupBy("lang").agg(value, F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")
    by_lang = staged(by_lang, "quality-limits")             # a row a language: Spark knows its bytes, and broadcasts it
    every = calibration.agg(value).first()["limit"]
    out = scorer.scored(docs.select(F.struct(*docs.columns).alias("whole")), text_col)
    out = out.join(by_lang, F.col("whole").getField(lang_col) == F.col("lang"), "left")
    limit = F.coalesce("limit", F.lit(every).cast("double")) + F.lit(SPREAD) / F.sqrt(F.col("n_bytes").cast("double"))
    entropy = F.col("entropy")
    ok = F.when(entropy.isNull(), False).otherwise(F.coalesce(entropy <= limit, F.lit(True)))
    return out.select("whole", F.exp("entropy").alias("perplexity"), F.exp(F.when(entropy.isNotNull(), limit)).alias("threshold"), ok.alias("accepted"))


def classify(docs: DataFrame, labels: DataFrame, trusted: Column | str, quantile: float = QUANTILE,
             id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with perplexity (per byte), threshold (of the row's language and length) and accepted.

    A row is accepted if its perplexity is at most its threshold.  The model is
    fitted on the distinct texts of trusted documents but one in four, which calibrate.  The
    threshold is the ``quantile`` of all calibration texts of the same
    language (to five decimals of entropy); a language with fewer of them than
    the quantile needs for one document above it (null included) takes that of
    all languages; a short text is allowed what chance adds to it.  A text given
    many times counts once in the model and in the quantile, so its copies change
    no decision.  A null or empty text has no perplexity and is not accepted; very long
    texts are scored whole, a block each.  Without any calibration text nothing can be
    told, and every non-empty text is accepted, with a null threshold.  Repeated rows are
    judged each.  Rows keep their columns; one called perplexity, threshold or accepted is
    replaced (``accepted_documents`` keeps them).  An empty table gives an empty result.
    """
    out = judged(docs, labels, trusted, quantile, id_col, text_col, lang_col)
    kept = [F.col("whole").getField(c).alias(c) for c in docs.columns if c not in ("perplexity", "threshold", "accepted")]
    return out.select(*kept, "perplexity", "threshold", "accepted")


def accepted_documents(docs: DataFrame, labels: DataFrame, trusted: Column | str, **options) -> DataFrame:
    """The accepted rows of ``docs`` as they are, whatever their columns are called."""
    out = judged(docs, labels, trusted, **options).filter("accepted")
    return out.select(*(F.col("whole").getField(c).alias(c) for c in docs.columns))
