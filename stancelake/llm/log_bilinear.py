"""Language-model scores by a log-bilinear neural model.

Events.  A token is a word or the end of a text.  The end and the most frequent
words have a class of their own; every other word, seen or not, belongs to one of
``TAILS`` classes by its last two bytes.  The model predicts the class from the
words before; inside a class a word has its smoothed share of the class's count,
and words never seen share one half of a count.  Probabilities of all events sum to 1.

Model.  With a vector r for each context word, a matrix C for each place before
the target and a vector q and bias b for each class, the score of class w after
v1 v2 v3 is (sum of C_j r_vj) . q_w + b_w.  It is trained in numpy by noise-contrastive
estimation: each class seen is told from classes drawn from the unigram
distribution, which needs no sum over classes.  Scoring normalises exactly, by one
matrix product of a batch of contexts with all classes.

Spark.  Words are counted over all training texts with map-side combine.  Every
training text is used once: an eighth of them first, then, from the average of the
tasks' models, the others; tasks' models are averaged by their tokens in two
steps, so no task reads more than a square root of them.  Words beyond the
``DICTIONARY`` most frequent ones are looked up by a shuffle join, and as none of
them is frequent, no key is hot.  What is broadcast is bounded: the dictionary
and the model, whose sizes do not depend on the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

DICTIONARY = 1 << 16    # words with a known count in every task
OWN = 512               # classes of one token: the end and the most frequent words
TAILS = 64              # classes of all other words
CONTEXT_WORDS = 2048    # context words with a vector of their own
PLACES = 3              # words before the target
WIDTH = 32              # values of a vector
NOISE = 64              # noise classes per batch
FIRST_BATCH = 512       # tokens of a task's first training steps; then twice as many after every
LAST_BATCH = 2048       # DOUBLING steps, up to these: coarse steps first, smooth ones later
DOUBLING = 64
RATE = 0.08
FIRST_SHARE = 8         # one in so many training texts makes the first round
PIECE = 1 << 22         # bytes of a text tokenised at once
SLICE_BYTES = 1 << 22   # bytes of texts trained on or scored at once: contexts they share are summed once
COUNTED_BYTES = 1 << 24
LONG_WORD = 40
WIDEST = 60.0           # a product of exponentials that spans more powers of e may leave single precision
END = b""

SPACES = b" \t\n\x0b\x0c\r"


# ---- tokens ------------------------------------------------------------------

def pieces(raw: bytes) -> Iterator[bytes]:
    """Slices of about PIECE bytes that end between words."""
    first = 0
    while len(raw) - first > PIECE:
        cut = first + PIECE
        ends = [i for i in (raw.find(bytes([c]), cut) for c in SPACES) if i >= 0]
        if not ends:
            break
        yield raw[first:min(ends)]
        first = min(ends)
    yield raw[first:]


def key_of(word: bytes) -> bytes:
    """A word, or the digest of a very long one, which is no valid text."""
    return word if len(word) <= LONG_WORD else b"\xff" + hashlib.sha256(word).digest()


def tail_of(word: bytes) -> int:
    return crc32(word[-2:]) % TAILS


TAIL_OF_TWO = np.array([crc32(bytes([a, b])) % TAILS for a in range(256) for b in range(256)])
TAIL_OF_ONE = np.array([crc32(bytes([a])) % TAILS for a in range(256)])


def tails_of(keys: pa.Array) -> np.ndarray:
    """``tail_of`` of every key of an array of binaries that are not empty, and of the empty one."""
    ends = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset:keys.offset + len(keys) + 1].astype(np.int64)
    data = np.frombuffer(keys.buffers()[2] or b"\0", np.uint8)
    sizes, last = np.diff(ends), ends[1:] - 1
    one = data[np.maximum(last, 0)]
    out = np.where(sizes > 1, TAIL_OF_TWO[data[np.maximum(last - 1, 0)].astype(np.int64) * 256 + one], TAIL_OF_ONE[one])
    return np.where(sizes == 0, tail_of(END), out)


class Slice:
    """Tokens of some pieces of texts: ``keys`` of the distinct words, the word ``code`` of every token (the
    last code is the end of a text), and the ``piece`` it stands in."""

    def __init__(self, parts: pa.Array, rows: np.ndarray, begins: np.ndarray, finishes: np.ndarray):
        split = pc.ascii_split_whitespace(pc.ascii_lower(parts))      # A-Z; blank and the five controls after tab
        flat = split.flatten()
        told = np.asarray(pc.greater(pc.binary_length(flat), 0))
        piece = np.repeat(np.arange(len(parts)), np.diff(split.offsets.to_numpy()))[told]
        found = flat.filter(pa.array(told)).dictionary_encode()
        keys = found.dictionary.cast(pa.binary())
        far = pc.greater(pc.binary_length(keys), LONG_WORD)
        if far.true_count:
            keys = pc.replace_with_mask(keys, far, pa.array([key_of(w) for w in keys.filter(far).to_pylist()], pa.binary()))
        self.keys = pa.concat_arrays([keys, pa.array([END], pa.binary())])
        sizes = np.bincount(piece, minlength=len(parts))
        ends = np.cumsum(sizes)
        self.code = np.insert(found.indices.to_numpy().astype(np.int64), ends[finishes], len(keys))
        self.piece = np.insert(piece, ends[finishes], np.flatnonzero(finishes))
        self.rows, self.begins = rows, begins

    def before(self, contexts: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """tokens x PLACES: context ids before each token; ``lead`` are those before the slice."""
        n = len(self.code)
        first = np.searchsorted(self.piece, np.flatnonzero(self.begins))          # where texts begin
        start = np.full(n, -PLACES)
        start[first[first < n]] = first[first < n]
        start = np.maximum.accumulate(start) if n else start
        row = np.concatenate([lead, contexts])
        at = np.arange(n)
        out = np.empty((n, PLACES), dtype=np.int64)
        for j in range(1, PLACES + 1):
            out[:, j - 1] = np.where(at - j >= start, row[at + PLACES - j], BEFORE)
        return out


def slices(texts: pa.Array, size: int) -> Iterator[Slice]:
    """Slices of about ``size`` bytes of a column of texts; null is empty; a text longer than PIECE is cut between words."""
    parts, rows, begins, finishes, held = [], [], [], [], 0

    def made() -> Slice:
        return Slice(pa.array(parts, pa.binary()).cast(pa.string()), np.array(rows), np.array(begins, bool), np.array(finishes, bool))

    for i, x in enumerate(texts.cast(pa.binary())):
        cut = list(pieces(x.as_py() or b""))
        for k, part in enumerate(cut):
            parts.append(part)
            rows.append(i)
            begins.append(k == 0)
            finishes.append(k == len(cut) - 1)
            held += len(part)
            if held >= size:
                yield made()
                parts, rows, begins, finishes, held = [], [], [], [], 0
    if parts:
        yield made()


def held_out(id_col: Column | str, folds: int = 5, fold: int = 1) -> Column:
    """True where the CRC-32 of the id in decimal falls into the fold; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


# ---- counts ------------------------------------------------------------------

def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n long) of a one-column table of texts; the end of a text is the empty word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column(0), COUNTED_BYTES):
                n = np.bincount(t.code, minlength=len(t.keys))
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([t.keys.take(pa.array(seen)), pa.array(n[seen])], names=["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Counts of the dictionary's words, classes and their mass; bounded by DICTIONARY."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = total.n or 0, total.v or 0
        frequent = counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).toArrow()      # at most DICTIONARY rows
        pairs = [(w, n) for w, n in zip(frequent["word"].to_pylist(), frequent["n"].to_pylist()) if w != END]
        ended = counts.filter(F.col("word") == F.lit(END)).first()
        self.words = [END, *(w for w, _ in pairs)]
        self.counts = np.array([ended.n if ended else 0, *(n for _, n in pairs)], dtype=np.float64)
        self.word_array = pa.array(self.words, pa.binary())
        tails = np.array([tail_of(w) for w in self.words])
        self.own = min(OWN, len(self.words))
        # mass of the tail classes: all their words but those with a class of their own, and half a count for the unseen
        tail = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAILS)).cast("int")
        mass = np.full(TAILS, 0.5)
        for r in counts.groupBy(tail.alias("tail")).agg(F.sum(F.col("n") + 0.5).alias("mass")).collect():   # at most TAILS rows
            mass[r.tail] += r.mass
        seen = self.counts[:self.own] > 0       # the end is no counted word where there is no training text
        np.subtract.at(mass, tails[:self.own][seen], (self.counts[:self.own] + 0.5)[seen])
        self.log_mass = np.log10(np.maximum(mass, 0.5))
        self.classes = np.where(np.arange(len(self.words)) < self.own, np.arange(len(self.words)), OWN + tails).astype(np.int64)
        self.contexts = np.where(np.arange(len(self.words)) < CONTEXT_WORDS, np.arange(len(self.words)), CONTEXT_WORDS + tails).astype(np.int64)
        self.log_counts = np.log10(self.counts + 0.5)
        p = np.full(OWN + TAILS, 1e-30)
        p[:self.own] = self.counts[:self.own] + 0.5
        p[OWN:] = np.maximum(mass, 0.5)
        self.unigram = p / p.sum()
        self.log_all = math.log10(self.n + 0.5 * (self.v + 1))


CLASSES = OWN + TAILS
CONTEXTS = CONTEXT_WORDS + TAILS + 1        # the last one: before the text
BEFORE = CONTEXTS - 1


# ---- model -------------------------------------------------------------------

class LogBilinear:
    """Parameters in single precision; ``steps`` trains, ``log10_all`` scores."""

    SHAPES = {"r": (CONTEXTS, WIDTH), "c": (PLACES, WIDTH, WIDTH), "q": (CLASSES, WIDTH), "b": (CLASSES,)}

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.float32)
        first = 0
        for name, shape in self.SHAPES.items():
            size = math.prod(shape)
            setattr(self, name, self.values[first:first + size].reshape(shape))
            first += size

    @classmethod
    def initial(cls, unigram: np.ndarray) -> np.ndarray:
        """Small vectors and the unigram as bias: untrained, the model is the unigram."""
        rng = np.random.default_rng(11)
        r = rng.normal(0, 0.1, cls.SHAPES["r"])
        c = np.stack([np.eye(WIDTH) / (j + 1) for j in range(PLACES)])
        q = rng.normal(0, 0.1, cls.SHAPES["q"])
        return np.concatenate([x.ravel() for x in (r, c, q, np.log(unigram))]).astype(np.float32)

    def trainer(self, unigram: np.ndarray, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.cut = np.cumsum(unigram)
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.squares = LogBilinear(np.full(len(self.values), 1e-4))
        self.done = 0

    def _move(self, name: str, at, gradient: np.ndarray) -> None:
        """A step against the gradient, shorter where squares have grown (at: rows, or all)."""
        p, s = getattr(self, name), getattr(self.squares, name)
        s[at] += gradient * gradient
        p[at] -= RATE * gradient / np.sqrt(s[at])

    @staticmethod
    def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, distinct rows, where each starts in that order)."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")       # ids are below 2^16: a radix sort
        ids = rows[order]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return order, ids[starts], starts

    def _by_row(self, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, ids, starts = self._sorted(rows)
        return ids, np.add.reduceat(values.take(order, axis=0), starts, axis=0)

    def step(self, before: np.ndarray, target: np.ndarray) -> None:
        """One batch of noise-contrastive estimation; ``before`` is tokens x PLACES.

        Products with the matrix of a place are made once for each distinct word there.
        """
        n = len(target)
        places, h = [], np.zeros((n, WIDTH), dtype=np.float32)
        for j in range(PLACES):
            order, ids, starts = self._sorted(before[:, j])
            r = self.r.take(ids, axis=0)
            of = np.empty(n, dtype=np.int64)
            of[order] = np.repeat(np.arange(len(ids)), np.diff(np.append(starts, n)))
            h += (r @ self.c[j]).take(of, axis=0)
            places.append((order, ids, starts, r))
        noise = np.minimum(np.searchsorted(self.cut, self.rng.random(NOISE)), CLASSES - 1)
        q_target, q_noise = self.q.take(target, axis=0), self.q.take(noise, axis=0)
        # loss: -log s(up) - sum of log(1 - s(down)), s the logistic function
        up = np.einsum("ij,ij->i", h, q_target) + self.b[target] - self.log_noise[target]
        d_up = (-1 / (n * (1 + np.exp(np.clip(up, -30, 30))))).astype(np.float32)
        d_down = h @ q_noise.T
        d_down += self.b[noise] - self.log_noise[noise]
        np.maximum(d_down, -30, out=d_down)
        np.negative(d_down, out=d_down)
        np.exp(d_down, out=d_down)
        d_down += 1
        np.reciprocal(d_down, out=d_down)
        d_down *= np.float32(1 / n)
        dh = d_down @ q_noise
        q_target *= d_up[:, None]
        dh += q_target
        dq = np.empty((n, WIDTH + 1), dtype=np.float32)
        np.multiply(h, d_up[:, None], out=dq[:, :-1])
        dq[:, -1] = d_up
        seen, dq = self._by_row(target, dq)
        rows, dq = self._by_row(np.concatenate([seen, noise]), np.vstack([dq, np.column_stack([d_down.T @ h, d_down.sum(axis=0)])]))
        sums = [np.add.reduceat(dh.take(order, axis=0), starts, axis=0) for order, _, starts, _ in places]
        gr = self._by_row(np.concatenate([ids for _, ids, _, _ in places]), np.vstack([v @ self.c[j].T for j, v in enumerate(sums)]))
        gc = np.stack([r.T @ v for (_, _, _, r), v in zip(places, sums)])
        self._move("q", rows, dq[:, :-1])
        self._move("b", rows, dq[:, -1])
        self._move("r", *gr)
        self._move("c", slice(None), gc)

    def steps(self, before: np.ndarray, target: np.ndarray) -> None:
        a = 0
        while a < len(target):
            size = min(FIRST_BATCH << min(self.done // DOUBLING, 16), LAST_BATCH)
            self.step(before[a:a + size], target[a:a + size])
            self.done += 1
            a += size

    def scorer(self) -> None:
        """Tables of context vectors, with a last value of 1 in all that meets the bias in one product; and for each place
        the exponentials of what a context word there adds to the score of every class, over the largest of them."""
        self.tables = [np.column_stack([self.r @ self.c[j], np.full(CONTEXTS, j == 0)]).astype(np.float32) for j in range(PLACES)]
        self.all_q = np.ascontiguousarray(np.vstack([self.q.T, self.b]))
        self.tops, self.spans, self.factors = [], [], []
        for table in self.tables:
            added = table.astype(np.float64) @ self.all_q
            top = added.max(axis=1)
            self.tops.append(top)
            self.spans.append(top - added.min(axis=1))
            self.factors.append(np.exp(added - top[:, None]).astype(np.float32))

    def log_sums(self, before: np.ndarray, size: int = 256) -> np.ndarray:
        """log of the sum over all classes of the exponentials of their scores, for contexts in columns.

        The exponential of a sum is the product of the places' exponentials, so that a context costs no product with the
        classes and no exponential; batches of ``size`` stay in the cache.  Where the product of a context may leave the range
        of single precision, its scores are summed as they are.
        """
        out = sum(top.take(words) for top, words in zip(self.tops, before))
        far = sum(span.take(words) for span, words in zip(self.spans, before)) > WIDEST
        held = np.empty((2, size, CLASSES), dtype=np.float32)
        for a in range(0, before.shape[1], size):
            at = before[:, a:a + size]
            product, other = held[:, :at.shape[1]]
            self.factors[0].take(at[0], axis=0, out=product, mode="clip")
            for j in range(1, PLACES - 1):
                product *= self.factors[j].take(at[j], axis=0, out=other, mode="clip")
            self.factors[-1].take(at[-1], axis=0, out=other, mode="clip")
            sums = np.einsum("ij,ij->i", product, other)
            out[a:a + size] += np.log(np.maximum(sums, np.finfo(np.float32).tiny).astype(np.float64))
        rest = np.flatnonzero(far)
        for a in range(0, len(rest), size):
            at = rest[a:a + size]
            scores = sum(table.take(words[at], axis=0).astype(np.float64) for table, words in zip(self.tables, before)) @ self.all_q
            top = scores.max(axis=1)
            out[at] = np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top
        return out

    def log10_all(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 of the normalised probability of each target class; classes are summed once for each distinct context."""
        key = before[:, 0]
        for j in range(1, PLACES):
            key = key * CONTEXTS + before[:, j]
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        distinct = np.ascontiguousarray(before[first].T)
        logs = self.log_sums(distinct)
        out = np.empty(len(target))
        rows = np.ascontiguousarray(self.all_q.T)
        for a in range(0, len(target), 1 << 13):
            at = of[a:a + (1 << 13)]
            context = sum(table.take(words.take(at), axis=0) for table, words in zip(self.tables, distinct))
            out[a:a + (1 << 13)] = np.einsum("ij,ij->i", context, rows.take(target[a:a + (1 << 13)], axis=0)) - logs[at]
        return out / math.log(10)


def encoded(known: Vocabulary, t: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dictionary ids or -1, classes, contexts) of a slice's distinct words."""
    ids = np.asarray(pc.fill_null(pc.index_in(t.keys, value_set=known.word_array), -1)).astype(np.int64)
    classes, contexts = known.classes.take(ids), known.contexts.take(ids)       # -1 takes the last, put right below
    rare = np.flatnonzero(ids < 0)
    tails = tails_of(t.keys)[rare]
    classes[rare], contexts[rare] = OWN + tails, CONTEXT_WORDS + tails
    return ids, classes, contexts


def train_round(texts: DataFrame, vocabulary, values: np.ndarray, round_: int) -> np.ndarray:
    """One pass over a one-column table of texts, from ``values``: the tasks' models averaged by their tokens."""
    spark = texts.sparkSession
    start = spark.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = vocabulary.value, TaskContext.get().partitionId()
        model = LogBilinear(start.value.copy())
        model.trainer(known.unigram, seed=1_000_003 * round_ + task)
        seen, lead = 0, np.full(PLACES, BEFORE)
        for b in batches:
            for t in slices(b.column(0), SLICE_BYTES):
                _, classes, contexts = encoded(known, t)
                row = contexts[t.code]
                model.steps(t.before(row, lead), classes[t.code])
                seen += len(row)
                lead = np.concatenate([lead, row])[-PLACES:]
        if seen:
            moved = (model.values.astype(np.float64) * seen).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([float(seen)]), pa.array([moved], pa.binary())], names=["task", "seen", "moved"])

    def added(t: pa.Table) -> pa.Table:
        total = np.zeros(len(values))
        for chunk in t.column("moved").chunks:
            for x in chunk:
                total += np.frombuffer(x.as_py(), np.float64)
        return pa.table({"task": t.column("task").slice(0, 1), "seen": [float(pc.sum(t.column("seen")).as_py())], "moved": pa.array([total.tobytes()], pa.binary())})

    models = staged(texts.mapInArrow(run, "task long, seen double, moved binary"), "bilinear-models")
    groups = max(1, math.isqrt(models.count()))
    by_group = models.withColumn("task", F.col("task") % groups).groupBy("task").applyInArrow(added, models.schema)
    every = by_group.withColumn("task", F.lit(0).cast("long")).groupBy("task").applyInArrow(added, models.schema).first()
    return values if every is None else (np.frombuffer(every.moved, np.float64) / every.seen).astype(np.float32)


# ---- scores ------------------------------------------------------------------

LINES = ("row long, doc_id {id}, held_out boolean, n_tokens long, n_known long, log_counts double, log_classes double, log_inner double, "
         "word binary, times long")


def scored_lines(docs: DataFrame, vocabulary, values: np.ndarray) -> DataFrame:
    """One line per document with its sums over the dictionary's words, and one per rare word of it.

    ``docs`` has doc_id, held_out and text.
    """
    schema = LINES.format(id=docs.schema["doc_id"].dataType.simpleString())
    model = docs.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, done = vocabulary.value, TaskContext.get().partitionId(), 0
        net = LogBilinear(model.value.copy())
        net.scorer()
        names = [c.strip().split()[0] for c in LINES.split(", ")]
        for b in batches:
            n, lead = b.num_rows, np.full(PLACES, BEFORE)
            sums = {c: np.zeros(n) for c in ("n_tokens", "n_known", "log_counts", "log_classes", "log_inner")}
            row = (task << 40) + done + np.arange(n)
            done += n
            kinds = [pa.int64(), b.column("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
            for t in slices(b.column("text"), SLICE_BYTES):
                ids, classes, contexts = encoded(known, t)
                at = t.rows[t.piece]
                told, inner = ids >= 0, classes >= OWN
                log_counts = np.where(told, known.log_counts.take(ids), 0.0)
                log_inner = np.where(inner, log_counts - known.log_mass[np.maximum(classes - OWN, 0)], 0.0)
                seen = contexts[t.code]
                p = net.log10_all(t.before(seen, lead), classes[t.code])
                lead = np.concatenate([lead, seen])[-PLACES:]
                has = told & (known.counts.take(ids) > 0)
                for name, of_token in (("n_tokens", None), ("n_known", has[t.code].astype(float)), ("log_counts", log_counts[t.code]),
                                       ("log_classes", p), ("log_inner", log_inner[t.code])):
                    sums[name] += np.bincount(at, weights=of_token, minlength=n)
                rare = ~told[t.code]
                if rare.any():
                    pair, times = np.unique(at[rare] * len(t.keys) + t.code[rare], return_counts=True)
                    words = t.keys.take(pa.array(pair % len(t.keys)))
                    yield pa.RecordBatch.from_arrays([pa.array(row[pair // len(t.keys)]), *(pa.nulls(len(pair), k) for k in kinds[1:8]), words, pa.array(times)], names=names)
            counts = [pa.array(sums[c].astype(np.int64)) for c in ("n_tokens", "n_known")]
            logs = [pa.array(sums[c]) for c in ("log_counts", "log_classes", "log_inner")]
            yield pa.RecordBatch.from_arrays([pa.array(row), b.column("doc_id"), b.column("held_out"), *counts, *logs, *(pa.nulls(n, k) for k in kinds[8:])], names=names)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def language_model_scores(docs: DataFrame, is_held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model learns from rows that are not held out.  A null text is empty; an empty
    text is its end alone.  ``score`` is the model's log10 probability of the whole text, ``base_score``
    that of the smoothed unigram: sum of log10((c + 0.5) / (N + 0.5 (V + 1))).  Very long texts are
    tokenised in pieces, which changes nothing.  Repeated rows are scored each, and count as often in
    training; a null id is a training row.  With no training row, every token is unknown and classes
    are equally likely by their half counts.  An empty table gives an empty result; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(is_held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.filter(~F.col("held_out"))
    counts = staged(count_words(train.select("text")), "bilinear-counts")
    vocabulary = Vocabulary(counts)
    shared = context.broadcast(vocabulary)
    values = LogBilinear.initial(vocabulary.unigram)
    early = F.pmod(F.xxhash64("text"), F.lit(FIRST_SHARE)) == 0
    values = train_round(train.filter(early).select("text"), shared, values, 0)
    values = train_round(train.filter(~early).select("text"), shared, values, 1)
    lines = staged(scored_lines(rows, shared, values), "bilinear-lines")
    asked = lines.filter("word is not null").select("row", "word", "times")
    answered = (asked.join(counts, "word", "left").groupBy("row")
                .agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"),
                     F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known")))
    out = lines.filter("word is null").drop("word", "times").join(answered, "row", "left")
    rare = F.coalesce("rare_logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                      F.lit(vocabulary.n).cast("long").alias("train_tokens"),
                      (F.col("log_counts") + rare - F.col("n_tokens") * F.lit(vocabulary.log_all)).alias("base_score"),
                      (F.col("log_classes") + F.col("log_inner") + rare).alias("score"))
