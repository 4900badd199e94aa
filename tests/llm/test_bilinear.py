"""Log-bilinear scores: counts and base by brute force, the model by a plain forward pass, gradients by differences."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stancelake.llm import log_bilinear as lb
from stancelake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, row string, word string, n string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(low) + [None]


def brute(rows):
    out_fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(t for i, text in rows if not out_fold(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        ts = tokens(text)
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        out.append((i, out_fold(i), len(ts), sum(c[t] > 0 for t in ts), n, base))
    return out


def scored(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    return lb.language_model_scores(df, lb.held_out("doc_id")).collect()


def same(got, want):
    key = lambda r: (str(r[0]), *(str(x) for x in r[1:5]), round(r[5], 6))
    a, b = sorted(map(key, got)), sorted(map(key, want))
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert [x[5] for x in a] == pytest.approx([x[5] for x in b], abs=1e-5)


def test_counts_and_base_equal_brute_force(spark):
    rows = [(i, f"The the THE w{i % 7} Été\x0bx\x0c y\x1fz   rare{i}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "no id"), (5, "again the"), (5, "again the"), (103, "z" * 300_000), (104, "A" * 50 + " " + "a" * 50)]
    got = scored(spark, rows)
    same([tuple(r)[:6] for r in got], brute(rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_words_beyond_the_dictionary_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(lb, "DICTIONARY", 5)
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(30)) + f" once{i}") for i in range(50)]
    same([tuple(r)[:6] for r in scored(spark, rows)], brute(rows))


def test_empty_tables_and_no_training_rows(spark):
    assert scored(spark, []) == []
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = [(i, "a b") for i in held]
    got = scored(spark, rows)
    same([tuple(r)[:6] for r in got], brute(rows))
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)


def test_slices_give_every_token_its_words_before(monkeypatch):
    import pyarrow as pa
    texts = ["a B  c\td", None, "", " x ", "É e " * 9, "one"]
    want = []
    for t in texts:
        row = [None] * 3 + tokens(t)[:-1] + ["END"]
        want += [(row[i], tuple(row[i - 3:i][::-1])) for i in range(3, len(row))]
    monkeypatch.setattr(lb, "PIECE", 8)
    for size in (1, 10, 1_000):
        ids, got, lead = {}, [], np.full(3, lb.BEFORE)
        for t in lb.slices(pa.array(texts), size):
            names = [k.decode() for k in t.keys.to_pylist()[:-1]] + ["END"]
            seen = np.array([ids.setdefault(n, len(ids)) for n in names])[t.code]
            back = {v: k for k, v in ids.items()} | {lb.BEFORE: None}
            got += [(names[c], tuple(back[x] for x in row)) for c, row in zip(t.code, t.before(seen, lead).tolist())]
            lead = np.concatenate([lead, seen])[-3:]
        assert got == want


def test_tails_of_arrays():
    import pyarrow as pa
    keys = ["a", "é", "word", "", "zz", "\u00ff!"]
    assert lb.tails_of(pa.array(keys, pa.binary())).tolist() == [lb.tail_of(k.encode()) for k in keys]
    assert lb.tails_of(pa.array(keys, pa.binary()).slice(2)).tolist() == [lb.tail_of(k.encode()) for k in keys[2:]]


def test_very_long_text_in_pieces_scores_as_a_whole(spark, monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(40_000))
    rows = [(0, text), (1, "w1 w2 w3"), (2, "w4 w5")]
    whole = {r.doc_id: tuple(r) for r in scored(spark, rows)}
    monkeypatch.setattr(lb, "PIECE", 1_000)
    assert [p for p in lb.pieces(b"x" * 5_000)] == [b"x" * 5_000]
    assert b"".join(lb.pieces(text.encode())) == text.encode()
    cut = {r.doc_id: tuple(r) for r in scored(spark, rows)}
    for i in whole:
        assert cut[i] == pytest.approx(whole[i], rel=1e-4)


@pytest.fixture(scope="module")
def trained(spark):
    """A vocabulary and a trained model over sf0.001, and its texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", lb.held_out("doc_id").alias("held_out"), "text")
    train = docs.filter("not held_out").select("text")
    counts = lb.count_words(train).cache()
    vocabulary = lb.Vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    values = lb.train_round(train, shared, lb.LogBilinear.initial(vocabulary.unigram), 0)
    return docs, {bytes(r.word): r.n for r in counts.collect()}, vocabulary, shared, values


def test_score_equals_a_plain_forward_pass(spark, trained):
    docs, counts, vocabulary, shared, values = trained
    net = lb.LogBilinear(values)
    place = {w: i for i, w in enumerate(vocabulary.words)}
    mass = [0.5] * lb.TAILS
    for x, n in counts.items():
        if place.get(x, lb.DICTIONARY) >= vocabulary.own:
            mass[lb.tail_of(x)] += n + 0.5
    docs = docs.filter("length(text) < 1500").limit(12)
    got = {r.row: r for r in lb.scored_lines(docs, shared, values).filter("word is null").collect()}
    for r in got.values():
        text = docs.filter(F.col("doc_id") == r.doc_id).first().text
        ws = [w.lower() for w in text.encode().split()]
        ctx, total, inner = [lb.BEFORE] * 3, 0.0, 0.0
        for w in [*ws, b""]:
            i = place.get(w, -1)
            k = i if 0 <= i < vocabulary.own else lb.OWN + zlib.crc32(w[-2:]) % lb.TAILS
            h = sum(net.r[ctx[-1 - j]].astype(float) @ net.c[j].astype(float) for j in range(3))
            s = net.q.astype(float) @ h + net.b
            total += (s[k] - np.log(np.exp(s - s.max()).sum()) - s.max()) / math.log(10)
            if k >= lb.OWN:
                inner += (math.log10(counts[w] + 0.5) if i >= 0 else 0) - math.log10(mass[k - lb.OWN])
            ctx.append(i if 0 <= i < lb.CONTEXT_WORDS else lb.CONTEXT_WORDS + lb.tail_of(w))
        assert r.log_classes == pytest.approx(total, rel=1e-4)
        assert r.log_inner == pytest.approx(inner, rel=1e-6)


def test_probabilities_sum_to_one(trained):
    _, counts, vocabulary, _, values = trained
    net = lb.LogBilinear(values)
    net.scorer()
    before = np.tile([3, 700, lb.BEFORE], (lb.CLASSES, 1))
    p_class = 10 ** net.log10_all(before, np.arange(lb.CLASSES))
    own = set(vocabulary.words[:vocabulary.own])
    total = p_class[:vocabulary.own].sum()
    share = np.full(lb.TAILS, 0.5)
    for w, n in counts.items():
        if w not in own:
            share[lb.tail_of(w)] += n + 0.5
    total += (p_class[lb.OWN:] * share / 10 ** vocabulary.log_mass).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_noise_contrastive_gradient(monkeypatch):
    """A step moves parameters against the numeric gradient of the loss."""
    rng = np.random.default_rng(2)
    unigram = rng.dirichlet(np.ones(lb.CLASSES))
    values = lb.LogBilinear.initial(unigram)
    before = rng.integers(0, lb.CONTEXTS, (6, 3))
    target = rng.integers(0, lb.CLASSES, 6)
    model = lb.LogBilinear(values.copy())
    model.trainer(unigram, 5)
    noise = np.minimum(np.searchsorted(model.cut, np.random.default_rng(5).random(lb.NOISE)), lb.CLASSES - 1)

    def loss(v):
        m = lb.LogBilinear(v)
        h = sum(m.r[before[:, j]].astype(float) @ m.c[j].astype(float) for j in range(3))
        up = (h * m.q[target]).sum(axis=1) + m.b[target] - np.log(lb.NOISE * unigram[target])
        down = h @ m.q[noise].T.astype(float) + m.b[noise] - np.log(lb.NOISE * unigram[noise])
        return (np.log1p(np.exp(-up)).sum() + np.log1p(np.exp(down)).sum()) / len(target)

    moves = {}
    monkeypatch.setattr(lb.LogBilinear, "_move", lambda self, name, at, g: moves.update({name: (at, g)}))
    model.step(before, target)
    probe = lb.LogBilinear(values.copy())
    for name, (at, g) in moves.items():
        at = np.arange(len(getattr(probe, name))) if isinstance(at, slice) else at
        for k in (0, len(at) - 1):
            where = (at[k], *(0,) * (getattr(probe, name).ndim - 1))
            p = getattr(probe, name)
            old = float(p[where])
            p[where] = old + 1e-2
            hi = loss(probe.values)
            p[where] = old - 1e-2
            lo = loss(probe.values)
            p[where] = old
            want = (hi - lo) / 2e-2
            assert float(g[(k, *where[1:])]) == pytest.approx(want, rel=0.05, abs=2e-4)


def test_model_beats_the_base_on_held_out_texts(spark):
    out = QUERIES["op13_lm_scores"](spark, "/root/testdata/sf0.01")
    r = out.filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    print("held out, log10 a token: score, base", r[0] / r[2], r[1] / r[2], "share of texts", r[3])
    assert r[0] > r[1]
    assert out.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()


@pytest.mark.parametrize("scale", [0.1, 4.0, 40.0])
def test_sums_over_classes_without_an_exponential_a_context(scale, monkeypatch):
    """Exact for narrow scores, which take no exponential a context, and for those that leave single precision."""
    rng = np.random.default_rng(3)
    values = lb.LogBilinear.initial(rng.dirichlet(np.ones(lb.CLASSES)))
    net = lb.LogBilinear(values * np.float32(scale))
    net.scorer()
    before = rng.integers(0, lb.CONTEXTS, (lb.PLACES, 700))
    scores = sum(t[w].astype(np.float64) for t, w in zip(net.tables, before)) @ net.all_q
    top = scores.max(axis=1)
    want = np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top
    assert np.allclose(net.log_sums(before), want, rtol=1e-5, atol=1e-5)
    if scale == 0.1:
        monkeypatch.setattr(lb.np, "exp", None)
        assert np.allclose(net.log_sums(before), want, rtol=1e-5, atol=1e-5)


def test_only_long_words_become_digests():
    long_ = "x" * (lb.LONG_WORD + 1)
    t = next(lb.slices(pa.array([f"b {long_} A {long_} b", None, long_]), 1 << 20))
    assert t.keys.to_pylist() == [b"b", lb.key_of(long_.encode()), b"a", lb.END]
    assert t.code.tolist() == [0, 1, 2, 1, 0, 3, 3, 1, 3]
