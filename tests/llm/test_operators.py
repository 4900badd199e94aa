"""Operators of the training-data subpackage against brute force, on odd rows: nulls, empties, ties, repeats, clashing names."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stancelake.llm import chat, kneser_ney, langid, mixing, neardup_sets, neardup_vectors, packing, tokencount, topk, transducer, warc
from stancelake.llm.q_packing import tokenizer_files

DOCS = "doc_id long, text string, lang string, source string, low string, token string, node string, n string, h string, a string, id_ string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(*r, *(None,) * (4 - len(r)), "x", "x", "x", "x", "x", "x", "x") for r in rows], DOCS)


# ---- top-k -----------------------------------------------------------------

def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(-3, 4, rng.integers(0, 9))]) for i in range(90)]
    rows += [(5, rows[5][1]), (None, [1, 2]), (200, None), (201, [2**33, 1]), (202, [2**33, 0])]
    df = spark.createDataFrame(rows, "vec_id long, weights array<long>").withColumn("rank", F.lit(9))
    got = topk.exhaustive_topk(df, F.col("vec_id") % 10 == 0, k=7, rows_per_block=16, queries_per_block=4).collect()
    known = dict((i, w) for i, w in rows if i is not None and w is not None)
    want = []
    for q in (i for i in known if i % 10 == 0):
        s = sorted((-sum(x * y for x, y in zip(known[q], w)), i) for i, w in known.items() if i != q)[:7]
        want += [(q, r, i, -v) for r, (v, i) in enumerate(s, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_topk_quantizes_and_leaves_out_odd_vectors(spark):
    rows = [(0, [0.5, -0.01]), (1, [float("nan"), 1.0]), (2, None), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 1.0])]
    got = {r.vec_id: r.weights for r in topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {0: [32, -1], 5: [64, 64]}
    empty = topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.exhaustive_topk(empty, F.col("vec_id") % 2 == 0).count() == 0


# ---- revisits --------------------------------------------------------------

def test_revisits(spark):
    full = lambda i, url, ts, **h: (i, url, ts, 200, {k.replace("_", "-"): v for k, v in h.items()} or None)
    again = lambda i, url, ts, **h: (i, url, ts, 304, {k.replace("_", "-"): v for k, v in h.items()} or None)
    rows = [full(1, "http://WWW.A.org:80/x/?b=2&a=1#f", 10, ETag='"1"', Content_Length="5", Vary="x"),
            full(2, "https://a.org/x?a=1&b=2", 20, etag='W/"2"', Last_Modified="m"),
            again(3, "a.org/x?a=1&b=2", 15, ETag='W/"1"', Content_Length="0", Date="d"),
            again(4, "http://a.org/x?b=2&a=1", 25, ETag='"1"'), again(5, "http://a.org/x?b=2&a=1", 26, Last_Modified="m"),
            again(6, "http://a.org/x?b=2&a=1", 10), again(7, None, 5), again(8, "http://a.org/x", None), again(9, "http://a.org/x?b=2&a=1", 27),
            (10, "http://a.org/x?b=2&a=1", 28, 404, None), (11, "http://a.org/x?b=2&a=1", 29, None, None)]
    hot = [full(100 + i, "http://hot/", i, etag=f'"{i}"') for i in range(0, 4000, 2)] + [again(100 + i, "http://hot/", i, etag=f'"{i - 1}"') for i in range(1, 4000, 2)]
    df = spark.createDataFrame(rows + hot, "record_id long, url string, ts long, status int, headers map<string,string>").withColumn("chunk", F.lit("x"))
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {i: (got[i].original_id, got[i].outcome) for i in range(3, 10)} == {
        3: (1, "resolved"), 4: (2, "mismatch"), 5: (2, "resolved"), 6: (None, "no_original"), 7: (None, "no_key"), 8: (None, "no_key"), 9: (2, "unverified")}
    assert got[3].headers == {"etag": 'W/"1"', "date": "d", "content-length": "5", "vary": "x"} and 10 not in got
    assert all(got[100 + i].original_id == 99 + i and got[100 + i].outcome == "resolved" for i in range(1, 4000, 2))
    assert warc.resolve_revisits(df.limit(0)).count() == 0


# ---- mixing ----------------------------------------------------------------

def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), None, rng.choice(["a", "b", "c", "d", None])) for i in range(600)]
    rows += [(900 + i, "w " * 900, None, "big") for i in range(8)] + [(None, None, None, "a"), (None, "", None, "a"), (5, rows[5][1], None, rows[5][3])]
    rows += [(990, "", None, "void")]
    df = docs_of(spark, rows)
    got = mixing.mix_to_weights(df).collect()
    assert len(got) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r, (_, text, _, source) in zip(sorted(got, key=str), rows):
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    by_id = {r.doc_id: r for r in got}
    for i, text, _, source in rows:
        if i is not None and i != 5:
            r = by_id[i]
            size[source] += r.size
            taken[source] += r.taken
            target[source] = r.target
    sources = ["a", "b", "big", "c", "d", "void", None]
    want, capped = {}, set()
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    sizes = {s: sum(len((t or "").split()) for _, t, _, x in rows if x == s) for s in sources}
    weights = {s: k % 3 + 1 for k, s in enumerate(sources)}
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weights[s] for s in sources if s not in capped)
        want = {s: 3 * sizes[s] if s in capped else rest * weights[s] / w for s in sources}
        over = {s for s in sources if want[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in sources:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= (900 if s == "big" else 20)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    times = collections.Counter(r.doc_id for r in mixed.collect() if r.doc_id is not None and r.doc_id != 5)
    assert all(times[i] * by_id[i].size == by_id[i].taken for i in by_id if i is not None and i != 5)
    assert mixing.mix_to_weights(df.limit(0)).count() == 0


# ---- chat ------------------------------------------------------------------

def test_chat_layouts_and_round_trip(spark):
    records = [(1, 0, '{"messages": [{"role": "user", "content": "a ### b"}, {"role": "assistant", "content": "\\\\### </turn> \\\\n"}]}'),
               (2, 0, '{"instruction": "do", "input": null, "output": "done"}'), (2, 1, '{"prompt": "p", "response": ""}'),
               (3, 0, '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}'),
               (4, 0, '{"foo": 1}'), (5, 0, None), (6, 0, "not json"), (7, 0, '{"role": "odd\\nrole###", "content": "x\\\\"}'), (None, 0, '{"prompt": "p", "completion": "c"}')]
    turns = chat.canonical_turns(spark.createDataFrame(records, "conv_id long, seq long, record string").withColumn("piece", F.lit("x")))
    rows = turns.collect()
    said = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.seq, r.part)):
        said[r.conv_id].append((r.role, r.text))
    assert said[2] == [("system", "do"), ("user", ""), ("assistant", "done"), ("user", "p"), ("assistant", "")]
    assert said[3] == [("user", "h"), ("assistant", "g")]
    assert all(said[i] == [(None, None)] for i in (4, 5, 6))
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(turns)).collect()}
    assert set(back) == {1, 2, 3, 7, None}
    for i, r in back.items():
        assert r.n_turns == len(said[i])
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said[i]).encode()).hexdigest()
        loss = "".join(b for a, b in said[i] if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.formatted(turns.limit(0))).count() == 0


def test_turns_are_read_by_marks_alone():
    said = [("user", "a</turn>\n### b\\"), ("assi\nstant", "\\### </turn>"), ("assistant", ""), ("assistant", "\\\\n ###</turn>\n" * 3), ("", "\n")]
    esc = lambda x: __import__("re").sub(r"(\\|###|</turn>)", r"\\\1", x)
    text = "".join("### " + esc(a).replace("\n", "\\n") + "\n" + esc(b) + "</turn>\n" for a, b in said)
    for step in (1, 3, 1000):
        reader = chat.Reader()
        for i in range(0, len(text), step):
            reader.feed(text[i:i + step])
        want = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert reader.result()[:2] == (5, want)
    plain = "### user\na</turn>\n### b</turn>\n"          # a template that escapes nothing is not read as one turn
    reader = chat.Reader()
    reader.feed(plain)
    assert reader.result()[0] == 2


def test_fingerprint_ignores_order_and_list_length():
    a = chat.field_paths({"messages": [{"role": 1, "content": 2}]})
    b = chat.field_paths({"messages": [{"content": 2}, {"role": 1, "content": 3}]})
    assert a == b and chat.fingerprint(a) in chat.MAPPINGS
    assert len(chat.MAPPINGS) == len(chat.LAYOUTS)


# ---- tokens ----------------------------------------------------------------

def odd_texts(n, seed=4):
    rng, letters = random.Random(seed), "abcdefghirstvlme'''    !?.-—éß中文123Σσİ\n\n\t\x1c😀" + "​　"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    return made + ["", " ", "it's we're they'll I'd", "'", "'r", "x'l", "''s", "!'s", "'rex", "<|endoftext|>a<|startoftext|>", "a" * 5000, "a <|endoftext|> b", "don't  stop\n\n\nnow "]


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = odd_texts(3000)
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    df = docs_of(spark, [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[3])])
    got = tokencount.token_counts(df, path, limit=20).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), want[r.doc_id] if r.doc_id is not None else 0)
        assert r.over_limit == (r.n_tokens > 20)
    assert tokencount.token_counts(df.limit(0), path).count() == 0


def test_letters_of_newer_unicode_versions_count_as_the_library_says():
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library, own = Tokenizer.from_file(path), transducer.TokenCounter(path)
    points = [0xA7CB, 0xA7DC, 0x13808, 0x1385C, 0x13988, 0x558, 0x88F, 0x10940, 0x1F600, 0x660]
    texts = [f"{a}{chr(cp)}{b}" for cp in points for a in ("", "a", "1", "!", " ") for b in ("", "b", "2", ".", " x")]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.count_batch(texts) == want


def test_chunk_maps_compose_like_a_run():
    s = transducer.Splitter()
    rng = np.random.default_rng(0)
    classes = rng.integers(0, s.next.shape[1], (9, 7)).astype(np.uint8)
    whole = s.scan(s.chunk_maps(classes))
    for entry in range(s.states):
        state = entry
        for i, row in enumerate(classes):
            for c in row:
                state = s.next[state, c]
            assert whole[i, entry] == state


def test_packing_round_trip(spark):
    texts = odd_texts(400, 8) + ["word " * 4000]
    files = tokenizer_files()
    library = Tokenizer.from_file(files["tokenizer"])
    want = [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]
    df = docs_of(spark, [(i, t) for i, t in enumerate(texts)] + [(None, None), (7, texts[7]), (7, texts[7])])
    rows = packing.pack_documents(df, **files, capacity=64, with_ids=True).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        assert r.length == len(r.ids) <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, ids in enumerate(want):
        got = sorted(pieces[i], key=lambda r: r.piece)[::3 if i == 7 else 1]
        assert [x for r in got for x in r.ids] == ids and all(r.length == 64 for r in got[1:])
        assert [r.start for r in got] == [0, *np.cumsum([r.length for r in got])[:-1]]
    assert [r.ids for r in pieces[None]] == [[2]] and len(pieces[7]) == 3
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1]] and sum(n for _, n in b) <= 64
    assert len(bins) <= 1.02 * math.ceil(sum(r.length for r in rows) / 64) + 1
    assert packing.pack_documents(df.limit(0), **files).count() == 0


def test_local_search_tries_every_pair():
    """A bin of many small documents: no exchange is left that fills another bin more."""
    rng = np.random.default_rng(9)
    sizes = np.concatenate([rng.integers(1, 4, 140), rng.integers(30, 90, 60)]).astype(np.int64)
    bins = packing.local_search(sizes, [list(range(100)), *([i] for i in range(140, 200)), list(range(100, 140))], 256)
    fill = [int(sizes[b].sum()) for b in bins]
    assert sorted(i for b in bins for i in b) == list(range(200)) and max(fill) <= 256
    assert len(bins) == math.ceil(sizes.sum() / 256)


def test_full_pieces_need_no_shard(spark):
    df = spark.range(2_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.lit(5)).otherwise(F.lit(64)).cast("long").alias("length"))
    rows = packing.pack_pieces(df, 64, shard=8).collect()
    full = [r for r in rows if r.length == 64]
    assert len(rows) == 2_000 and len({r.sequence_id for r in full}) == len(full) == 1_980 and all(r.offset == 0 for r in full)
    assert not {r.sequence_id for r in full} & {r.sequence_id for r in rows if r.length < 64}


def test_local_search_empties_bins():
    sizes = np.array([6, 6, 4, 4, 5, 5, 5, 5, 10, 3, 3, 4])
    start = [[0], [1], [2], [3], [4], [5], [6], [7], [8], [9], [10], [11]]
    end = packing.local_search(sizes, start, 10)
    assert sorted(i for b in end for i in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 10 for b in end)
    assert len(end) <= 7 and len(packing.best_fit(sizes, 10)) == math.ceil(sizes.sum() / 10)
    # no document can move; an exchange of 2 for 1 makes room
    end = packing.local_search(np.array([8, 1, 7, 2, 2]), [[0, 1], [2, 3], [4]], 10)
    assert len(end) == 2


# ---- language --------------------------------------------------------------

def test_language_id(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, None, None), (-1, "", "en"), (-2, "123 !!", "fr"), (-3, "the and of", None)], sf.schema)
    df = sf.unionByName(odd).withColumn("best_", F.lit("x")).withColumn("score", F.lit("x"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    got = langid.identify(df, ~held).withColumn("held", held).collect()
    assert len(got) == df.count()
    tested = [r for r in got if r.held and r.lang and r.doc_id >= 0]
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.97
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (None, -1, -2))
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}
    assert langid.identify(odd.limit(0), F.lit(True)).count() == 0


def brute_buckets(text):
    """Buckets of all n-grams of 1 to 3 characters, one by one."""
    m, out = 0x9E3779B1, []
    codes = [ord(c) for c in text.lower()]
    for order in range(1, 4):
        for i in range(len(codes) - order + 1):
            h = codes[i] * m % 2**32
            for c in codes[i + 1:i + order]:
                h = ((h ^ h >> 15) * m + c) % 2**32
            out.append(((h ^ order) * m % 2**32) >> 17)
    return out


def test_language_id_equals_brute_force(spark):
    """Training counts, priors, smoothing and posterior, from the texts alone."""
    rng = random.Random(2)
    vocabulary = {"en": "the of and to", "fr": "le de et à", "de": "der von und zu"}
    rows = [(i, " ".join(rng.choice(vocabulary[k].split()) for _ in range(rng.randint(1, 4))), k, "s") for i in range(60) for k in [rng.choice(sorted(vocabulary))]]
    rows += [(100, "le of zu", None, "s"), (101, "é" * 40_000, "fr", "s"), rows[0], (None, "und", "de", "s")]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    got = langid.identify(docs_of(spark, rows), ~held).select("doc_id", "text", "lang_pred", "score").collect()
    train = [(t, k) for i, t, k, _ in rows if k and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)]
    counts = {k: collections.Counter(b for t, lang in train if lang == k for b in brute_buckets(t)) for k in sorted({k for _, k in train})}
    sizes = collections.Counter(k for _, k in train)
    for r in got:
        s = {k: math.log(sizes[k] / len(train)) + sum(math.log((c[b] + 1) / (sum(c.values()) + langid.BUCKETS)) for b in brute_buckets(r.text)) for k, c in counts.items()}
        best = max(s, key=s.get)
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 / sum(math.exp(v - s[best]) for v in s.values()), rel=1e-6)


def test_language_scores_against_brute_force():
    texts = ["abc", "", "ab ab", "zz"]
    rng = np.random.default_rng(0)
    matrix = np.log(rng.random((3, langid.BUCKETS + 1)))
    got = langid._scores(texts, matrix)
    for t, row in zip(texts, got):
        want = matrix[:, -1].copy()
        for order in range(1, 4):
            for i in range(len(t) - order + 1):
                gram = t[i:i + order]
                bucket = list(langid.hashed_ngrams([gram]))[order - 1][0]
                want += matrix[:, bucket[0]]
        assert np.allclose(row, want)


# ---- quality ---------------------------------------------------------------

def test_only_learned_languages_stay(spark):
    rng = random.Random(5)
    words = {"en": "the of and to in is that for it was on are with his they".split(), "de": "der die und das ist nicht ein zu mit sich auf von dem wird".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 80))), lang, "s") for i in range(900) for lang in [("en", "de")[i % 2]]]
    rows += [(1000, "the that was in", None, "s"), (1001, " ".join(words["de"]), None, "s")]
    junk = [(2000, "мы не знаем почему это так и никто не скажет", None, "s"), (2001, "我们不知道为什么会这样没有人会说", None, "s"),
            (2002, "hogy nem tudjuk miért van így és senki sem mondja meg", None, "s"), (2003, "xqzv kjw pqx zzkv wqj xvk " * 40, None, "s"),
            (2004, "1234 !!", None, "s"), (2005, None, None, "s")]
    df = docs_of(spark, rows + junk)
    kept = langid.in_learned_language(df, F.col("lang").isNotNull(), 0.5)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {r[0] for r in junk}
    assert {1000, 1001} <= ids and len(ids) >= 890
    few = docs_of(spark, rows[:20] + junk)              # too few for a quantile: all that are labelled stay
    assert {r.doc_id for r in langid.in_learned_language(few, F.col("lang").isNotNull(), 0.5).collect()} == {r[0] for r in rows[:20]}


def brute_kneser_ney(train):
    """Log probability of a byte after four, by the textbook recursion."""
    counts = collections.Counter()
    for t in train:
        raw = bytes(4) + t.encode()
        counts.update(raw[i:i + 5] for i in range(len(raw) - 4))
    levels = {5: counts}
    for k in (4, 3, 2, 1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    d = {}
    for k, c in levels.items():
        n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        d[k] = kneser_ney.discounts(*n)

    def p(k, g):
        if k == 0:
            return 1 / 256
        c, g = levels[k], g[-k:]
        after = [v for x, v in c.items() if x[:-1] == g[:-1]]
        rest = p(k - 1, g)
        if not after:
            return rest
        gamma = sum(d[k][min(v, 3)] for v in after) / sum(after)
        return max(c[g] - d[k][min(c[g], 3)], 0) / sum(after) + gamma * rest

    def entropy(t):
        raw = bytes(4) + t.encode()
        return -sum(math.log(p(5, raw[i:i + 5])) for i in range(len(raw) - 4)) / len(t.encode())
    return entropy


def test_quality_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "the", "or", "is", "ö"]) for _ in range(rng.randint(1, 3)))
    good = [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(40)]
    rows = [(i, t, "en" if i % 2 else None, "s") for i, t in enumerate(good)] + [
        (100, "XQZ!! 77 @@", "en", "s"), (101, "", "en", "s"), (102, None, None, "s"), (None, "the or", "zz", "s"), (3, good[3], "en", "s")]
    df = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trusted = F.col("quality") == 1
    got = kneser_ney.classify(df, labels, trusted).collect()
    assert len(got) == len(rows)
    sides = {r.text: r.calibrates for r in kneser_ney.trusted_texts(df, labels, trusted, "doc_id", "text", "lang").collect()}
    texts = {t: brute_smallest_shingle(t) % 4 == 0 for i, t, *_ in rows if i in range(40)}
    assert sides == texts and 0 < sum(sides.values()) < len(sides)
    entropy = brute_kneser_ney([t for t, calibrates in texts.items() if not calibrates])
    for r in got:
        if not r.text:
            assert r.perplexity is None and r.accepted is False
        else:
            assert math.log(r.perplexity) == pytest.approx(entropy(r.text), rel=1e-5)
            assert r.accepted == (r.perplexity <= r.threshold)
    assert not next(r for r in got if r.doc_id == 100).accepted
    none = kneser_ney.classify(df, labels.limit(0), trusted).collect()
    assert all(r.accepted == bool(r.text) and r.threshold is None for r in none)
    assert kneser_ney.classify(df.limit(0), labels, trusted).count() == 0


def test_quality_writes_no_trusted_text(spark, monkeypatch):
    """Each side is read by its only consumer: the two sides are all trusted texts, and the only texts that are written are those in blocks."""
    df = spark.createDataFrame([(i, "en", f"words number {i // 2} of a text that is long enough to have shingles") for i in range(60)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, i < 40) for i in range(60)], "doc_id long, good boolean")
    both = {(r.text, r.calibrates) for r in kneser_ney.trusted_texts(df, labels, "good", "doc_id", "text", "lang").collect()}
    sides = [[(r.text, r.calibrates) for r in kneser_ney.trusted_texts(df, labels, "good", "doc_id", "text", "lang", side).collect()] for side in (False, True)]
    assert sorted(sides[0] + sides[1]) == sorted(both) and len(both) == 20
    assert all(c is side for side, found in zip((False, True), sides) for _, c in found) and all(sides)
    written, real = [], kneser_ney.staged
    monkeypatch.setattr(kneser_ney, "staged", lambda t, name: written.append((name, t.columns)) or real(t, name))
    assert kneser_ney.classify(df, labels, "good").count() == 60
    assert written and not [name for name, columns in written if "text" in columns]


def brute_smallest_shingle(text):
    raw = text.encode().ljust(40, b"\0")
    stir = lambda h, w: (lambda x: x ^ x >> 29)((h ^ w) * 0x9E3779B97F4A7C15 % 2**64)
    out = []
    for i in range(len(raw) - 39):
        h = 7
        for at in range(0, 40, 8):
            h = stir(h, int.from_bytes(raw[i + at:i + at + 8], "little"))
        out.append(stir(h, 40))
    return min(out)


def test_sides_follow_texts_and_not_ids(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(str(rng.randint(0, 9999)) for _ in range(60)) for _ in range(2_000)] + ["é", "short"]
    sides = [kneser_ney.smallest_shingle(t.encode()) for t in texts]
    assert sides[:20] == [brute_smallest_shingle(t) for t in texts[:20]] and sides[-2:] == [brute_smallest_shingle(t) for t in texts[-2:]]
    assert sum(x % 4 == 0 for x in sides) == pytest.approx(500, rel=0.15)
    near = [kneser_ney.smallest_shingle((t + " end").encode()) for t in texts[:500]]
    assert sum(a == b for a, b in zip(near, sides)) > 480
    monkeypatch.setattr(kneser_ney, "PART_BYTES", 16)
    assert [kneser_ney.smallest_shingle(t.encode()) for t in texts[:20]] == sides[:20]


def test_quality_threshold_by_language_and_pooled(spark, monkeypatch):
    # few calibration documents of a language tell no quantile: it takes that of all
    rng = random.Random(8)
    rows = [(i, f"the number {rng.randint(0, 10**9)} is or was here", "en", "s") for i in range(1500)]
    rows += [(2000 + i, f"un deux {i} et encore {rng.randint(0, 10**9)}", "fr", "s") for i in range(40)]
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    run = lambda: kneser_ney.classify(docs_of(spark, rows), labels, F.col("quality") == 1).collect()
    got = run()
    bare = {lang: {round(math.log(r.threshold) - kneser_ney.SPREAD / math.sqrt(len(r.text.encode())), 9) for r in got if r.lang == lang} for lang in ("en", "fr")}
    assert len(bare["en"]) == len(bare["fr"]) == 1 and bare["en"] != bare["fr"]
    value = lambda r: math.log(r.perplexity) - kneser_ney.SPREAD / math.sqrt(len(r.text.encode()))
    held = [r for r in got if brute_smallest_shingle(r.text) % 4 == 0]
    assert bare["fr"].pop() == pytest.approx(np.quantile([value(r) for r in held], kneser_ney.QUANTILE), abs=1e-4)
    assert bare["en"].pop() == pytest.approx(np.quantile([value(r) for r in held if r.lang == "en"], kneser_ney.QUANTILE), abs=1e-4)
    # shards, answering groups and blocks change nothing
    for name, size in (("SHARD_GRAMS", 300), ("GROUP_GRAMS", 100), ("BLOCK_BYTES", 4_000)):
        monkeypatch.setattr(kneser_ney, name, size)
    key = lambda r: (r.doc_id, r.perplexity, r.threshold, r.accepted)
    again = {r.doc_id: key(r) for r in run()}
    assert all(again[r.doc_id] == pytest.approx(key(r), rel=1e-5) for r in got)


def test_copies_change_no_quality_decision(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic")
    times = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("copy")
    many = docs.select("*", times).withColumn("doc_id", F.col("doc_id") + 1_000_000 * F.col("copy"))
    labelled = labels.select("*", times).withColumn("doc_id", F.col("doc_id") + 1_000_000 * F.col("copy"))
    trusted = "quality = 1 and coalesce(toxic, 0) = 0"
    once = {r.doc_id: r.accepted for r in kneser_ney.classify(docs, labels, trusted).collect()}
    four = [(r.doc_id, r.accepted) for r in kneser_ney.classify(many, labelled, trusted).collect()]
    assert len(four) == 4 * len(once)
    assert abs(sum(a for _, a in four) / len(four) - sum(once.values()) / len(once)) < 0.02
    assert sum(once[i % 1_000_000] != a for i, a in four) < 0.02 * len(four)


CLASHING = ("score", "lang_pred", "perplexity", "accepted", "threshold", "lang_", "best_", "lse_", "fit_", "id_", "role_", "mark_", "n_bytes_", "entropy_", "whole", "fit", "best", "lse", "node", "h", "s_")


def test_pipeline_stages_give_back_columns_that_clash(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))
    before = {r.doc_id: r for r in more.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, more, sf)
        assert out.columns == more.columns, name
        rows = out.collect()
        assert rows and all(r == before[r.doc_id] for r in rows), name


# ---- near duplicates -------------------------------------------------------

def components_of(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "CHUNK", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 24))
    x = [base[i % 12] + rng.normal(size=24) * rng.choice([0.0, 0.2, 0.35, 0.5]) for i in range(150)]
    rows = [(i, [float(f) for f in np.float32(v)]) for i, v in enumerate(x)]
    rows += [(200, None), (201, [0.0] * 24), (202, [float("nan")] * 24), (203, [1.0, None]), (204, rows[0][1][:23]), (205, []), (206, [5.0 * f for f in rows[3][1]])]
    df = spark.createDataFrame(rows + [(None, rows[0][1])], "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(df).collect()}
    ok = {i: np.float32(v).astype(np.float64) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in ok for b in ok if a != b and len(ok[a]) == len(ok[b])
             and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= 0.9]
    low = components_of([i for i, _ in rows], links)
    many = collections.Counter(a for a, _ in links)
    assert len(got) == len(rows) + 1 and got[None].n_links == 0 and got[None].kept
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (many[i], low[i], low[i] == i)
    assert neardup_vectors.near_duplicates(df.limit(0)).count() == 0


def brute_sets(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components_of(list(sets), links)


def near_copies(seed=3):
    """Groups of copies with edits around the similarity, a passage that many share, very short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = [word() for _ in range(60)]
    out = []
    for g in range(6):
        base = [word() for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(30):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 30))):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
    out += [" ".join([word() for _ in range(rng.randint(5, 60))] + passage) for _ in range(40)]
    return out + ["a", "A", "a b", "a\tB\n", "A b c d e", "a b c d e f", "word " * 3000, "word " * 2000, "", " \n", "é É e", "É é e"]


def test_jaccard_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup_sets, "HOT_LEVEL", 3)       # split lists and open groups in layers on small data too
    monkeypatch.setattr(neardup_sets, "LAYER", 2)
    monkeypatch.setattr(neardup_sets, "CHUNK", 4)
    texts = near_copies()
    rows = list(enumerate(texts)) + [(900, None)]
    df = docs_of(spark, rows)
    sizes, low = brute_sets(rows)
    found = neardup_sets.similar_documents(df).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for i, _ in rows:
        assert (got[i].n_shingles, got[i].component_id) == (sizes[i], low[i]), (i, texts[i][:80])
    more = df.unionByName(docs_of(spark, [(4, texts[4]), (None, texts[4]), (None, None), (None, "only here and nowhere else at all")]))
    kept = collections.Counter(r.doc_id for r in neardup_sets.one_of_each(more).collect())
    assert kept == collections.Counter([*{low[i] for i, _ in rows}, None, None])
    assert neardup_sets.similar_documents(df.limit(0)).count() == 0


def test_jaccard_of_sets_of_unequal_sizes(spark, monkeypatch):
    """Cut, lengthened and edited copies: links between sizes up to the limit, also of texts that come late in the order."""
    monkeypatch.setattr(neardup_sets, "HOT_LEVEL", 3)
    monkeypatch.setattr(neardup_sets, "LAYER", 2)
    monkeypatch.setattr(neardup_sets, "CHUNK", 4)
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows = []
    for _ in range(5):
        base = [word() for _ in range(rng.choice([30, 90, 150]))]
        for _ in range(40):
            t = base[rng.randint(0, len(base) // 6):len(base) - rng.randint(0, len(base) // 6)] + [word() for _ in range(rng.choice([0, 0, 3, len(base) // 6]))]
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    sizes, low = brute_sets(rows)
    assert 20 < len(set(low.values())) < len(rows) - 20
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup_sets.similar_documents(docs_of(spark, rows)).collect()}
    assert got == {i: (sizes[i], low[i]) for i, _ in rows}


def test_jaccard_texts_that_share_too_little_do_not_meet(spark, monkeypatch):
    """Copies with too many edits, and a passage in texts of many lengths: no links, and no rows for all pairs of them."""
    met, plain = [], neardup_sets.staged

    def counted(df, name, *more):
        out = plain(df, name, *more)
        if name == "jaccard-open-0":
            met.append(out.count())
        return out

    monkeypatch.setattr(neardup_sets, "staged", counted)
    base = [f"b{i}" for i in range(150)]
    far = [[f"x{d}_{i}" if i % 28 == 5 + d % 5 else w for i, w in enumerate(base)] for d in range(60)]      # 6 edits: 0.66 with the text itself
    passage = [f"p{i}" for i in range(124)]
    longer = [passage + [f"y{d}_{i}" for i in range(22 + d % 16)] for d in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(far + longer)]
    sizes, low = brute_sets(rows)
    assert all(low[i] == i for i, _ in rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup_sets.similar_documents(docs_of(spark, rows)).collect()}
    assert got == {i: (sizes[i], low[i]) for i, _ in rows}
    assert len(met) == 1 and met[0] < len(rows), met        # 2,820 when any token of the first quarter counted


def test_staged_tables_reach_python_in_bounded_batches(spark):
    """Long texts are handed to Python a few MB at a time, and the session's setting comes back."""
    from stancelake.llm.common import BATCH_BYTES, staged

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    found = staged(spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("long text "), 1000).alias("t")).mapInArrow(sizes, "rows long, bytes long"), "batches").collect()
    assert sum(r.rows for r in found) == 3000 and max(r.bytes for r in found) < 2 * BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_pipeline_stages_take_texts_in_bounded_batches(spark):
    """A stage's result is written by the caller, whose batches for Python are bounded too."""
    import corpus_pipeline
    from stancelake.llm.common import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit(None).cast("string").alias("lang"))
    try:
        for stage in (corpus_pipeline.language, corpus_pipeline.near_duplicates, corpus_pipeline.packing):
            spark.conf.set(key, "64m")
            stage(spark, docs, "").collect()
            assert int(spark.conf.get(key)) == BATCH_BYTES
    finally:
        spark.conf.set(key, before)
