"""Conversation prefix trie against a brute-force trie of tuples."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancelake.llm.prefix_trie import SlotTable, prefix_trie, turn_digests
from stancelake.llm.queries import QUERIES

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def sort_key(turn, role, text):
    d = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return (turn is not None, turn or 0, int(d[:15], 16), int(d[15:30], 16))


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((sort_key(turn, role or "", text or ""), (role or "", text or "")))
    convs = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    members, ended = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        path = tuple(convs.get(base, [])[:h] + own[h:])
        ended.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        ks = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in ks) if ks else 1
        saved[p] = sum(saved[k] for k in ks) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, cs in members.items():
        ids = ",".join(map(str, sorted(ended.get(p, []))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


def made(n, seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-20, 3 * n), n):
        for t in range(rnd.choice([0, 1, 3, 8, 12])):
            rows.append((c, rnd.choice([t, t, t, None, 2]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a", "é", "", None, "long " * 50])))
    for c in range(10_000, 10_040):                 # a group of copies with one long member
        rows += [(c, t, "user", "same") for t in range(60 if c == 10_000 else 9)]
    rows += [(None, 0, "user", "nobody"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("unit_rows,shard_nodes", [(1 << 18, 1 << 17), (20, 8), (3, 2)])
def test_trie_equals_brute_force(spark, unit_rows, shard_nodes):
    rows = made(40, 3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("d1", F.lit(1)).repartition(7)
    if unit_rows == 3:
        rows = [r for r in rows if r[0] is None or r[0] < 12]
        df = df.filter("conv_id is null or conv_id < 12")
    assert got(prefix_trie(df, unit_rows=unit_rows, shard_nodes=shard_nodes)) == brute(rows)


def test_a_conversation_over_many_chunks(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(3_000)] + [(7, t, "user", f"t{t % 7}") for t in range(3_000)] + [(8, 0, None, None)]
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), unit_rows=700)) == brute(rows)


def test_empty_table_and_turnless_conversation(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(prefix_trie(empty)) == []
    assert got(prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []
    rows = [(c, 0, "user", "x") for c in (4, 9, 14, 19)]        # no base: what their first h holds is gone
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_very_long_text_counts_its_bytes(spark):
    rows = [(c, t, "user", "é" * 300_000 if t == 9 else "x") for c in (0, 5, 10) for t in range(10)]
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_slot_table_is_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(-2**62, 2**62, 5_000), rng.integers(0, 3, 5_000)
    t = SlotTable(k1, k2)
    assert sorted(t.slots(k1, k2)) == list(range(5_000))
    assert (t.slots(k1, k2 + 3) == -1).all()
    assert len(SlotTable(k1[:0], k2[:0]).slots(k1[:2], k2[:2])) == 2


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_prefix_trie"](spark, sf)) == brute(rows)


def test_digests_tell_role_from_text(spark):
    df = spark.createDataFrame([(1, 0, "ab", "c"), (1, 1, "a", "bc")], SCHEMA)
    assert turn_digests(df).select("t1", "t2").distinct().count() == 2
