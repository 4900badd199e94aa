"""N-gram Jaccard join with a token-group matrix.

A document's set holds the hashes of its distinct word shingles.  Pairs at or
above the similarity must share a token among the first |x| - ceil(t |x|) + 1 of
each set in any order that all sets share; rare tokens come first here.

1. Documents are partitioned into groups of similar ones: each token's list of
   documents is hung on its most central one (of the highest mean frequency
   class: the copy with the fewest changes), these pairs are verified, and
   verified links make groups.  A document meets the one it shares most lists
   with first, and others only where that did not make them one group.  A crowd of near copies becomes one group for a few
   pairs per member, not all pairs.
2. A pair's overlap is at most what each set holds from their first shared token
   on, so a token's place in a set bounds the sizes it can link with (``reach``).
   The matrix stores, by token and size class, the groups with a member that
   reaches this class from its own size up; only the first seventh of a set's
   tokens (at 75 %) reach that far.  Each document asks with its own size for
   members no larger than itself.  Texts that share a passage too small for a
   link, however many they are, do not meet.
3. Qualifying groups are opened layer by layer (8 members, then 8 times as many,
   and so on), until a link makes two groups one or all members were compared.
   Links of both steps together give the components.

A pair is passed over only if it cannot link (sizes, parity signatures) or if its
groups are already linked, so components are exact.  Texts travel compressed and
only if they share a first token with another text; equal texts are one document
throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged
from .components import components

WORDS = 5                       # per shingle
PERCENT = 75                    # similarity
BITS = 22                       # of the frequency table: 4 MB, whatever the data
SEGMENT = 2_000_000             # shingles among which repeats are counted
HOT_LEVEL = 12                  # lists of tokens from 2^12 counted repeats on are split
SIZE_STEP = 1.15                # a size class holds sizes up to so many times its least
BITMAP_BITS = 24
MARK_BITS = 1024
CHUNK = 512                     # members, and queries, that one task compares at once
LAYER = 8                       # members of a group that are tried first; then 8 times as many, and so on
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
PLACES = 64
TABLE = np.random.default_rng(5).integers(0, 1 << 64, (PLACES, 256), dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of each word (run of anything but ASCII white space) of a text in UTF-8, A-Z lowered."""
    a = np.frombuffer(raw.lower(), dtype=np.uint8)
    ink = ~WHITE[a]
    first = np.flatnonzero(ink & ~np.concatenate([[False], ink[:-1]]))
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(ink)
    word = np.searchsorted(first, at, side="right") - 1
    place = at - first[word]
    h = TABLE[place % PLACES, a[at]]
    far = place >= PLACES
    if far.any():               # very long words: later stretches are turned by their number
        h[far] = mixed(h[far] + (place[far] // PLACES).astype(np.uint64) * ODD)
    return mixed(np.add.reduceat(h, np.searchsorted(at, first)))


def shingle_set(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Ascending distinct shingle hashes; with fewer words the whole sequence as one; without words none."""
    w = word_hashes(raw)
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = mixed(h * ODD + w[i:i + n])
    return np.unique(h)


def first_tokens(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("node"), "text")


def measure(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, n, signature) of every row, and (bucket, repeats) of tokens repeated within a segment of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = np.zeros(1 << BITS, dtype=np.int64)
        held, seen, size = [], set(), 0

        def note():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c > 1], c[c > 1]
            np.add.at(repeats, (u & np.uint64((1 << BITS) - 1)).astype(np.int64), c)

        for b in batches:
            sizes, marks = [], []
            for node, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                s = shingle_set(text.encode(), words)
                sizes.append(len(s))
                marks.append(signature(s))
                if node not in seen and len(s):
                    seen.add(node)
                    held.append(s)
                    size += len(s)
                if size >= SEGMENT:
                    note()
                    held, seen, size = [], set(), 0
            none = pa.nulls(len(sizes), pa.int64())
            mark = pa.array(marks, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), mark, none, none], names=names)
        if held:
            note()
        at = np.flatnonzero(repeats)
        none = pa.nulls(len(at), pa.int64())
        mark = pa.nulls(len(at), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([none, none, none, mark, pa.array(at), pa.array(repeats[at])], names=names)

    names = ["doc_id", "node", "n", "signature", "bucket", "repeats"]
    return rows.mapInArrow(run, "doc_id long, node long, n long, signature array<long>, bucket long, repeats long")


def signature(s: np.ndarray) -> np.ndarray:
    """Parities of the set's tokens by bucket: where two signatures differ, so do the sets."""
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % MARK_BITS, minlength=MARK_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def levels(measured: DataFrame) -> np.ndarray:
    """Frequency class of each token bucket: the number of binary digits of its repeats; a table of fixed size."""
    sums = measured.filter("bucket is not null").groupBy("bucket").agg(F.sum("repeats").alias("n"))
    rows = sums.select("bucket", (F.floor(F.log2("n")) + 1).cast("int").alias("level")).toArrow()      # at most 2^BITS rows
    out = np.zeros(1 << BITS, dtype=np.uint8)
    out[rows["bucket"].to_numpy()] = rows["level"].to_numpy()
    return out


def token_rows(rows: DataFrame, frequency: np.ndarray, words: int, percent: int) -> DataFrame:
    """(node, central, part, token, place) for the first tokens of every distinct text.

    ``part`` splits the lists of frequent tokens; ``central`` is the mean frequency class of the whole set, in hundredths;
    ``place`` is the number of the set's tokens before this one.  What a text's rows share comes first, as it packs best.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for b in batches:
            nodes, central, parts, tokens, places = [], [], [], [], []
            for node, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if node in seen:
                    continue
                if len(seen) < 1_000_000:       # repeats beyond are dropped after the shuffle
                    seen.add(node)
                s = shingle_set(text.encode(), words)
                if not len(s):
                    continue
                level = table[(s & np.uint64((1 << BITS) - 1)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[:first_tokens(len(s), percent)]      # s ascends, so ties go by hash
                tokens.append(s[order])
                spread = np.left_shift(np.int64(1), np.maximum(level[order].astype(np.int64) - HOT_LEVEL + 1, 0))
                parts.append(np.where(spread > 1, node % spread, -1))
                nodes.append(np.full(len(order), node))
                places.append(np.arange(len(order)))
                central.append(np.full(len(order), 100 * level.sum(dtype=np.int64) // len(s)))
            if tokens:
                cols = [np.concatenate(nodes), np.concatenate(central).astype(np.int16), np.concatenate(parts), np.concatenate(tokens).view(np.int64),
                        np.concatenate(places).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "central", "part", "token", "place"])

    return rows.mapInArrow(run, "node long, central short, part long, token long, place int")


def size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(SIZE_STEP))).cast("int")


def asked_groups(placed: DataFrame, percent: int) -> DataFrame:
    """Distinct (node, n, group, layer, other): the other groups that may hold a text that links with this one and comes before it.

    Texts come by size, equal sizes by group.  ``placed`` holds (token, node, n, reach, group, layer); ``reach`` is the
    largest size of a set that can link if this token is the first of both.
    """
    classes = F.sequence(size_class(F.col("n")), size_class(F.col("reach")))
    matrix = (placed.filter("reach >= n").select("token", F.explode(classes).alias("class"), F.col("group").alias("other"), F.col("n").alias("size"), F.col("reach").alias("most"))
              .groupBy("token", "class", "other").agg(F.min("size").alias("least"), F.max("most").alias("most")))
    asks = placed.withColumn("class", size_class(F.col("n")))
    # some member's size allows it on either side, and comes before
    meet = "group <> other and n <= most and least <= reach and (least < n or (least = n and other < group))"
    return asks.join(matrix, ["token", "class"]).filter(meet).select("node", "n", "group", "layer", "other").distinct()


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed) of the texts whose node may be among ``nodes``: a bitmap of fixed size lets the others stay."""
    bit = F.col("node").bitwiseAND((1 << BITMAP_BITS) - 1)
    words = nodes.select(F.shiftright(bit, 5).alias("word"), F.expr("shiftleft(1L, cast(node & 31 as int))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()              # at most 2^19 rows
    bitmap = np.zeros(1 << (BITMAP_BITS - 5), dtype=np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=3), set()
        for b in batches:
            node = np.asarray(b.column(1))
            at = node & ((1 << BITMAP_BITS) - 1)
            keep = np.flatnonzero((shared.value[at >> 5] >> (at & 31)) & 1)
            keep = [i for i in keep.tolist() if not (node[i] in seen or (len(seen) < 1_000_000 and seen.add(node[i])))]
            if keep:
                b = b.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([pack.compress(t.encode()) for t in b.column(2).to_pylist()], pa.binary())],
                                                 names=["node", "packed"])

    return rows.mapInArrow(run, "node long, packed binary").groupBy("node").agg(F.min("packed").alias("packed"))


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets meet the similarity, exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        known: dict[int, np.ndarray] = {}

        def of(node, packed):
            if node not in known:
                if len(known) > 256:
                    known.clear()
                known[node] = shingle_set(unpack.decompress(packed), words)
            return known[node]

        for batch in batches:
            ok = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                s, t = of(a, x), of(b, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays(keep.columns[:2], names=["a", "b"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = texts.join(ends, "node", "left_semi")
    own = texts.select(F.col("node").alias("b"), F.col("packed").alias("y"))
    other = texts.select(F.col("node").alias("a"), F.col("packed").alias("x"))
    rows = pairs.select("a", "b").join(own, "b").join(other, "a")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles (set size), component_id (smallest id reachable by links), node, chosen.

    ``chosen`` marks the row that stands for its class (rows that repeat it share the mark).

    Two documents link when 100 * intersection >= ``percent`` * union of their
    sets.  A text that is null, empty or without words has an empty set and links
    with nothing.  Repeated rows and equal texts with words link.  A row with a
    null id keeps its row; ids in a component that are null don't count for the
    smallest unless all are.  An empty table gives an empty result; other columns are ignored.
    Tokens are 64-bit hashes, and equal texts are found by a 64-bit hash.
    """
    rows = keyed(docs, id_col, text_col)
    measured = staged(measure(rows, words), "jaccard-sizes")
    tokens = token_rows(rows, levels(measured), words, percent)
    # each list hangs on its most central node, with which near copies link most; lists of one are of no use
    by_list = Window.partitionBy("token", "part")
    lists = (tokens.withColumn("low", F.min("node").over(by_list)).withColumn("high", F.max("node").over(by_list))
             .withColumn("hub", F.max(F.struct("central", "node")).over(by_list).getField("node"))
             .filter("low < high or part >= 0"))
    lists = staged(lists.select("token", "part", "node", "place", "hub"), "jaccard-lists")
    nodes = staged(measured.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"),
                                                               F.first("signature").alias("signature")), "jaccard-nodes")
    # parts of a split list hang on one of their hubs
    heads = lists.filter("part >= 0").select("token", "hub").distinct()
    top = heads.groupBy("token").agg(F.min("hub").alias("a"))
    hung = (lists.select(F.col("hub").alias("a"), F.col("node").alias("b"))
            .unionByName(heads.join(top, "token").select("a", F.col("hub").alias("b")))
            .filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")))
    best = F.max(F.struct("shared", "a")).over(Window.partitionBy("b")).getField("a")
    first = staged(possible(hung, nodes, percent).withColumn("nearest", F.col("a") == best), "jaccard-pairs")
    texts = staged(texts_of(rows, lists.select("node").distinct()), "jaccard-texts")
    links = staged(verified(first.filter("nearest"), texts, words, percent), "jaccard-links")
    group = components(links, "jaccard-groups")
    of_a, of_b = (group.select(F.col("node").alias(c), F.col("component").alias(f"group_{c}")) for c in "ab")
    apart = ~F.coalesce(F.col("group_a") == F.col("group_b"), F.lit(False))
    rest = first.filter("not nearest").join(of_a, "a", "left").join(of_b, "b", "left").filter(apart)
    rest = staged(rest.select("a", "b"), "jaccard-pairs-apart")
    links = group.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(rest, texts, words, percent))
    group = components(links, "jaccard-groups")

    # token-group matrix: a document without links is a group of its own
    members = (lists.select("node").distinct().join(nodes.select("node", "n"), "node").join(group, "node", "left")
               .select("node", "n", F.coalesce("component", "node").alias("group")))
    members = staged(members, "jaccard-members")
    counts = members.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    counts = counts.withColumn("depth", _layer(F.col("members") - 1))
    place = F.floor(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) / (1 << 20) * F.col("members"))
    members = staged(members.join(counts, "group").withColumn("layer", _layer(place)), "jaccard-layers")
    placed = (lists.select("token", "node", "place").join(members.select("node", "n", "group", "layer"), "node")
              .withColumn("reach", F.expr(f"({100 + percent} * (n - place)) div {percent} - n")).drop("place"))
    split = (placed.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.max(F.expr("reach >= n")).alias("reaches"))
             .filter("low < high and reaches").select("token"))
    placed = staged(placed.join(split, "token").distinct(), "jaccard-placed")
    bounds = counts.select(F.col("group").alias("other"), "least_n", "most_n", "depth")
    left = (asked_groups(placed, percent).join(bounds, "other")
            .filter((F.col("most_n") * 100 >= F.col("n") * percent) & (F.col("n") >= F.col("least_n")))
            .select(F.col("node").alias("b"), "n", "group", F.col("layer").alias("layer_b"), "other", F.greatest("layer", "depth").alias("depth")))
    left = staged(left, "jaccard-open-0")
    tried = first.select("a", "b").unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    inside = (members.join(left.select(F.col("other").alias("group")).distinct(), "group", "left_semi")
              .join(nodes.select("node", "signature"), "node")
              .withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / CHUNK))))
    inside = staged(inside.groupBy(F.col("group").alias("other"), F.col("layer").alias("layer_a"), "chunk")
                    .agg(F.collect_list(F.struct("node", "n", "signature")).alias("members")), "jaccard-inside")
    more, layer = [], 0
    while not left.isEmpty():
        # open groups layer by layer: once a member of each of two groups is linked, the groups are one
        asked = left.filter(F.col("layer_b") <= layer)
        many = asked.groupBy("other").agg(F.count(F.lit(1)).alias("queries"))
        asked = (asked.join(many, "other").join(nodes.select(F.col("node").alias("b"), "signature"), "b")
                 .withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("queries") / CHUNK)))
                 .groupBy("other", "layer_b", "part").agg(F.collect_list(F.struct("b", "n", "signature", "group")).alias("queries")))
        opened = (asked.join(inside.filter(F.col("layer_a") <= layer), "other").filter(F.greatest("layer_a", "layer_b") == layer)
                  .select("other", "queries", "members").mapInArrow(_compare(percent), "a long, b long, group long, other long"))
        opened = staged(opened.join(tried, ["a", "b"], "left_anti"), "jaccard-opened")
        more.append(staged(verified(opened, texts, words, percent), "jaccard-more-links"))
        done = opened.join(more[-1], ["a", "b"]).select(F.explode(F.array(F.struct("group", "other"), F.struct(F.col("other").alias("group"), F.col("group").alias("other")))))
        done = done.select("col.*").distinct()
        layer += 1
        left = staged(left.filter(F.col("depth") >= layer).join(done, ["group", "other"], "left_anti"), "jaccard-left")
    known_links = group.select(F.col("node").alias("a"), F.col("component").alias("b"))
    for found in more:
        known_links = known_links.unionByName(found)
    joined = components(known_links, "jaccard-components")

    per_node = nodes.select("node", "low").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per_node = staged(per_node, "jaccard-classes")
    # a group's document: that of the smallest id, null ids last
    best = F.min(F.struct(F.col("low").isNull().alias("last"), "low", "node")).alias("best")
    lowest = per_node.groupBy("component").agg(best)
    known = per_node.join(lowest, "component").select("node", F.col("best.low").alias("component_id"), (F.col("node") == F.col("best.node")).alias("own"))
    everyone = measured.filter("n is not null").select("doc_id", "node", F.col("n").alias("n_shingles"))
    chosen = F.col("own") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    linked = everyone.filter("n_shingles > 0").join(known, "node").select("doc_id", "n_shingles", "component_id", "node", chosen.alias("chosen"))
    alone = everyone.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "node", F.lit(True).alias("chosen"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of ``similar_documents``; rows without words all stay."""
    found = similar_documents(docs, words, percent, id_col, text_col)
    keep = found.filter("chosen and n_shingles > 0").select(F.col("doc_id").alias("id_"), F.col("node").alias("node_")).distinct()
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("whole"), own.alias("own_"), F.xxhash64(text).alias("hash_"), text.rlike(WORD).alias("words_"))
    kept = rows.filter("words_").join(keep, F.col("hash_").eqNullSafe(F.col("node_")) & F.col("own_").eqNullSafe(F.col("id_")))
    once = kept.dropDuplicates(["hash_", "own_"])           # repeated rows; same keys as the join
    return once.select("whole.*").unionByName(rows.filter("not words_").select("whole.*"))


def _compare(percent: int):
    """Queries against members of a group that come before them: (a, b, group, other) of the pairs that sizes and signatures allow; as ``possible``."""
    def columns(rows: pa.Scalar) -> list:
        ids, n, mark, *rest = rows.values.flatten()
        return [np.asarray(ids), np.asarray(n), np.asarray(mark.flatten()).view(np.uint64).reshape(len(ids), -1), *map(np.asarray, rest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for other, queries, members in zip(*batch.columns):
                b, n, mark, group = columns(queries)
                a, size, marks = columns(members)
                found = []
                for i in range(len(b)):
                    apart = np.bitwise_count(marks ^ mark[i]).sum(axis=1, dtype=np.int64)
                    before = size <= n[i] if other.as_py() < group[i] else size < n[i]
                    ok = before & (apart * (100 + percent) <= (size + n[i]) * (100 - percent)) & (size * 100 >= n[i] * percent)
                    found.append(np.flatnonzero(ok))
                at = np.repeat(np.arange(len(b)), [len(f) for f in found])
                to = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
                cols = [a[to], b[at], group[at], np.full(len(at), other.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "group", "other"])
    return run


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and signatures allow: sets at the similarity differ by at most (1 - t) / (1 + t) of their sizes' sum."""
    a, b = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"signature_{c}")) for c in "ab")
    apart = F.aggregate(F.zip_with("signature_a", "signature_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return pairs.join(a, "a").join(b, "b").filter(sizes_allow(F.col("n_a"), F.col("n_b"), percent) & near).select(*pairs.columns)


def _layer(place: Column) -> Column:
    """Layer of a member by its place: below LAYER 0, then one for each power."""
    return F.when(place < LAYER, 0).otherwise(F.floor(F.log(place / LAYER) / F.log(F.lit(LAYER))) + 1).cast("int")
