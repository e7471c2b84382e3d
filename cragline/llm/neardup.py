"""Near-duplicate documents by MinHash, with sequential Bayesian verification.

1. Every document's set of word shingles gets a signature of BANDS * ROWS minima. Documents with equal
   sets form one node, so copies cost one row each and are never paired.
2. Signatures are cut into bands; nodes that share a band meet in a bucket. In each bucket all nodes
   are paired with one pivot (first the node with the most copies, then one by another order), and
   only if no link has joined them yet: the pairs stay in proportion to the nodes.
3. What is still apart in a bucket is then compared completely: all nodes outside the bucket's largest
   component against all nodes, in pairs of blocks of bounded size on either side, without writing out the pairs. First
   signatures alone name the nodes that have a surviving pair; then their full sets meet, each pair in the first
   band it shares, and a pair of blocks gives only such links as join components: fewer than it has nodes.
4. Each comparison reads the signatures batch by batch. With a uniform prior the similarity's posterior
   after m equal values of n is a Beta; a pair is dropped as soon as the chance that it reaches the
   threshold falls below ``miss``. Survivors are verified on their full sets.
5. Links become components by alternating large-star and small-star steps, each written to the shared
   folder.

Cases: null texts and texts without words have an empty set and are linked with nothing; a text with
fewer words than a shingle has its whole word sequence as one; rows equal in id and text are kept or
dropped alike; a null id takes no part in a component's smallest id, and a component in which all ids are
null keeps its rows with a null component_id; ties go to the smaller id; an empty table gives an
empty one; of other columns only doc_id and text are read, and ``one_of_each`` hands all of them on whatever they are called;
very long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, discard, materialise, slices

BANDS, ROWS = 32, 5
#: Values compared at a time, and the chance with which a pair at the threshold may be dropped.
STEP, MISS = 32, 1e-5
#: Words a worker remembers; nodes in a block.
MEMORY_WORDS, BLOCK = 200_000, 2048
#: Hashes in all sets of a block.
BLOCK_ITEMS = 2_000_000
#: Similarity of a link, in hundredths; words of a shingle.
PERCENT, WORDS = 80, 2


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMORY_WORDS:
            self[word] = h
        return h


_words = WordHashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(mixed(out + np.uint64(width)))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each value scrambled so that every bit depends on all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least value under each multiplication, upper half."""
    low = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 512):
        np.minimum(low, (by[:, None] * values[None, i : i + 512]).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def least_matches(percent: int = PERCENT, miss: float = MISS, size: int = BANDS * ROWS, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped) after each batch.

    After m matches of n the posterior is Beta(m + 1, n - m + 1); its mass above t is the chance of at
    most m heads in n + 1 throws of a coin with t.
    """
    t, out = percent / 100, []
    for n in [*range(step, size, step), size]:
        chance, m = 0.0, -1
        while (chance := chance + comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)) < miss:
            m += 1
        out.append((n, m + 1))
    return out


def survivors(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of a and b (signatures) that no batch drops."""
    at, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in bounds:
        matches = matches + (a[at, done:n] == b[at, done:n]).sum(1)
        at, matches, done = at[matches >= least], matches[matches >= least], n
    return at


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, k (hash of the text), n (set size), node (digest of the set; null if empty), sig."""
    by = multipliers(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                n, node, sig = [], [], []
                for t in texts:
                    s = shingles(t, width)
                    n.append(len(s))
                    node.append(hashlib.blake2b(s.tobytes(), digest_size=12).digest() if len(s) else None)
                    sig.append(signature(s, by).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "k", "n", "node", "sig"])
        _words.clear()  # a worker that waits for other tasks holds none

    return docs.select("doc_id", "text", text_key().alias("k")).mapInArrow(run, "doc_id long, k long, n long, node binary, sig binary")


def text_key() -> Column:
    return F.xxhash64("text", F.length("text"))


def bands(nodes: DataFrame) -> DataFrame:
    keys = [F.xxhash64(F.lit(b), F.substring("sig", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)]
    return nodes.select("node", "copies", "n", F.posexplode(F.array(*keys)).alias("band", "key"))


def similar(pairs: DataFrame, nodes: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """The pairs (a, b) whose signatures pass."""
    sig = nodes.select("node", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select(["a", "b"]).take(pa.array(survivors(a, b, bounds)))

    return both.mapInArrow(run, "a binary, b binary")


def full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node, items (the sorted set) of the nodes in wanted, written. Only their texts reach Python."""
    needed = materialise(wanted.distinct().join(nodes, "node").select("node", F.col("doc_id").alias("_id"), F.col("k").alias("_k")), "needed")
    own = docs.select("doc_id", "text", text_key().alias("k"))
    texts = own.join(checked(needed, needed.count()), own.doc_id.eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, width).view(np.int64) for t in found], pa.list_(pa.int64()))], ["node", "items"])
        _words.clear()

    sets = materialise(texts.mapInArrow(run, "node binary, items array<long>").dropDuplicates(["node"]), "sets")
    discard(needed)
    return sets


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs, width)
    joined = pairs.join(sets.toDF("b", "items_b"), "b").join(sets.toDF("a", "items_a"), "a")
    common = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    links = joined.withColumn("common", common).where(F.col("common") * 100 >= F.lit(percent) * (F.size("items_a") + F.size("items_b") - F.col("common"))).select("a", "b")
    links = materialise(links, "links")
    discard(sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for all nodes in links (a, b), written."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        # large star: larger neighbours meet a node's smallest neighbour, or itself
        near = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges_l = near.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours, and the node, meet the smallest of them
        down = edges_l.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        after = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v")).where("u <> v").distinct()
        after = materialise(after, "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if now == state:
            out = materialise(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct()), "components")
            discard(edges)
            return out
        state = now


def paired_with_pivot(members: DataFrame, order: Column) -> DataFrame:
    """(a, b): each bucket's first node by order, and its nodes of other components."""
    pivots = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "comp")).alias("p"))
    return members.join(pivots, "key").where(F.col("comp") != F.col("p.comp")).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def compared(group: pd.DataFrame, bounds: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows whose signatures it survives against) for the nodes on the left side of a pair of blocks.

    Of two nodes that are both outside the largest component the smaller one looks for the other. A pair is left to the first
    band it shares.
    """
    sig = np.frombuffer(b"".join(group.sig), np.uint32).reshape(len(group), -1)
    comp, band, rank = pd.factorize(group.comp)[0], int(group.band.iloc[0]), group.node.rank(method="dense").to_numpy()
    minor, right = group.minor.to_numpy(), np.flatnonzero(group.right)
    for i in np.flatnonzero(group.left):
        against = right[(comp[right] != comp[i]) & (~minor[right] | (rank[right] > rank[i]))]
        against = against[survivors(np.broadcast_to(sig[i], (len(against), sig.shape[1])), sig[against], bounds)]
        shared = (sig[i] == sig[against]).reshape(len(against), BANDS, ROWS).all(2)
        yield i, against[shared.argmax(1) == band]


def dealt(members: DataFrame) -> DataFrame:
    """key, a, b, band, node, comp, minor, left, right: the nodes of each bucket in more than one component, in pairs (a, b) of blocks.

    On the left are a bucket's nodes outside its largest component (``minor``), on the right all its nodes; either side is cut
    into blocks of bounded size, and each block of one meets each of the other. A node on both sides of a pair is one row. Buckets
    of two nodes were done with the pivot.
    """
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("nodes"), F.sum("n").alias("items"))
    sums = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("nodes").alias("nodes"), F.sum("items").alias("items"), F.max(F.struct("nodes", "comp", "items")).alias("major")).where("parts > 1 AND nodes > 2")
    blocks = lambda nodes, items: F.ceil(F.greatest(nodes / BLOCK, items / BLOCK_ITEMS)).cast("int")
    major = F.col("major")
    buckets = sums.select("key", major["comp"].alias("major"), blocks(F.col("nodes") - major["nodes"], F.col("items") - major["items"]).alias("n_left"), blocks(F.col("nodes"), F.col("items")).alias("n_right"))
    rows = members.join(buckets, "key").withColumn("minor", F.col("comp") != F.col("major"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda a, b, left, right: F.struct(a.alias("a"), b.alias("b"), left.alias("left"), right.alias("right"))
    yes, no = F.lit(True), F.lit(False)
    on_left = F.transform(F.filter(each("n_right"), lambda j: F.col("minor")), lambda j: place(own("n_left"), j, yes, j == own("n_right")))
    on_right = F.transform(F.filter(each("n_left"), lambda i: ~F.col("minor") | (i != own("n_left"))), lambda i: place(i, own("n_right"), no, yes))
    return rows.select("key", "band", "node", "comp", "minor", F.explode(F.concat(on_left, on_right)).alias("at")).select("key", "at.a", "at.b", "band", "node", "comp", "minor", "at.left", "at.right")


def still_apart(members: DataFrame, nodes: DataFrame, docs: DataFrame, bounds: list[tuple[int, int]], width: int, percent: int) -> DataFrame:
    """(a, b): links between nodes of a bucket that no link joins yet."""
    rows = dealt(members).join(nodes.select("node", "sig"), "node")

    def take_part(group: pd.DataFrame) -> pd.DataFrame:
        wanted = np.zeros(len(group), bool)
        for i, found in compared(group, bounds):
            wanted[found] = True
            wanted[i] |= len(found) > 0
        return group[wanted]

    kept = "key long, a int, b int, band int, node binary, comp binary, minor boolean, left boolean, right boolean, sig binary"
    rows = materialise(rows.select("key", "a", "b", "band", "node", "comp", "minor", "left", "right", "sig").groupBy("key", "a", "b").applyInPandas(take_part, kept), "apart")
    sets = full_sets(rows.select("node"), nodes, docs, width)

    def link(group: pd.DataFrame) -> pd.DataFrame:
        items, names, root = group["items"].to_numpy(), group.node.to_numpy(), pd.factorize(group.comp)[0]
        out = []
        for i, found in compared(group, bounds):
            for j in found:
                if root[i] != root[j]:
                    least, most = sorted((len(items[i]), len(items[j])))
                    if 100 * least >= percent * most:
                        common = len(np.intersect1d(items[i], items[j], assume_unique=True))
                        if 100 * common >= percent * (least + most - common):
                            root[root == root[j]] = root[i]
                            out.append((min(names[i], names[j]), max(names[i], names[j])))
        return pd.DataFrame(out, columns=["a", "b"])

    links = materialise(rows.join(sets, "node").groupBy("key", "a", "b").applyInPandas(link, "a binary, b binary").distinct(), "links")
    discard(rows)
    discard(sets)
    return links


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """doc_id, k (hash of the text), n_shingles, component_id, kept (component_id is doc_id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = least_matches(percent, miss)
    rows = materialise(signed(docs, width), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k"))
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("copies"), F.max("n").alias("n"), first.alias("at"), F.first("sig").alias("sig"))
    nodes = materialise(nodes.select("node", "copies", "n", "at.doc_id", "at.k", "sig"), "nodes")
    own = bands(nodes)
    shared = own.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = materialise(own.join(shared, "key"), "members")
    links: list[DataFrame] = []
    comps = None
    for order in (-F.col("copies"), F.xxhash64("node"), None):
        if comps is None:
            at = members.withColumn("comp", F.col("node"))
        else:
            at = members.join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        if order is None:
            links.append(still_apart(at, nodes, docs, bounds, width, percent))
        else:
            pairs = materialise(similar(paired_with_pivot(at, order), nodes, bounds), "pairs")
            links.append(verified(pairs, nodes, docs, width, percent))
            discard(pairs)
        before, comps = comps, components(reduce(DataFrame.union, links))
        discard(before)
    for done in [*links, members]:
        discard(done)
    named = nodes.select("node", "doc_id").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_node = named.join(least, "root").select("node", "component_id")
    out = rows.select("doc_id", "k", "n", "node").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = materialise(out.select("doc_id", "k", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")), "near-duplicates")
    for done in (rows, nodes, comps):
        discard(done)
    return found


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("k")


def one_of_each(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """docs without all but one row of each component of two rows or more; rows without words stay. Links are those of ``near_duplicates``."""
    found = near_duplicates(docs, width)
    stay = found.where(F.col("kept") & (F.col("n_shingles") > 0)).dropDuplicates(["doc_id", "component_id"]).select("doc_id", "k")
    # the row travels as one column, so that no name of its own can clash
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("k"), F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("worded"), F.struct("*").alias("row"))
    own = keyed.where("worded").alias("d").join(stay.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.k") == F.col("s.k")), "left_semi").dropDuplicates(["doc_id", "k"])
    return own.select("row").union(keyed.where("NOT worded").select("row")).select("row.*")


#: Links by counting common shingles, components by walking links; for small tables.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT a, a FROM sides UNION SELECT reach.doc_id, sides.b FROM reach JOIN sides ON reach.r = sides.a),
least_one AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.r, s.doc_id) AS component_id,
       s.doc_id = coalesce(l.r, s.doc_id) AS kept
FROM sets s LEFT JOIN least_one l ON s.doc_id = l.doc_id
"""
