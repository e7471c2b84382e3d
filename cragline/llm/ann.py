"""Nearest neighbours by cosine with multiprobe p-stable hashing.

Vectors are scaled to length 1, where the nearest by distance are those of largest cosine. Each of
``TABLES`` tables cuts the line of each of k random projections into slots of one width; the slots are a
vector's bucket. A neighbour's projections differ from the query's by normal deviates of known spread, so the
chance of each bucket around the query is a product of slot chances; buckets are visited in falling order of it
until the tables together reach the wanted chance of success. Distances to aim for come from a bounded
sample; k comes from the number of rows, and is lowered until nearly all of the sample reach that chance within the most
buckets that a query may visit. So vectors without structure get larger buckets, not missed neighbours.

Buckets are dealt to packs, and a pack's members and the queries that visit it are both cut into blocks of bounded size, whatever a
bucket's size; each pair of blocks is one task's group. It gives only its best for each query, by exact cosine, and none below what a
bounded sample already guarantees. These are merged. Of equal vectors only the few
smallest ids are indexed, as no result can hold more; equal queries are searched for once. A query for which the most buckets it
may visit still don't reach the wanted chance visits none; it and any that ends with too few results are compared with all rows,
block by block.

Cases: vectors null, empty, zero, or with null or non-finite components take no part, nor do null ids; rows repeating
an id count once with a query; vectors of another length are no candidates; ties go to the smaller id; with fewer candidates
than asked for, all are returned; an empty table gives an empty result; other columns are not read. Intermediate tables are deleted, the result's own stays
in the session's scratch folder.
"""

from __future__ import annotations

import heapq
from math import ceil, erf, log2, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, checked, discard, materialise, spread_out

TABLES, WIDTH, SUCCESS = 4, 1.0, 0.985
#: Rows in a bucket that k aims at, in a block at most, and in the sample that distances are measured on.
AIM, BLOCK, SAMPLE = 150, 4096, 4000
#: Queries in a block at most, and buckets that they visit there.
ASKED, VISITS = 1024, 200_000
#: Buckets that a query visits in a table at most; k is such that they suffice for this share of a sample of so many vectors.
PROBES, SUFFICE, TRIED = 4000, 0.95, 40


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that no square overflows or vanishes
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rows_of(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """A list column of vectors of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1 if n else width or 0)


class Hashing:
    """Random projections for vectors of one length."""

    def __init__(self, size: int, k: int, seed: int = 17):
        rng = np.random.default_rng([seed, size])
        self.k, self.directions, self.shifts = k, rng.standard_normal((size, TABLES * k)), rng.uniform(0, WIDTH, TABLES * k)
        self.mix = np.random.default_rng([seed, 1]).integers(1, 1 << 62, (TABLES, k)) * 2 + 1

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections in slot widths: (row, table, k)."""
        return ((x @ self.directions + self.shifts) / WIDTH).reshape(len(x), TABLES, self.k)

    def keys(self, slots: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (slots.astype(np.int64) * self.mix[table]).sum(-1)
            return (h ^ (h >> 29)) * np.int64(0x9E3779B97F4A7C1) + table


def slot_chances(place: float, spread: float) -> list[tuple[float, int]]:
    """(chance, slot) of where a neighbour's projection falls, likeliest first."""
    cdf = lambda x: 0.5 * (1 + erf((x - place) / (spread * 2**0.5)))
    first = int(np.floor(place))
    reach = max(1, ceil(3.5 * spread))
    found = [(cdf(s + 1) - cdf(s), s) for s in range(first - reach, first + reach + 1)]
    return sorted(found, key=lambda x: (-x[0], x[1]))


def probes(places: np.ndarray, spread: float, wanted: float) -> tuple[list[tuple[int, ...]], float]:
    """Buckets in falling order of their chance, until it adds up to wanted, and the sum.

    A bucket is a rank in each projection's list of slots. From one that is visited, those with one rank
    more in the last projection that was moved or a later one are reached, so each is reached once.
    """
    options = [slot_chances(p, spread) for p in places]
    start = (0,) * len(options)
    heap, out, total = [(-prod(o[0][0] for o in options), start, 0)], [], 0.0
    while heap and total < wanted and len(out) < PROBES:
        p, ranks, moved = heapq.heappop(heap)
        out.append(tuple(o[i][1] for o, i in zip(options, ranks, strict=True)))
        total -= p
        for j in range(moved, len(ranks)):
            if ranks[j] + 1 < len(options[j]) and options[j][ranks[j] + 1][0] > 0:
                nxt = ranks[:j] + (ranks[j] + 1,) + ranks[j + 1 :]
                heapq.heappush(heap, (p / options[j][ranks[j]][0] * options[j][ranks[j] + 1][0], nxt, j))
    return out, total


def visited(h: Hashing, places: np.ndarray, spread: float, wanted: float) -> np.ndarray | None:
    """Keys of the buckets to visit in all tables; None if those of a table don't reach the wanted chance."""
    out = []
    for t in range(TABLES):
        found, reached = probes(places[t], spread, wanted)
        if reached < wanted:
            return None
        out.append(h.keys(np.array(found), t))
    return np.concatenate(out)


def hashes_for(n: int) -> int:
    """Projections a table, so that buckets hold about AIM rows: a slot tells a little over two bits."""
    return min(10, max(1, round(log2(max(2.0, n / AIM)) / 2.2)))


def affordable(k: int, sample: np.ndarray, spread: float, wanted: float) -> int:
    """The most projections, up to k, at which nearly all of a sample reach the wanted chance within the buckets they may visit."""
    asked = sample[:: max(1, len(sample) // TRIED)][:TRIED]
    while k > 1 and len(asked):
        h, missed = Hashing(sample.shape[1], k), 0
        for place in h.places(asked):
            missed += probes(place[0], spread, wanted)[1] < wanted
            if missed > (1 - SUFFICE) * len(asked):
                break
        else:
            return k
        k -= 1
    return k


def sampled(vectors: DataFrame) -> np.ndarray:
    """Vectors of length 1 of the commonest size in a sample of at most about SAMPLE rows."""
    got = bounded_sample(vectors.select("vec_id", "embedding"), SAMPLE, 23, "vec_id").select("embedding").toArrow().column(0)
    sized: dict[int, list] = {}
    for v in got.to_pylist():
        sized.setdefault(len(v), []).append(v)
    return unit(np.array(max(sized.values(), key=len), float)) if sized else np.zeros((0, 0))


def aimed_distance(x: np.ndarray, top: int) -> float:
    """The distance of the top-th neighbour in the sample, 90th percentile: in all rows it is no larger."""
    if not len(x):
        return 1.0
    q = x[np.lexsort(x.T[:1])][:: max(1, len(x) // 200)]
    d = np.sort(np.sqrt(np.maximum(0, 2 - 2 * q @ x.T)), 1)[:, min(top, len(x) - 1)]
    return max(0.05, float(np.quantile(d, 0.9)))


def best_of(queries: pa.Table, members: pa.Table, top: int) -> pa.Table:
    """The best of a block's members for each query among the buckets it visits: by exact cosine, then by id."""
    names = ["query", "vec_id", "score"]
    nothing = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
    if not queries.num_rows or not members.num_rows:
        return nothing
    order = np.argsort(members["bucket"].to_numpy(), kind="stable")
    m, q = rows_of(members["embedding"])[order], rows_of(queries["embedding"])
    uq, um, ids, bucket = unit(q), unit(m), members["vec_id"].to_numpy()[order], members["bucket"].to_numpy()[order]
    floor, who = queries["floor"].to_numpy(), queries["query"].to_numpy()
    visits = queries["keys"].combine_chunks()
    owner, wanted = np.repeat(np.arange(len(q)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()
    by = np.argsort(wanted, kind="stable")
    owner, wanted, parts = owner[by], wanted[by], []
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(bucket)], strict=True):
        lo, hi = np.searchsorted(wanted, bucket[a], "left"), np.searchsorted(wanted, bucket[a], "right")
        for i in range(lo, hi, 256):
            mine = owner[i : min(hi, i + 256)]
            s = uq[mine] @ um[a:b].T
            least = floor[mine]
            if b - a > top:
                least = np.maximum(least, np.partition(s, -top, 1)[:, -top])
            x, y = np.nonzero(s >= least[:, None] - 1e-9)
            parts.append((mine[x], a + y))
    if not parts:
        return nothing
    x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
    score = cosine(q[x], m[y]) if len(x) else np.zeros(0)
    order = np.lexsort((ids[y], -score, x))
    x, y, score = x[order], y[order], score[order]
    keep = np.arange(len(x)) - np.searchsorted(x, x) < top
    return pa.table([who[x[keep]], ids[y[keep]], score[keep]], names)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, each row summed alike wherever it stands."""
    return np.array([np.dot(x, y) for x, y in zip(a, b, strict=True)]) / (np.sqrt([np.dot(x, x) for x in a]) * np.sqrt([np.dot(y, y) for y in b]))


def merged(parts: DataFrame, top: int) -> DataFrame:
    once = parts.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= top).drop("r")


def meet(visits: DataFrame, members: DataFrame, top: int) -> DataFrame:
    """Best pairs of visits (pack, query, embedding, floor, keys) and members (pack, bucket, vec_id, embedding) of a pack of buckets.

    Both sides of a pack are dealt out in blocks, and each block of one side meets each of the other. Packs nobody visits drop out.
    """
    blocks = members.groupBy("pack").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    askers = visits.groupBy("pack").agg(F.ceil(F.greatest(F.count("*") / ASKED, F.sum(F.size("keys")) / VISITS)).cast("int").alias("askers"))
    counts = materialise(blocks.join(askers.hint("merge"), "pack"), "counts")  # a row a pack
    sizes = checked(counts, counts.count())
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(sizes, "pack").withColumn("askers", dealt("query", "askers")).withColumn("block", each("blocks")).select("pack", "block", "askers", "query", "embedding", "floor", "keys")
    right = members.join(sizes, "pack").withColumn("block", dealt("vec_id", "blocks")).withColumn("askers", each("askers")).select("pack", "block", "askers", "bucket", "vec_id", "embedding")
    run = lambda a, b: best_of(a, b, top)
    found = materialise(merged(left.groupBy("pack", "block", "askers").cogroup(right.groupBy("pack", "block", "askers")).applyInArrow(run, "query long, vec_id long, score double"), top), "found")
    discard(counts)
    return found


def search(vectors: DataFrame, queries: DataFrame, top: int = 5, success: float = SUCCESS) -> DataFrame:
    """query_id, rank, vec_id, score: the top nearest of vectors (vec_id, embedding) to each of queries (vec_id, embedding)."""
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors, queries = clean(vectors), clean(queries)
    n = vectors.count()
    sample = sampled(vectors)
    spread, packs = aimed_distance(sample, top) / WIDTH, max(1, ceil(TABLES * n / BLOCK))
    shared = vectors.sparkSession.sparkContext.broadcast(sample)  # of bounded size
    wanted = 1 - (1 - success) ** (1 / TABLES)
    k = affordable(hashes_for(n), sample, spread, wanted)
    alike = [F.xxhash64("embedding").alias("c1"), F.xxhash64(F.lit(5), "embedding").alias("c2")]
    # of equal vectors the top + 1 smallest ids; Spark limits them before the shuffle
    same = Window.partitionBy("c1", "c2").orderBy("vec_id")
    indexed = materialise(vectors.select("vec_id", "embedding", *alike).dropDuplicates(["vec_id", "c1", "c2"]).withColumn("r", F.row_number().over(same)).where(F.col("r") <= top + 1).select("vec_id", "embedding"), "indexed")
    asked = queries.select("vec_id", "embedding", *alike)
    first = asked.groupBy("c1", "c2").agg(F.min("vec_id").alias("query"))
    wanted_ones = materialise(asked.join(first, ["c1", "c2"]).where(F.col("vec_id") == F.col("query")).select("query", "embedding").dropDuplicates(["query"]), "queries")

    def bucketed(batches):
        known: dict[int, Hashing] = {}
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1)])
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                h = known.setdefault(int(size), Hashing(int(size), k))
                slots = np.floor(h.places(unit(rows_of(part.column(1)))))
                for t in range(TABLES):
                    keys = h.keys(slots[:, t], t) * 4096 + int(size) % 4096
                    yield pa.RecordBatch.from_arrays([pa.array(keys % packs * 4096 + int(size) % 4096), pa.array(keys), part.column(0), part.column(1)], ["pack", "bucket", "vec_id", "embedding"])

    def probing(batches):
        known: dict[int, Hashing] = {}
        for batch in batches:
            out: dict[str, list] = {"pack": [], "at": [], "floor": [], "keys": []}
            for i, v in enumerate(batch.column(1).to_pylist()):
                h = known.setdefault(len(v), Hashing(len(v), k))
                u, here = unit(np.array([v], float)), shared.value
                # the sample is part of the rows: no result is worse than its best
                floor = float(np.sort(here @ u[0])[-top - 1]) - 1e-9 if here.shape[1:] == (len(v),) and len(here) > top else -2.0
                keys = visited(h, h.places(u)[0], spread, wanted)
                if keys is None:  # finds nothing here, so it is compared with all rows
                    continue
                keys = keys * 4096 + len(v) % 4096
                pack = keys % packs * 4096 + len(v) % 4096
                for p in np.unique(pack):
                    out["pack"].append(int(p))
                    out["at"].append(i)
                    out["floor"].append(floor)
                    out["keys"].append(keys[pack == p])
            at = pa.array(out["at"], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out["pack"], pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(out["floor"], pa.float64()), pa.array(out["keys"], pa.list_(pa.int64()))], ["pack", "query", "embedding", "floor", "keys"])

    kind = dict(vectors.dtypes)["embedding"]
    members = indexed.mapInArrow(bucketed, f"pack long, bucket long, vec_id long, embedding {kind}")
    visits = materialise(spread_out(wanted_ones, "query").mapInArrow(probing, f"pack long, query long, embedding {kind}, floor double, keys array<long>"), "visits")
    found = meet(visits, members, top + 1)
    discard(visits)
    # too few: against all rows of the same length, in blocks
    size = F.size("embedding").cast("long")
    enough = found.groupBy("query").agg(F.count("*").alias("m")).where(F.col("m") > top).select("query")
    short = materialise(wanted_ones.join(enough, "query", "left_anti").select(size.alias("pack"), "query", "embedding", F.lit(-2.0).alias("floor"), F.array(size).alias("keys")), "short")
    both, rest = found, None
    if not short.isEmpty():
        rest = meet(short, indexed.select(size.alias("pack"), size.alias("bucket"), "vec_id", "embedding"), top + 1)
        both = merged(found.unionByName(rest), top + 1)
    mine = asked.join(first, ["c1", "c2"]).select(F.col("vec_id").alias("query_id"), "query").distinct()
    out = mine.join(both, "query").where(F.col("vec_id") != F.col("query_id"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    result = materialise(ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"), "neighbours")
    for done in (indexed, wanted_ones, found, short, rest):
        discard(done)
    shared.unpersist()
    return result


def neighbour_table(vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
