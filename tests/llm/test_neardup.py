"""Near duplicates against comparing all pairs."""

import random

import numpy as np
import pytest

from cragline.llm import neardup

SCHEMA = "doc_id long, text string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)


def by_all_pairs(rows, width, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def made(seed, n=120):
    """Families of texts with more and more edits, copies, short texts and texts without words."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    rows, k = [], 0
    for _ in range(n // 10):
        base = [word() for _ in range(rng.choice([1, 2, 5, 40, 120]))]
        for e in range(10):
            w = [word() if rng.random() < e * 0.012 else x for x in base]
            rows.append((k, " ".join(w).upper() if e % 2 else "\n".join(w)))
            k += 1
    return [*rows, (k, None), (k + 1, ""), (k + 2, " \t\n"), (k + 3, rows[0][1]), (k + 3, rows[0][1]), (None, rows[20][1]), (None, "nobody else has this text at all")]


@pytest.mark.parametrize("width,seed", [(2, 1), (5, 2)])
def test_components_are_those_of_all_pairs(spark, width, seed):
    rows = made(seed)
    got = neardup.near_duplicates(frame(spark, rows), width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == by_all_pairs(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_hot_group_of_edited_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = [(i, " ".join(f"x{rng.randrange(500)}" if rng.random() < 0.06 else w for w in base)) for i in range(200)]
    got = neardup.near_duplicates(frame(spark, rows), 2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == by_all_pairs(rows, 2)


def test_no_rows(spark):
    assert neardup.near_duplicates(frame(spark, []), 2).count() == 0 and neardup.one_of_each(frame(spark, [])).count() == 0


def test_one_of_each_keeps_rows_without_words(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, None), (4, ""), (5, "other words in here now")]
    got = neardup.one_of_each(frame(spark, rows))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5] and got.columns == ["doc_id", "text", "component_id"]


def test_bounds_miss_no_more_than_asked():
    rng = np.random.default_rng(1)
    equal = rng.random((20000, neardup.BANDS * neardup.ROWS)) < 0.8
    kept = neardup.survivors(np.ones_like(equal, np.uint32), equal.astype(np.uint32), neardup.least_matches(80, 1e-3))
    assert len(kept) >= 0.98 * len(equal)
    none = rng.random((2000, neardup.BANDS * neardup.ROWS)) < 0.4
    assert len(neardup.survivors(np.ones_like(none, np.uint32), none.astype(np.uint32), neardup.least_matches())) == 0


def test_signatures_estimate_similarity():
    by = neardup.multipliers(2000)
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(100, 500))
    same = (neardup.signature(neardup.shingles(a, 1), by) == neardup.signature(neardup.shingles(b, 1), by)).mean()
    assert abs(same - 0.6) < 0.04


def test_components_of_long_paths(spark):
    pairs = [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(60)] + [(b"x", b"y")]
    got = {(bytes(r.node), bytes(r.root)) for r in neardup.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    assert got == {(f"{i:03d}".encode(), b"000") for i in range(61)} | {(b"x", b"x"), (b"y", b"x")}


def test_blocks_are_bounded_and_every_pair_meets_once(spark, monkeypatch):
    """One bucket of very many nodes that are each a component: no group above two blocks, all pairs in some group."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "BLOCK", 512)
    n = 20_000
    members = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.lit(0).alias("band"), F.col("id").cast("string").cast("binary").alias("node"), F.col("id").cast("string").cast("binary").alias("comp"), F.lit(1).cast("long").alias("n"))
    groups = neardup.dealt(members).groupBy("key", "a", "b").agg(F.count("*").alias("rows"), F.sum(F.col("left").cast("int")).alias("l"), F.sum(F.col("right").cast("int")).alias("r")).collect()
    assert max(g.rows for g in groups) < 2 * 640 and 40 * 39 <= len(groups) <= 41 * 41
    assert sum(g.l * g.r for g in groups) == (n - 1) * n  # the largest component, here of one node, is on the right only
    few = members.limit(3000).withColumn("comp", F.when(F.col("node") > F.lit("2").cast("binary"), F.lit(b"major")).otherwise(F.col("comp")))
    sides = neardup.dealt(few).groupBy("minor").agg(F.sum(F.col("left").cast("int")).alias("l"), F.countDistinct("node").alias("n"), F.sum(F.col("right").cast("int")).alias("r")).collect()
    assert {r.minor: r.l > 0 for r in sides} == {True: True, False: False} and sum(r.n for r in sides) == 3000


@pytest.mark.parametrize("block", [3, 7])
def test_small_blocks_give_the_same_components(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = made(11, 60)
    got = neardup.near_duplicates(frame(spark, rows), 2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == by_all_pairs(rows, 2)


def test_clashing_names_pass(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e f"), (2, "A B C D E F"), (3, "")]
    df = frame(spark, rows).select("*", *(F.lit(7).alias(c) for c in ("_key", "_id", "k", "row", "worded", "node")))
    got = neardup.one_of_each(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.k, r.row) for r in got.collect()) == [(1, 7, 7), (3, 7, 7)]
