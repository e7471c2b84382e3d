"""The stages one after another, each against a plain version."""

import os
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cragline.llm import mixing, quality
from cragline.llm.common import crc_mod, shared_folder, table
from cragline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def words(t):
    return (t or "").encode().split()


def boilerplate_lines(rows):
    """Lines of five words and more in four sources and more, with the place of their first occurrence."""
    sites, first = {}, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        for i, line in enumerate((r.text or "").split("\n")):
            if len(words(line)) >= 5:
                sites.setdefault(line, set()).add(r.source)
                first.setdefault(line, (r.doc_id, i))
    return {line: first[line] for line, s in sites.items() if len(s - {None}) >= 4}


def one_of_each(rows):
    """Ids left by comparing all pairs of sets of two-word shingles."""
    sets = {}
    for r in rows:
        w = [x.lower() for x in words(r.text)]
        sets[r.doc_id] = {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in ids if find(i) == i or not sets[i]}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line dedup", "near duplicates", "mixing", "bpe"]
    given, made = {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given[name] = docs.collect()
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns
        made[name] = docs.collect()
    scores = {r.doc_id: r.score for r in quality.quality_table(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert sorted(r.doc_id for r in made["quality"]) == sorted(r.doc_id for r in given["quality"] if scores[r.doc_id] >= quality.CUT)
    found = boilerplate_lines(given["line dedup"])
    left = {}
    for r in given["line dedup"]:
        kept = [x for i, x in enumerate((r.text or "").split("\n")) if found.get(x, (r.doc_id, i)) == (r.doc_id, i)]
        if "\n".join(kept) == (r.text or "") or words("\n".join(kept)):
            left[r.doc_id] = "\n".join(kept) if r.text is not None else None
    assert {r.doc_id: r.text for r in made["line dedup"]} == left
    assert {r.doc_id for r in made["near duplicates"]} == one_of_each(given["near duplicates"])
    copies = Counter(r.doc_id for r in made["mixing"])
    asked = mixing.rates(spark.createDataFrame(given["mixing"], docs.schema)).collect()
    totals = Counter()
    for r in given["mixing"]:
        totals[r.source] += len(words(r.text))
    assert {r.doc_id: r.copies for r in asked if r.copies} == dict(copies) and all(r.source_size == totals[r.source] and int(r.rate) <= r.copies <= int(r.rate) + 1 for r in asked)
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == docs.count() and all(r.ids == theirs.encode(texts[r.doc_id] or "").ids for r in out)


def test_stages_hand_on_columns_of_any_name(spark):
    clash = [F.lit(3).alias(c) for c in ("_score", "_removed", "_key", "k", "row", "size", "target", "ids")]
    docs = table(spark, SF, "documents").select("*", *clash)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.columns[-8:] == ["_score", "_removed", "_key", "k", "row", "size", "target", "ids"]
    assert all(r.size == r.k == r.row == r._score == 3 for r in docs.limit(20).collect())


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_odd_rows(spark, stage):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f g h", "en", None, 9), (2, "a b c d e f g h", "en", None, 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    # the classifier may reject any of these; the other stages have no reason to drop them all
    assert (0 if stage[0] == "quality" else 1) <= stage[1](spark, spark.createDataFrame(rows, schema), SF).count() <= 8
    assert stage[1](spark, spark.createDataFrame([], schema), SF).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_folds_and_shared_folder(spark):
    import zlib

    got = spark.range(50).select("id", crc_mod(F.col("id"), 5).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 5 for r in got)
    assert shared_folder(spark) == shared_folder(spark)
