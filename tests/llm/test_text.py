"""Encoding, lines, mixing: exact comparisons and odd cases."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cragline.llm import bpe, lines, mixing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(bpe.load_vocabulary(PATH))


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab theT's\n\t\u0085  12é漢😀.,!<|>")), max_size=40))
def test_encoding_is_the_librarys(own, theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "a" * 50_000, "x<|endoftext|>y <|endoftext|>", "a  b \n c", " a", "the end\n"])
def test_encoding_of_odd_texts(own, theirs, text):
    assert own.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_texts_are_cut_only_where_pieces_begin(own, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "PART_CHARS", 5)
    for text in ["it's  a \n line of 12 words,  and\u3000more ", "nospaceatallinthistext", "a b c d e f g  h", "one two\x1c three\u0085 four   "]:
        assert "".join(bpe.parts(text)) == text
        assert own.encode(text) == theirs.encode(text, add_special_tokens=False).ids
    assert len(list(bpe.parts("one two three four five"))) > 1


def test_encode_frames(spark, theirs):
    df = docs(spark, (1, "hello world", "a"), (1, "hello world", "a"), (None, None, None), (2, "", "b")).withColumnRenamed("lang", "ids")
    got = {(r.doc_id, tuple(r.ids)) for r in bpe.encode(df, PATH).collect()}
    assert got == {(1, tuple(theirs.encode("hello world").ids)), (None, ()), (2, ())}
    row = bpe.encode_digests(docs(spark, (2, None, None)), PATH).first()
    assert row.n_tokens == 0 and row.ids_sha256 == row.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_digests(docs(spark), PATH).count() == 0


def test_encoding_of_all_documents_is_the_librarys(spark, theirs):
    """The query on every whole text of a table, against the library."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in bpe.encode_digests(table, PATH).collect()}
    rows = table.collect()
    assert len(rows) == len(got)
    digest = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
    for r in rows:
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        one = got[r.doc_id]
        assert (one.n_tokens, one.ids_sha256, one.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(theirs.decode(ids, skip_special_tokens=False))), r.doc_id


LONG = "one two three four five six"


def test_lines_of_long_texts_and_clashing_names(spark):
    """A text of two hundred thousand lines, most of which go, and columns with the names that the operator uses inside."""
    line = "this line stands in many sites at once"
    rows = [(i, f"{line}\nown line {i}", f"s{i}") for i in range(4)] + [(9, "\n".join([line, "kept"] * 100_000), "s9")]
    clash = [F.lit(1).alias(c) for c in ("_gone", "_id", "_k", "_key", "k", "gone", "row", "pos", "site", "h1", "n_removed")]
    df = docs(spark, *rows).select("doc_id", "text", "source", *clash)
    got = {r.doc_id: r for r in lines.remove_boilerplate(df).collect()}
    assert got[9].n_removed == 100_000 and got[9].text == "\n".join(["kept"] * 100_000) and got[0].text == rows[0][1]
    assert all(r._gone == r._id == r._key == r.k == r.row == r.site == 1 for r in got.values())
    assert lines.without_boilerplate(df).columns == df.columns and mixing.mix(df).columns == df.columns
    sizes = docs(spark, *rows).select("doc_id", "text", "source", *(F.lit(7).alias(c) for c in (*mixing.ADDED, "row", "_draw")))
    assert all(r.size == r.target == r.taken == r.row == 7 for r in mixing.mix(sizes).collect())


def test_boilerplate_lines(spark):
    rows = [(i, f"own words number {i} in this line\n{LONG}", f"s{i}") for i in range(5)] + [(9, f"{LONG}\n{LONG}", None), (None, LONG, "s9"), (7, None, "s1"), (8, "", "s1")]
    rows += [(20 + i, "short line\nonly two sites have this line", f"s{i % 2}") for i in range(6)]
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.remove_boilerplate(docs(spark, *rows)).collect()}
    assert got[0] == (0, rows[0][1])  # the first occurrence stays
    assert all(got[i] == (1, f"own words number {i} in this line") for i in range(1, 5))
    assert got[9] == (2, "") and got[None] == (1, "") and got[7] == (0, None) and got[8] == (0, "")
    assert all(got[20 + i][0] == 0 for i in range(6))
    assert lines.remove_boilerplate(docs(spark)).count() == 0


def test_line_counts_near_the_threshold_are_exact(spark):
    rows = [(100 * k + i, f"line that stands in {k} different sites", f"site {i}") for k in range(1, 9) for i in range(k)]
    got = lines.remove_boilerplate(docs(spark, *rows)).collect()
    assert {r.doc_id // 100 for r in got if r.n_removed} == {4, 5, 6, 7, 8}


def water_level(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """Targets by sharing again and again, as a plain loop."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while free:
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        free -= over
    return target


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text("abé", min_size=1, max_size=2)), st.integers(0, 50), min_size=1, max_size=7))
def test_targets_are_the_loops(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = water_level(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i % 17), f"s{i % 3}" if i % 5 else None) for i in range(3000)]
    df = docs(spark, *rows)
    a = mixing.mixing_table(df).collect()
    taken, target = {}, {}
    for r in a:
        assert r.taken <= 2 * r.size
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] for s in target)
    assert sorted(a) == sorted(mixing.mixing_table(df.repartition(7)).collect())
    assert mixing.mix(df).count() == sum(r.taken // r.size for r in a) and mixing.mix(df).columns == df.columns


def test_mix_of_odd_rows(spark):
    got = {r.doc_id: (r.size, r.taken) for r in mixing.mixing_table(docs(spark, (1, None, "a"), (2, "", None), (None, " \t", "b"))).collect()}
    assert got == {1: (0, 0), 2: (0, 0), None: (0, 0)}
    assert mixing.mixing_table(docs(spark)).count() == 0
    clash = docs(spark, (1, "a b", "s")).withColumnRenamed("lang", "target")
    assert mixing.rates(clash).first().size == 2
