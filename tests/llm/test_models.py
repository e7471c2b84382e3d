"""Classifiers: held-out accuracy on the supplied tables, and odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.llm import langid, quality, toxicity
from cragline.llm.common import table
from cragline.llm.lockstep import Lockstep

SF = "/root/testdata/sf0.01"
ODD = [(None, None, None), (1, "", "s"), (2, "12 !?", "s"), (3, "word " * 3000, "s"), (3, "word " * 3000, "s")]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, score string, source string")


def test_quality_on_held_out_rows(spark):
    labels = table(spark, SF, "labels")
    got = quality.quality_table(table(spark, SF, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 40 and (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (1, 0, 0), (1, 1, 1), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_table(odd(spark), labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 3}) == 1
    none = quality.quality_table(odd(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and quality.quality_table(odd(spark, []), labels).count() == 0
    assert quality.score(odd(spark), quality.RuleModel([], 0.0)).columns == ["doc_id", "text", "source", "score"]


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 2] <= 0.5)).astype(float)
    model = quality.fit_rules(list("abcd"), x, y)
    total = np.full(len(x), model.intercept)
    for rule, w in model.rules:
        total += w * np.all([(x[:, "abcd".index(f)] > at) == above for f, above, at in rule], 0)
    assert ((total > 0) == (y > 0)).mean() > 0.97 and len(model.rules) < 120


def test_compiled_columns_are_the_rules_in_numpy(spark):
    """Statistics by plain Python and rules by numpy, against the Spark columns of a fitted model, over all documents."""
    import re
    import unicodedata

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, quality.training_labels(labels, 5, 0))
    assert len(model.rules) > 5
    got = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), model).collect()}

    def plain(t):
        t = t or ""
        words, lines = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w], [x for x in t.split("\n") if x]
        over = lambda a, b: a / b if b > 0 else 0.0
        letters, upper = sum(c.isalpha() for c in t), sum(unicodedata.category(c) == "Lu" for c in t)
        n, d = len(words), len(set(words))
        digits, stops = len(re.findall(r"[0-9]", t)), len(re.findall(r"[.,;:]", t))
        signs = sum(not c.isalpha() and c not in "0123456789.,;:'\"()-" and c not in " \t\n\x0b\f\r" for c in t)
        return {"words": np.log1p(n), "distinct_words": over(d, n), "root_distinct": d / n**0.5 if n else 0.0, "word_length": over(len(t), n), "line_words": over(n, len(lines)), "distinct_lines": over(len(set(lines)), len(lines)),
                "letters": over(letters, len(t)), "upper": over(upper, letters), "digits": over(digits, len(t)), "signs": over(signs, n), "stops": over(stops, n)}

    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        x = plain(r.text)
        total = model.intercept + sum(w for rule, w in model.rules if all((x[f] > at) == above for f, above, at in rule))
        assert abs(1 / (1 + np.exp(-total)) - got[r.doc_id]) < 1e-9, r.doc_id


def test_clashing_names_pass_through_quality(spark):
    df = odd(spark).select("doc_id", "text", *(F.lit(5).alias(c) for c in ("_chars", "_words", "row", "_s_words", "_y")))
    model = quality.RuleModel([((("words", True, 0.5),), 1.0)], 0.0)
    got = quality.score(df, model).collect()
    assert all(r._chars == r._words == r.row == r._s_words == r._y == 5 for r in got) and {round(r.score, 3) for r in got} == {0.5, 0.731}
    assert quality.accepted(df, model, 0.6).columns == df.columns and quality.accepted(df, model, 0.6).count() == 3


def test_training_texts_are_bounded(spark):
    from cragline.llm.common import bounded_texts

    df = spark.createDataFrame([(i, "x" * (10 + i % 7)) for i in range(300)] + [(5, "y" * 5000)] * 40, "doc_id long, text string")
    got = bounded_texts(df, 200, 2000, 1, "doc_id", "text")
    assert got == bounded_texts(df.repartition(5), 200, 2000, 1, "doc_id", "text") and 0 < len(got) <= 200 and sum(len(r.text) for r in got) <= 2000
    assert bounded_texts(df.limit(0), 5, 5, 1, "doc_id") == []


def test_toxicity_on_held_out_rows(spark):
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity.toxicity_table(table(spark, "/root/testdata/sf0.1", "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    hit, wrong = ((got.predicted == 1) & (got.toxic == 1)).sum(), ((got.predicted == 1) & (got.toxic == 0)).sum()
    assert hit >= 0.85 * (got.toxic == 1).sum() and wrong <= 0.05 * hit


def test_toxic_spans():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    plain = [" ".join(word() for _ in range(30)) for _ in range(200)]
    bad = [" ".join([*(word() for _ in range(10)), "vilething", *(word() for _ in range(10))]) for _ in range(60)]
    field = toxicity.fit_documents([(t, False) for t in plain] + [(t, True) for t in bad])
    (score, spans), (low, none), (empty, _) = field.tag(["abcde vilething, jihgf", "abcde jihgf", None])
    assert score > 0.7 > 0.3 > low and empty < 0.3 and not none and [(a, b) for a, b, _ in spans] == [(6, 16)]
    assert all(s < 0.1 for s, _ in toxicity.fit_documents([("a b", False)]).tag(["a b", ""]))


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    field = toxicity.ToxicField({}, 0.0, rng.normal(size=(2, 2)))
    scores, lengths = rng.normal(size=9), np.array([4, 0, 5])
    got, at = field.marginals(scores, lengths), 0
    for n in lengths:
        weight, hit = 0.0, np.zeros(n)
        for path in range(2**n):
            tags = [path >> i & 1 for i in range(n)]
            w = np.exp(sum(scores[at + i] for i in range(n) if tags[i]) + sum(field.steps[a, b] for a, b in zip(tags, tags[1:])))
            weight, hit = weight + w, hit + w * np.array(tags)
        assert n == 0 or np.allclose(got[at : at + n], hit / weight)
        at += n


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_table(odd(spark), labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_table(odd(spark, []), labels.limit(0)).count() == 0


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    got = langid.language_table(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150 and (got.lang_pred == got.lang).mean() > 0.97


@pytest.fixture(scope="module")
def model():
    rows = [("the cat and the dog were here with that thing", "en"), ("der hund und die katze waren nicht mit ihnen hier", "de"), ("и это было очень хорошо для них", "ru")]
    return langid.fit_texts(rows * 30)


def test_spans_of_mixed_text(model):
    text = "the cat and the dog were here with that thing und die katze waren nicht mit ihnen hier и это было"
    _, _, spans = model.label([text])[0]
    assert [s[0] for s in spans] == ["en", "de", "ru"] and spans[0][1] == 0 and spans[-1][2] == len(text)
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_viterbi_is_the_best_path(model):
    rng = np.random.default_rng(4)
    scores, lengths = rng.normal(size=(9, 3)) * 9, np.array([3, 0, 5, 1])
    got, at = model.decode(scores, lengths), 0
    for n in lengths:
        value = lambda p: sum(scores[at + i, k] for i, k in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n) if n else []
        if n:
            assert np.isclose(value(got[at : at + n]), max(value(p) for p in paths))
        at += n


def test_language_of_odd_rows(spark, model):
    assert [r[:2] for r in model.label([None, "", "12 !?", "²½ Ⅷ ①", "__ _ ٣", "ΑΒΓ"])][:5] == [("und", 0.0)] * 5
    got = langid.language_table(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in got} == {"und"} and {r.score for r in got} == {0.0}
    assert langid.label(odd(spark), model).columns == ["doc_id", "text", "source", "lang_pred", "score", "spans"]
    assert langid.label(odd(spark, []), model).count() == 0
    long = "the cat and the dog were here with that thing " * 60_000
    assert langid.label(odd(spark, [(1, long, None)]), model).first().lang_pred == "en"


def test_language_sample_of_repeated_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "fit_texts", list)
    rows = [(i, "one text again and again" if i % 3 == 0 else f"text number {i}", "en") for i in range(3000)]
    got = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100)
    assert 10 < sum(t.startswith("one") for t, _ in got) < 70 and 60 < len(got) <= 200
    tries = spark.range(2000).select(F.concat(F.lit("text "), F.col("id")).alias("text"))
    least = tries.orderBy(F.xxhash64(F.lit(4), "text").bitwiseAND(F.lit((1 << 40) - 1))).first().text
    same = spark.createDataFrame([(None, least, "en")] * 2000, "doc_id long, text string, lang string")
    assert len(langid.fit(same, 100)) == 200


def test_lockstep_keeps_order():
    lay = Lockstep(np.array([2, 0, 3]))
    assert lay.pack(np.array([10, 11, 30, 31, 32])).tolist() == [30, 10, 31, 11, 32] and lay.active.tolist() == [2, 2, 1]
