"""Line dedup by distinct-site spread.

A line that stands in documents of many sites is boilerplate. HyperLogLog sketches of the sites are
built and merged per line hash by aggregation, map-side first, so a line in a third of all documents
costs each task one sketch. Lines whose estimate is close to the threshold get an exact count. Of a
boilerplate line only the first occurrence (least doc_id, then place) stays; all others are removed.

Only DataFrame functions are used. A line is keyed by two 64-bit hashes. Only keys and places are
shuffled; texts move once, to meet the places to remove.

Cases: a null text stays null; an empty one stays empty; a null site counts as no site; null ids come
after all others; rows equal in id and text are one document and are treated alike; lines of fewer
than ``min_words`` words always stay; an empty table gives an empty one; very long texts are cut whole, in time that grows with
their lines; other columns pass by untouched whatever they are called, but for one named like the count, which is replaced; a
document of which no line is left gets an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialise

#: Sites from which on a line is boilerplate, and words from which on a line counts at all.
MIN_SITES, MIN_WORDS = 4, 5
#: Sketches have 2^LG_K registers; estimates within MARGIN of the threshold (a share of it, 1 at least) are counted exactly.
LG_K, MARGIN = 10, 0.15


def words_in(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def numbered_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, k (hash of the text), pos, site, h1, h2 of every line that counts; docs has doc_id, text, site."""
    # the text's hash is made before its lines are, else the whole text would go along with each of them
    parts = docs.where(F.col("text").isNotNull()).select("doc_id", text_key(F.col("text")).alias("k"), "site", F.split("text", "\n").alias("parts"))
    lines = parts.select("doc_id", "k", "site", F.posexplode("parts").alias("pos", "line"))
    return lines.where(words_in(F.col("line")) >= min_words).select("doc_id", "k", "pos", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """h1, h2, first (null flag, doc_id, pos) of lines that stand in at least min_sites sites, written."""
    near = max(1.0, margin * min_sites)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(place).alias("first"), F.count("site").alias("n"))
    guessed = spread.where(F.col("n") >= min_sites).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - near)
    guessed = materialise(guessed, "line-spread")  # as large as the candidates, not the corpus
    close = guessed.where(F.col("sites") < min_sites + near).select("h1", "h2")
    exact = lines.where(F.col("site").isNotNull()).join(close, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("one").alias("exact")).where(F.col("exact") >= min_sites)
    sure = guessed.where(F.col("sites") >= min_sites + near).select("h1", "h2", "first")
    found = materialise(sure.unionByName(guessed.where(F.col("sites") < min_sites + near).join(exact, ["h1", "h2"]).select("h1", "h2", "first")), "boilerplate")
    discard(guessed)
    return found


def remaining(text: Column, gone: Column) -> Column:
    """The lines of text but those at the places gone. The places left are a set difference, so this takes time in proportion to the lines."""
    places = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
    parts = F.struct(F.split(text, "\n").alias("lines"), gone.alias("gone"))
    return F.array_join(let(parts, lambda x: F.transform(places(x), lambda p: F.get(x["lines"], p))), "\n")


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, removed: str = "n_removed") -> DataFrame:
    """docs with the repeats of boilerplate lines cut from text, and how many lines that were."""
    own = docs.select(F.col("doc_id").alias("doc_id"), "text", F.col(site).alias("site"))
    lines = numbered_lines(own, min_words)
    found = boilerplate(lines, min_sites)
    here = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos")
    hits = lines.join(found, ["h1", "h2"]).where(here > F.col("first")).groupBy("doc_id", "k").agg(F.collect_set("pos").alias("gone"))
    names = [c for c in docs.columns if c != removed]
    # the row travels as one column, so that no name of its own can clash
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_key(F.col("text")).alias("k"), F.struct(*names).alias("row")).alias("d")
    joined = rows.join(hits.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.k") == F.col("h.k")), "left").select("row", "gone")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(remaining(F.col("row.text"), F.col("gone")))
    return joined.select(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(removed))


def without_boilerplate(docs: DataFrame, site: str = "source") -> DataFrame:
    """docs with the repeats of boilerplate lines cut from text; documents of which that leaves no word go, others stay."""
    packed = docs.select("doc_id", "text", F.col(site).alias("site"), F.struct("*").alias("row"))
    cut = remove_boilerplate(packed, "site").where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def line_table(docs: DataFrame) -> DataFrame:
    return remove_boilerplate(docs.select("doc_id", "text", "source")).select("doc_id", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, source, CAST(p AS INT) AS pos, parts[p] AS line
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS p FROM docs WHERE text IS NOT NULL)),
counted AS (SELECT * FROM lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 5),
wide AS (SELECT line FROM counted GROUP BY line HAVING count(DISTINCT source) >= 4),
ranked AS (
  SELECT c.doc_id, c.pos, row_number() OVER (PARTITION BY c.line ORDER BY c.doc_id NULLS LAST, c.pos) AS rn
  FROM counted c JOIN wide w ON c.line = w.line),
gone AS (SELECT doc_id, pos FROM ranked WHERE rn > 1),
kept AS (
  SELECT l.doc_id, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS t
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.t, '')) END AS text_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
