"""Languages of text, word by word.

The script of a word's letters, by ranges of code points, narrows the languages to those that were
seen to use it. Each candidate gets the word's log likelihood by letter trigrams. Viterbi decoding with a
penalty for each switch joins words to spans of one language; a document's language is the one whose
spans hold most letters, its score their share.

Training reads, for each language, about ``BOUND`` whole documents, chosen by hash of id and text, never over twice as many, and no
more than ``CHARS`` characters together.

Cases: null texts and texts without letters get ``und``, score 0 and no spans; words without letters go
with the words around them; a script that no learned language uses leaves all of them as candidates;
ties go to the language first in code point order; without training rows all texts get ``und``; null
languages are not learned from; very long texts are decoded whole; extra columns pass by, those named
like the ones added are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_texts, checked, crc_mod, drawn, slices
from .lockstep import Lockstep, Remembered

#: Documents to learn from, a language; characters in all of them together.
BOUND, CHARS = 700, 40_000_000
#: Log likelihood that a change of language costs; the most that one word may tell against a language.
SWITCH, CLIP = 12.0, 6.0
UNKNOWN = "und"

#: First and last code points of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}

def script_of(word: str) -> str | None:
    """The script of a word's first letter that is in a known range."""
    for c in word:
        o = ord(c)
        for name, ranges in SCRIPTS.items():
            if any(a <= o <= b for a, b in ranges):
                return name
    return None


def letters(token: str) -> str:
    """A token without anything but letters, in lower case. Numerals, marks and signs are no letters, whatever their script."""
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token)).lower()


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams of all words, each set in ^ and $, one word after another, and how many each word has: its length."""
    lengths = np.array([len(w) for w in words], np.int64)
    c = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]
    starts = np.cumsum(lengths + 2) - lengths - 2
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    return codes[at], lengths


class LanguageModel:
    """Trigram log likelihoods and scripts by language. codes are sorted; the last row of table stands for all others."""

    def __init__(self, languages: list[str], codes: np.ndarray, table: np.ndarray, scripts: dict[str, np.ndarray]):
        self.languages, self.codes, self.table, self.scripts = languages, codes, table, scripts
        self.narrow = {k: u for k, u in scripts.items() if not u.all()}  # scripts that tell languages apart
        self.words = Remembered(self.score, len(languages) + 1)

    def score(self, tokens: list[str]) -> np.ndarray:
        """Scores by language, best 0, then the number of letters. All 0 for a token without letters."""
        out = np.zeros((len(tokens), len(self.languages) + 1), np.float32)
        words = [letters(t) for t in tokens]
        on = np.array([i for i, w in enumerate(words) if w], np.int64)
        if len(on):
            own = [words[i] for i in on]
            grams, lengths = trigrams(own)
            row = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
            row = np.where(self.codes[row] == grams, row, len(self.codes))
            s = np.add.reduceat(self.table[row], np.cumsum(lengths) - lengths)
            for i, w in enumerate(own) if self.narrow else ():
                mine = self.narrow.get("latin" if w.isascii() else script_of(w))
                if mine is not None:
                    s[i][~mine] = -np.inf
            out[on, :-1], out[on, -1] = np.maximum(s - s.max(1, keepdims=True), -CLIP), lengths
        return out

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The language number of each word of texts one after another.

        A switch costs the same whatever the languages, so a step compares staying with coming from the best.
        """
        lay = Lockstep(lengths)
        s, path = lay.pack(scores), np.zeros(len(scores), np.int8 if len(self.languages) < 127 else np.int16)
        stay, best = np.zeros(s.shape, bool), np.zeros(len(s), path.dtype)
        v = None
        for t in range(lay.steps):
            p = lay.part(t)
            if v is None:
                v = s[p].copy()
            else:
                v = v[: lay.active[t]]
                top = v.max(1, keepdims=True) - SWITCH
                np.greater_equal(v, top, out=stay[p])
                v = np.maximum(v, top) + s[p]
            best[p] = v.argmax(1)
        state = None
        for t in range(lay.steps - 1, -1, -1):
            p, n = lay.part(t), lay.active[t]
            if state is None:
                state = best[p].copy()
            else:
                after = lay.part(t + 1)
                m = lay.active[t + 1]
                kept = stay[after][np.arange(m), state]
                state = np.r_[np.where(kept, state, best[p][:m]), best[p][m:]] if n > m else np.where(kept, state, best[p])
            path[p] = state
        return lay.unpack(path)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """Language, score and spans (language, start, end) of each text."""
        if not len(self.codes):
            return [(UNKNOWN, 0.0, [])] * len(texts)
        tokens = [(t or "").split() for t in texts]
        lengths = np.array([len(x) for x in tokens], np.int64)
        table = self.words.look_up([w for x in tokens for w in x])
        path = self.decode(table[:, :-1], lengths)
        owner = np.repeat(np.arange(len(texts)), lengths)
        mass = np.bincount(owner * len(self.languages) + path, table[:, -1], minlength=len(texts) * len(self.languages)).reshape(len(texts), -1)
        total, top = mass.sum(1), mass.argmax(1)
        ends = np.cumsum(lengths)
        out = []
        for i, text in enumerate(texts):
            if not total[i]:
                out.append((UNKNOWN, 0.0, []))
                continue
            own = path[ends[i] - lengths[i] : ends[i]]
            out.append((self.languages[top[i]], float(mass[i, top[i]] / total[i]), self.spans(text, own)))
        self.words.trim()
        return out

    def spans(self, text: str, path: np.ndarray) -> list[tuple[str, int, int]]:
        if (path == path[0]).all():
            return [(self.languages[path[0]], len(text) - len(text.lstrip()), len(text.rstrip()))]
        out: list[tuple[str, int, int]] = []
        for m, k in zip(re.finditer(r"\S+", text), path, strict=True):
            if out and out[-1][0] == self.languages[k]:
                out[-1] = (out[-1][0], out[-1][1], m.end())
            else:
                out.append((self.languages[k], m.start(), m.end()))
        return out


def fit_texts(rows: Iterable[tuple[str, str]]) -> LanguageModel:
    """A model from texts with their languages."""
    words: dict[str, Counter] = {}
    for text, lang in rows:
        words.setdefault(lang, Counter()).update(text.split())
    languages = sorted(words)
    counts, scripts = [], {s: np.zeros(len(languages)) for s in SCRIPTS}
    for i, lang in enumerate(languages):
        tally: Counter = Counter()
        for token, n in words[lang].items():
            tally[letters(token)] += n
        del tally[""]
        own = list(tally)
        grams, lengths = trigrams(own) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        counts.append((grams, np.repeat(np.array([tally[w] for w in own], float), lengths)))
        for w, n in tally.items():
            if (s := script_of(w)) is not None:
                scripts[s][i] += n * len(w)
    codes = np.unique(np.concatenate([g for g, _ in counts])) if counts else np.zeros(0, np.uint64)
    table = np.zeros((len(codes) + 1, len(languages)))
    for i, (grams, n) in enumerate(counts):
        own = np.bincount(np.searchsorted(codes, grams), n, minlength=len(codes) + 1) + 0.1
        table[:, i] = np.log(own / own.sum())
    letters_of = sum(scripts.values()) if languages else np.zeros(0)
    # a language uses a script if a hundredth of its letters are of it
    used = {s: n >= 0.01 * np.maximum(letters_of, 1) for s, n in scripts.items()}
    return LanguageModel(languages, codes, table, {s: u for s, u in used.items() if u.any()})


def fit(docs: DataFrame, bound: int = BOUND) -> LanguageModel:
    """Learns from text and lang of docs: about bound documents of each language, chosen by hash of doc_id and text, twice as many at most, and CHARS characters."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    n_languages = counts.count()
    chosen = rows.join(checked(counts, n_languages), "lang").withColumn("_h", drawn(4, "doc_id", "text")).where(F.col("_h") < F.lit(float(1 << 40)) * bound / F.col("_n"))
    # only rows repeating an id and a text can reach the limit
    chosen = chosen.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "text"))).where(F.col("_r") <= 2 * bound)
    kept = bounded_texts(chosen.select("doc_id", "text", "lang"), 2 * bound * n_languages, CHARS, 4, "doc_id", "text") if n_languages else []
    return fit_texts(sorted((r.text, r.lang) for r in kept))


def label(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score and spans (lang, start, end)."""
    added = T._parse_datatype_string("lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>").fields
    kept = [f for f in docs.schema if f.name not in {a.name for a in added}]
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.codes, model.table, model.scripts))  # trigrams of a bounded sample
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            for part, texts in slices(batch, "text", 8_000_000):
                found = own.label(texts)
                spans = [[{"lang": a, "start": b, "end": c} for a, b, c in x[2]] for x in found]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64()), pa.array(spans, span)], [*(f.name for f in kept), *(a.name for a in added)])

    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def language_table(docs: DataFrame) -> DataFrame:
    fold = crc_mod(F.col("doc_id"), 4)
    model = fit(docs.where(fold != 2).select("doc_id", "text", "lang"))
    return label(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
