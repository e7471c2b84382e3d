"""Toxic spans by a linear-chain conditional random field.

Labels are given by document. Words and word beginnings that toxic documents of the training sample
hold far more often than others mark the tokens to learn from; the same tokens in other documents count
as plain. The field is fitted to windows of tagged tokens, with features of the word, its first and last
letters and transitions between tags, and so tags words it has not seen. Forward-backward over the
whole text gives each token's chance of being toxic; runs of likely tokens are the offending spans. The
chances are summed up for each document, and a logistic model on these sums, the largest chance and the
length, fitted to the same sample, gives its score.

Training reads labelled rows only, at most about ``BOUND`` of them, chosen by hash, with at most ``CHARS`` characters of text.

Cases: null and empty texts have no tokens, the score of no chance at all, and no spans; labels for unknown ids are not used;
several labels of one id count as their largest; without toxic labels, or without others, all scores are next to 0; rows with null
ids are scored and never learned from; repeated rows score alike; very long texts are tagged whole;
extra columns pass by, those named like the ones added are replaced.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, bounded_texts, crc_mod, slices
from .langid import letters
from .lockstep import Lockstep, Remembered
from .quality import training_labels

#: Labelled rows to learn from, at most, and characters in them; tokens in a training window; a document is toxic from this score on.
BOUND, CHARS, WINDOW, CUT = 4000, 40_000_000, 24, 0.7
#: A marking feature is so many times as frequent in toxic documents as in others, and so many standard deviations above chance.
RATIO, DEVIATIONS = 5.0, 6.0
#: Texts of fewer tokens are scored as if they had so many, as no others of their length were learned from.
SHORTEST = 20
#: Tokens from this chance on make up spans.
LIKELY = 0.5
ROUNDS, RATE, DECAY = 120, 0.15, 1e-4


def features(token: str) -> list[str]:
    w = letters(token)
    if not w:
        return []
    return [f"w{w}", *(f"p{w[:n]}" for n in (3, 4, 5) if len(w) > n), *(f"s{w[-n:]}" for n in (3, 4) if len(w) > n)]


class ToxicField:
    """Weights of features for the toxic tag against the plain one, and of steps between tags."""

    def __init__(self, weights: dict[str, float], bias: float, steps: np.ndarray, final: np.ndarray | None = None):
        self.weights, self.bias, self.steps = weights, bias, steps
        self.final = np.array([-8.0, 0, 0, 0, 0]) if final is None else final
        self.tokens = Remembered(self.score, 1)

    def score(self, tokens: list[str]) -> np.ndarray:
        """What speaks for the toxic tag in each token."""
        weight = self.weights.get
        return np.array([[self.bias + sum(weight(f, 0.0) for f in features(w))] for w in tokens])

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The chance of the toxic tag for each token of texts one after another.

        With two tags the forward and backward messages are each one number, the odds.
        """
        lay = Lockstep(lengths)
        e = lay.pack(np.exp(np.clip(scores, -30, 30).astype(float)))
        (oo, ot), (to, tt) = np.exp(self.steps)
        ahead, back = np.empty(len(e)), np.ones(len(e))
        r = None
        for t in range(lay.steps):
            p = lay.part(t)
            r = e[p] if r is None else e[p] * (ot + r[: lay.active[t]] * tt) / (oo + r[: lay.active[t]] * to)
            ahead[p] = r
        for t in range(lay.steps - 2, -1, -1):
            after, m = lay.part(t + 1), lay.active[t + 1]
            x = e[after] * back[after]
            back[lay.offsets[t] : lay.offsets[t] + m] = (to + tt * x) / (oo + ot * x)
        odds = lay.unpack(ahead * back)
        return odds / (1 + odds)

    def chances(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens one after another, and the sums over each text that scores are made of."""
        lengths = np.array([len(x) for x in tokens], np.int64)
        chance = self.marginals(self.tokens.look_up([w for x in tokens for w in x])[:, 0], lengths)
        self.tokens.trim()
        owner, n = np.repeat(np.arange(len(tokens)), lengths), len(tokens)
        none, most = np.bincount(owner, -np.log1p(-np.minimum(chance, 0.999)), minlength=n), np.zeros(n)
        np.maximum.at(most, owner, chance)
        return chance, np.stack([np.ones(n), np.log1p(none), most, 100 * none / np.maximum(lengths, SHORTEST), np.log1p(np.maximum(lengths, SHORTEST))], 1)

    def tag(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """Score and spans (start, end, chance) of each text."""
        tokens = [(t or "").split() for t in texts]
        chance, sums = self.chances(tokens)
        scores = 1 / (1 + np.exp(-np.clip(sums @ self.final, -30, 30)))
        ends, out = np.cumsum([len(x) for x in tokens]), []
        for i, text in enumerate(texts):
            own = chance[ends[i] - len(tokens[i]) : ends[i]]
            likely, spans = np.flatnonzero(own >= LIKELY), []
            if len(likely):
                places = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
                runs = np.split(likely, np.flatnonzero(np.diff(likely) > 1) + 1)
                spans = [(places[r[0]][0], places[r[-1]][1], float(own[r].max())) for r in runs]
            out.append((float(scores[i]), spans))
        return out


def marks(docs: list[tuple[list[str], bool]]) -> set[str]:
    """Features that tell toxic documents from others."""
    there: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for tokens, toxic in docs:
        there[toxic].update({f for w in set(tokens) for f in features(w) if f[0] == "w" or len(f) >= 5 and f[0] == "p"})
    n = {k: max(1, sum(t is k for _, t in docs)) for k in there}
    share, found = n[True] / (n[True] + n[False]), set()
    for f, k in there[True].items():
        both = k + there[False][f]
        above = (k - both * share) / (both * share * (1 - share)) ** 0.5
        if above >= DEVIATIONS and k / n[True] >= RATIO * there[False][f] / n[False]:
            found.add(f)
    return found


def fit_documents(docs: list[tuple[str, bool]], seed: int = 5) -> ToxicField:
    """A field from texts marked as toxic or not."""
    split = [([sys.intern(w) for w in t.split()], x) for t, x in docs]
    if not any(x for _, x in split) or all(x for _, x in split):
        return ToxicField({}, -30.0, np.zeros((2, 2)))
    telling, rng = marks(split), np.random.default_rng(seed)
    windows, tags, plain = [], [], []
    for tokens, toxic in split:
        t = np.array([any(f in telling for f in features(w)) for w in tokens], bool)
        for i in range(0, len(tokens), WINDOW):
            if t[i : i + WINDOW].any():
                windows.append(tokens[i : i + WINDOW])
                tags.append(t[i : i + WINDOW] & toxic)
            elif not toxic:
                plain.append(tokens[i : i + WINDOW])
    for i in rng.permutation(len(plain))[: max(4000, 2 * len(windows))]:
        windows.append(plain[i])
        tags.append(np.zeros(len(plain[i]), bool))
    named = [[features(w) for w in x] for x in windows]
    often = Counter(f for x in named for w in x for f in w)
    ids = {f: i for i, f in enumerate(sorted(f for f, n in often.items() if n >= 2))}
    lay = Lockstep(np.array([len(x) for x in windows]))
    flat = [[ids[f] for f in w if f in ids] for x in named for w in x]
    token, feature = np.repeat(np.arange(len(flat)), [len(x) for x in flat]), np.array([i for x in flat for i in x], np.int64)
    gold = np.concatenate(tags).astype(float)
    field = _train(ids, lay, token, feature, gold)
    field.final = _logistic(field.chances([t for t, _ in split])[1], np.array([x for _, x in split], float))
    return field


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the columns of x by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w)), x.T @ (y - p) / len(y) - ridge * w)
    return w


def _train(ids: dict[str, int], lay: Lockstep, token: np.ndarray, feature: np.ndarray, gold: np.ndarray) -> ToxicField:
    """Adam on the likelihood: the gradient is what the tags have less what the field expects of them."""
    w = np.zeros(len(ids) + 5)  # features, bias, steps
    w[len(ids)] = -2.0
    m, v, y = np.zeros_like(w), np.zeros_like(w), lay.pack(gold)
    n_seen = np.zeros((2, 2))
    for t in range(lay.steps - 1):
        a, b = y[lay.part(t)][: lay.active[t + 1]], y[lay.part(t + 1)]
        for i, x in enumerate((1 - a, a)):
            for j, z in enumerate((1 - b, b)):
                n_seen[i, j] += (x * z).sum()
    for k in range(1, ROUNDS + 1):
        steps = w[len(ids) + 1 :].reshape(2, 2)
        e = lay.pack(np.exp(np.clip(w[len(ids)] + np.bincount(token, w[feature], minlength=len(gold)), -30, 30)))
        x = np.exp(steps)
        forward, backward = np.empty((len(e), 2)), np.ones((len(e), 2))
        for t in range(lay.steps):
            p = lay.part(t)
            f = np.ones((lay.active[t], 2)) if t == 0 else forward[lay.part(t - 1)][: lay.active[t]] @ x
            f = f * np.stack([np.ones(len(f)), e[p]], 1)
            forward[p] = f / f.sum(1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(lay.steps - 2, -1, -1):
            after, n = lay.part(t + 1), lay.active[t + 1]
            out = backward[after] * np.stack([np.ones(n), e[after]], 1)
            joint = forward[lay.part(t)][:n, :, None] * x[None] * out[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = out @ x.T
            backward[lay.offsets[t] : lay.offsets[t] + n] = b / b.sum(1, keepdims=True)
        p1 = forward[:, 1] * backward[:, 1] / (forward * backward).sum(1)
        miss = gold - lay.unpack(p1)
        gradient = np.r_[np.bincount(feature, miss[token], minlength=len(ids)), miss.sum(), (n_seen - expected).ravel()] / len(gold) - DECAY * w * np.r_[np.ones(len(ids)) * 0.01, np.zeros(5)]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w = w + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return ToxicField({f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 1e-3}, float(w[len(ids)]), w[len(ids) + 1 :].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> ToxicField:
    known = bounded_sample(labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").alias("_y")), bound, 9, "doc_id")
    known = known.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "_y")  # known is bounded above
    return fit_documents(sorted((r.text, r._y > 0) for r in bounded_texts(rows, 2 * bound, CHARS, 9, "doc_id", "text")))


def tag(docs: DataFrame, model: ToxicField) -> DataFrame:
    """docs with score and spans (start, end, chance)."""
    added = T._parse_datatype_string("score double, spans array<struct<start: int, end: int, chance: double>>").fields
    kept = [f for f in docs.schema if f.name not in {a.name for a in added}]
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.steps, model.final))  # features of a bounded sample
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicField(*shared.value)
        for batch in batches:
            for part, texts in slices(batch, "text", 8_000_000):
                found = own.tag(texts)
                spans = [[{"start": a, "end": b, "chance": c} for a, b, c in x[1]] for x in found]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), pa.array([x[0] for x in found], pa.float64()), pa.array(spans, span)], [*(f.name for f in kept), *(a.name for a in added)])

    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    tagged = tag(docs, fit(docs, training_labels(labels, 3, 1)))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return tagged.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), offsets.alias("offsets"))
