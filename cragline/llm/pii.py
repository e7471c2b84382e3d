"""Personal data: exact base patterns, and a character-level BiLSTM with CRF transitions that adds to them.

Base spans come from the patterns of ``base_spans``. The network reads every text whole, in windows that overlap by
half of ``WINDOW - STEP`` on each side of where they are joined; it tags each character as outside, first or further
character of a kind. A character takes the tag of the window in which it stands farthest from an edge, over the whole
text, and spans are read off the joined tags. Their ends move out to the ends of the runs of address characters or digits they
stand in. A span that overlaps a base span, or that lacks the form, digits, groups or checksum of its kind, is dropped. The network is
trained in numpy (Adam, back-propagation through time, exact CRF gradients) on labelled spans; by default on
``made_samples``, generated from a seed.

Cases: a null or empty text has no spans; repeated rows give equal rows, as do rows with a null doc_id; very long texts are read whole,
window by window in batches of bounded size, in time that grows with their length; spans of different kinds may overlap, base spans
of one kind never do, added ones overlap no others; an empty table gives an empty one; of other columns only doc_id and text are read.
Places count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind number, end

# ---------------------------------------------------------------- base patterns

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts with a run of digits and ends with one, so starts inside a run can be left out
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Address places, found from their at-signs, so that long runs of letters cost no more than short ones."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def is_byte(part: str) -> bool:
    """Whether digits, of which there may be very many, say 255 at most."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind."""
    if not ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(is_byte, m.groups()))]
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(m.group().count, "0123456789")) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- the network

LETTERS = "abcdefghijklmnopqrstuvwxyz@._%+-()[]{}<>:;,/\\'\"!?#*&=|$"
#: Windows are read WINDOW characters long, each STEP after the one before; LEARNED is the length of those learned from.
EMBED, HIDDEN, WINDOW, STEP, LEARNED, BATCH = 12, 20, 512, 448, 128, 1024
TILE = 256  # windows of a batch that lie side by side in one product
TAGS = 1 + 2 * len(KINDS)  # outside; first and further of each kind


def char_ids() -> dict[str, int]:
    """0 pads; 1 other signs, 2 other letters, 3 digits, 4 blanks, 5 line ends, then single characters."""
    table = {c: i + 6 for i, c in enumerate(LETTERS)}
    return table | {c.upper(): table[c] for c in LETTERS[:26]} | dict.fromkeys("0123456789", 3) | dict.fromkeys(" \t\xa0", 4) | dict.fromkeys("\n\r", 5)


IDS = char_ids()
SYMBOLS = 6 + len(LETTERS)


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """The symbol of each code point."""
    table = np.fromiter((2 if chr(i).isalpha() else 1 for i in range(0x110000)), np.uint8, 0x110000)
    for c, i in IDS.items():
        table[ord(c)] = i
    return table


def encode(text: str) -> np.ndarray:
    return symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


@lru_cache(maxsize=1)
def fast_tanh() -> bool:
    """Whether numpy takes tanh by vectors of 512 bits; narrower ones cost it nearly twice as much as exp."""
    found = np.lib.introspect.opt_func_info(func_name="^tanh$", signature="float32")
    return any("AVX512" in x["current"] for by in found.values() for x in by.values())


def cell_by_tanh(z: np.ndarray, c: np.ndarray, y: np.ndarray, h: np.ndarray) -> None:
    """A step of LSTM cells in place: z has half of what goes into the gates and all of the new values, h gets twice the states; y is scratch."""
    f, i, o, a = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
    np.tanh(z, out=z)
    z[:, : 3 * HIDDEN] += 1
    i *= a
    c *= f
    c += i
    c *= 0.5
    np.multiply(o, np.tanh(c, out=y), out=h)


def cell_by_exp(z: np.ndarray, c: np.ndarray, y: np.ndarray, h: np.ndarray) -> None:
    """The same with tanh(x) as 2 / (1 + exp(-2x)) - 1: z has gates negated and new values times -2, c is -2 times the memory, h gets half the states."""
    f, i, o, a = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
    with np.errstate(over="ignore"):  # 1 / (1 + infinity) is right
        np.exp(z, out=z)
        z += 1
        np.reciprocal(z[:, : 3 * HIDDEN], out=z[:, : 3 * HIDDEN])
        np.divide(-4, a, out=a)
        a += 2
        i *= a
        c *= f
        c += i
        np.exp(c, out=y)
    y += 1
    np.reciprocal(y, out=y)
    y -= 0.5
    np.multiply(o, y, out=h)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Embedding, one LSTM each way, a linear layer and a linear-chain CRF."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        scale = lambda *s: rng.standard_normal(s) * (1 / s[0]) ** 0.5
        self.p = {"embed": rng.standard_normal((SYMBOLS, EMBED)) * 0.5, "out": scale(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS), "step": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
        for d in ("f", "b"):
            self.p |= {f"x{d}": scale(EMBED, 4 * HIDDEN), f"h{d}": scale(HIDDEN, 4 * HIDDEN), f"c{d}": np.r_[np.ones(HIDDEN), np.zeros(3 * HIDDEN)]}
        # a further character follows one of its kind only
        self.ban = np.zeros((TAGS, TAGS), bool)
        for k in range(len(KINDS)):
            self.ban[:, 2 + 2 * k] = True
            self.ban[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False
        self.ban_first = np.array([t > 0 and t % 2 == 0 for t in range(TAGS)])

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.ban, -1e4, self.p["step"]), np.where(self.ban_first, -1e4, self.p["start"])

    def lstm(self, e: np.ndarray, live: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (length, n, HIDDEN) of one direction; e is (length, n, EMBED). Padding resets the state."""
        order = range(len(e)) if d == "f" else range(len(e) - 1, -1, -1)
        pre = e @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((e.shape[1], HIDDEN), e.dtype)
        out = np.zeros((*e.shape[:2], HIDDEN), e.dtype)
        for t in order:
            z = pre[t] + h @ self.p[f"h{d}"]
            g = sigmoid(z[:, : 3 * HIDDEN])
            f, i, o, a = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, (f * c + i * a) * live[t][:, None]
            y = np.tanh(c)
            if keep is not None:
                keep.append((t, h, before, f, i, o, a, y))
            h = o * y
            out[t] = h
        return out

    def scores(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(length, n, TAGS) for ids (n, length), 0 being padding."""
        e, live = self.p["embed"][ids.T], (ids.T > 0).astype(self.p["embed"].dtype)
        logs = {d: [] for d in "fb"} if keep is not None else dict.fromkeys("fb")
        h = np.concatenate([self.lstm(e, live, d, logs[d]) for d in "fb"], 2)
        if keep is not None:
            keep |= {"e": e, "live": live, "h": h, **logs}
        return h @ self.p["out"] + self.p["out_b"]

    def quick_scores(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``scores`` of windows of falling length, without what training needs: (length, TAGS, n), beyond a window's end without meaning.

        Windows lie along the last axis, in tiles of TILE, so that a step is one product of weights with states and symbols side by side
        for each tile, every gate is a block of its own, and a step stays in the cache. The product's last rows are the scores of the
        step before. The weights have the factors with which the cells want their gates and give their states.
        """
        kind, n, steps = self.p["embed"].dtype.type, len(ids), ids.shape[1]
        cell, gate, fresh, state = (cell_by_tanh, 0.5, 1, 0.5) if fast_tanh() else (cell_by_exp, -1, -2, 2)
        live = n - np.searchsorted(lengths[::-1], np.arange(steps), "right")
        tiles = -(-n // TILE)
        at, out = np.zeros((steps, tiles * TILE), np.intp), np.empty((steps, TAGS, tiles * TILE), kind)
        at[:, :n] = ids.T
        by_tile, symbols = out.reshape(steps, TAGS, tiles, TILE).transpose(0, 2, 1, 3), np.ascontiguousarray(self.p["embed"].T)
        factors = np.repeat(np.array([gate, gate, gate, fresh], kind), HIDDEN)[:, None]
        for k, d in enumerate("fb"):
            gates = np.concatenate([self.p[f"h{d}"].T * kind(state), self.p[f"x{d}"].T, self.p[f"c{d}"][:, None]], 1) * factors
            tags = np.concatenate([self.p["out"][k * HIDDEN : (k + 1) * HIDDEN].T * kind(state), np.zeros((TAGS, EMBED), kind), self.p["out_b"][:, None] * kind(d == "f")], 1)
            weights = np.concatenate([gates, tags])
            x, z = np.zeros((tiles, weights.shape[1], TILE), kind), np.empty((tiles, len(weights), TILE), kind)
            c, y = np.zeros((tiles, HIDDEN, TILE), kind), np.empty((tiles, HIDDEN, TILE), kind)
            x[:, -1] = 1
            before = done = 0  # the step before, and how many tiles it had
            for t in [*(range(steps) if d == "f" else range(steps - 1, -1, -1)), None]:
                q = 0 if t is None else -(-live[t] // TILE)
                for j in range(q):
                    symbols.take(at[t, j * TILE : (j + 1) * TILE], 1, x[j, HIDDEN:-1], "clip")
                np.matmul(weights, x[: max(q, done)], out=z[: max(q, done)])
                if d == "f":
                    by_tile[before, :done] = z[:done, 4 * HIDDEN :]
                else:
                    by_tile[before, :done] += z[:done, 4 * HIDDEN :]
                if q:
                    cell(z[:q, : 4 * HIDDEN], c[:q], y[:q], x[:q, :HIDDEN])
                    if d == "b" and live[t] < q * TILE:  # windows of the last tile that are not yet reached from their ends
                        x[q - 1, :HIDDEN, live[t] - q * TILE :] = c[q - 1, :, live[t] - q * TILE :] = 0
                before, done = t, q
        return out[:, :, :n]

    def may_differ(self, s: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The windows whose best path may have any tag but outside.

        A run of other tags is worth no more than if its kind could change at each place: a path of three tags, outside, first
        and further, each with the best score of any kind over outside, has runs at least as good.
        """
        step, start = self.steps()
        at, kind, n = step[0, 0], s.dtype.type, s.shape[2]
        enter, again, go_on, leave = (kind(x - at) for x in (step[0, 1::2].max(), step[1:, 1::2].max(), max(step[j, 2 * k + 2] for k in range(len(KINDS)) for j in (2 * k + 1, 2 * k + 2)), step[1:, 0].max()))
        live = [*(n - np.searchsorted(lengths[::-1], np.arange(len(s)), "right")).tolist(), 0]  # windows that have a place t
        first, run, worth = np.empty(n, kind), np.full(n, -np.inf, kind), np.full(n, -np.inf, kind)
        for t, m in enumerate(live[:-1]):
            f, r = first[:m], run[:m]
            if t:
                np.maximum(np.add(r, again, out=f), enter, out=f)
                r += go_on
            else:
                f[:] = kind(start[1::2].max() - start[0])
            f += s[t, 1::2, :m].max(0)
            r += s[t, 2::2, :m].max(0)
            np.maximum(r, f, out=r)
            r -= s[t, 0, :m]
            on = live[t + 1]  # runs that go back to outside are worth their best end, and those of windows that end here too
            worth[:on] = np.maximum(worth[:on], r[:on] + leave)
            worth[on:m] = np.maximum(worth[on:m], r[on:])
        return worth > -1e-3

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags (n, length); windows end with their padding, which is outside."""
        tags = np.zeros(ids.shape, np.int8)
        if not len(ids):
            return tags
        lengths = (ids > 0).sum(1)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        s = self.quick_scores(ids[order, : max(1, lengths[0])], lengths)
        on = np.flatnonzero(self.may_differ(s, lengths))
        if len(on):
            tags[order[on], : s.shape[0]] = self.viterbi(np.ascontiguousarray(s[:, :, on]), lengths[on])
        return tags

    def viterbi(self, s: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags (n, length) for scores (length, TAGS, n) of windows of falling length, beyond which they are 0."""
        (step, start), (n_steps, _, n) = self.steps(), s.shape
        step, v = step.astype(s.dtype), np.empty_like(s)
        free, own = [0, *range(1, TAGS, 2)], range(2, TAGS, 2)  # tags that follow any, and those that follow their own kind only
        ways, first, again = step[:, free, None], np.array([step[k - 1, k] for k in own])[:, None], np.array([step[k, k] for k in own])[:, None]
        v[0] = s[0] + start.astype(s.dtype)[:, None]
        live = n - np.searchsorted(lengths[::-1], np.arange(n_steps), "right")
        for t in range(1, n_steps):
            m = live[t]
            before, now = v[t - 1, :, :m], v[t, :, :m]
            any_before = (before[:, None] + ways).max(0)
            now[0], now[1::2] = any_before[0], any_before[1:]
            np.maximum(before[1::2] + first, before[2::2] + again, out=now[2::2])
            now += s[t, :, :m]
        tags, now, into = np.zeros((n, n_steps), np.int8), np.zeros(0, np.int64), np.ascontiguousarray(step.T)
        for t in range(n_steps - 1, -1, -1):
            m, known = live[t], len(now)  # windows that end here begin with their best tag
            if known:
                now = (v[t, :, :known].T + into[now]).argmax(1)
            if known < m:
                now = np.concatenate([now, v[t, :, known:m].argmax(0)])
            tags[:m, t] = now
        return tags

    def loss_and_gradient(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: dict = {}
        s, (step, start) = self.scores(ids, keep), self.steps()
        live, n_steps, n = keep["live"], *s.shape[:2]
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[0] = s[0] + start
        for t in range(1, n_steps):
            a[t] = np.where(live[t][:, None] > 0, lse(a[t - 1][:, :, None] + step, 1) + s[t], a[t - 1])
        for t in range(n_steps - 2, -1, -1):
            b[t] = np.where(live[t + 1][:, None] > 0, lse(step + (s[t + 1] + b[t + 1])[:, None, :], 2), b[t + 1])
        z, gold_t, rows = lse(a[-1], 1), gold.T, np.arange(n)
        ds, g = np.exp(a + b - z[None, :, None]) * live[:, :, None], {k: np.zeros_like(v) for k, v in self.p.items()}
        g["start"] += ds[0].sum(0)
        loss = z.sum()
        for t in range(n_steps):
            on = live[t] > 0
            loss -= s[t][rows, gold_t[t]][on].sum()
            ds[t][rows[on], gold_t[t][on]] -= 1
            if t == 0:
                loss -= start[gold_t[0]].sum()
                np.subtract.at(g["start"], gold_t[0], 1)
            else:
                loss -= step[gold_t[t - 1], gold_t[t]][on].sum()
                np.subtract.at(g["step"], (gold_t[t - 1][on], gold_t[t][on]), 1)
                joint = np.exp(np.minimum(a[t - 1][:, :, None] + step + (s[t] + b[t])[:, None, :] - z[:, None, None], 0))
                g["step"] += joint[on].sum(0)
        g["step"][self.ban], g["start"][self.ban_first] = 0, 0
        g["out"], g["out_b"] = np.tensordot(keep["h"], ds, ((0, 1), (0, 1))), ds.sum((0, 1))
        dh, de = ds @ self.p["out"].T, np.zeros_like(keep["e"])
        for k, d in enumerate("fb"):
            nh, nc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for t, h, before, f, i, o, x, y in reversed(keep[d]):
                now = dh[t][:, k * HIDDEN : (k + 1) * HIDDEN] + nh
                dc = (nc + now * o * (1 - y * y)) * live[t][:, None]
                dz = np.concatenate([dc * before * f * (1 - f), dc * x * i * (1 - i), now * y * o * (1 - o), dc * i * (1 - x * x)], 1)
                g[f"h{d}"] += h.T @ dz
                g[f"c{d}"] += dz.sum(0)
                g[f"x{d}"] += keep["e"][t].T @ dz
                de[t] += dz @ self.p[f"x{d}"].T
                nh, nc = dz @ self.p[f"h{d}"].T, dc * f
        np.add.at(g["embed"], ids.T, de)
        return float(loss), g

    def fit(self, ids: np.ndarray, gold: np.ndarray, rounds: int, size: int = 64, rate: float = 0.02, seed: int = 4) -> list[float]:
        """Adam over shuffled batches; the mean loss of each round."""
        rng, m, v, k, losses = np.random.default_rng(seed), {x: 0.0 for x in self.p}, {x: 0.0 for x in self.p}, 0, []
        for r in range(rounds):
            order, total = rng.permutation(len(ids)), 0.0
            for i in range(0, len(order), size):
                at = order[i : i + size]
                loss, g = self.loss_and_gradient(ids[at], gold[at])
                total, k = total + loss, k + 1
                big = max(1.0, np.sqrt(sum((x * x).sum() for x in g.values())) / (5.0 * len(at)))
                for x in self.p:
                    d = g[x] / len(at) / big
                    m[x], v[x] = 0.9 * m[x] + 0.1 * d, 0.99 * v[x] + 0.01 * d * d
                    self.p[x] = self.p[x] - rate * (1 - r / rounds) * (m[x] / (1 - 0.9**k)) / (np.sqrt(v[x] / (1 - 0.99**k)) + 1e-8)
            losses.append(total / len(ids))
        return losses


# ---------------------------------------------------------------- labelled spans

Sample = tuple[str, list[Span]]


ONSETS = [*"bbccddffgghhjkllmmnnpprrssttvvwwxyz", "qu", "ch", "sch", "th", "st", "tr", "br", "pl", "gr", "sh", "", "", ""]
VOWELS = [*"aaeeeeiioouuy", "ie", "ei", "ou", "ea", "au", "ai"]
CODAS = [*"bcdfgklmnnnprrsssttxz", "nd", "ng", "st", "ck", "ll", "ss", "rt", "nt", "ch"]


def made_samples(n: int, seed: int) -> list[Sample]:
    """Short texts of invented words with personal data in plain and altered forms, and with numbers and words that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllable = lambda: pick(ONSETS) + pick(VOWELS) + (pick(CODAS) if rng.random() < 0.5 else "")
    plain = lambda: "".join(syllable() for _ in range(pick([1, 1, 2, 2, 3, 4])))

    def word() -> str:
        w, form = plain(), rng.integers(20)
        if form < 2:
            return w.title()
        if form == 2:
            return w.upper()
        if form == 3:
            return w[:1] + pick(["é", "ü", "ñ", "ö", "ш", "漢"]) + w[1:]
        return w

    stop = lambda: pick([" ", " ", " ", " ", " ", ", ", ". ", "\n", "; ", ": ", " - ", ".\n\n", "? ", " (", ") ", '" '])

    def email() -> str:
        name = pick([plain(), plain() + pick([".", "_", ""]) + plain(), plain() + num(2), plain() + "." + num(2), plain() + plain() + "." + plain() + plain() + pick(["", "-"]) + plain()])
        host, end = pick(["mail", "post", plain(), plain() + "-" + plain() + "-of-" + plain()]) + pick(["", num(1)]), pick(["com", "org", "net", "example.com", "de", "co.uk"])
        form, case = rng.integers(7), pick([str, str.upper])
        if form == 0:
            return f"{name}@{host}.{end}"
        at, dot = case("at"), case("dot")
        if form == 1:
            return f"{name} {at} {host} {dot} {end.replace('.', f' {dot} ')}"
        if form == 2:
            j = pick(["-", "_", " ", " -"])
            k = j[::-1]
            return pick([f"{name}{j}{at}{k}{host}{j}{dot}{k}{end.replace('.', f'{j}{dot}{k}')}", f"{name} @ {host} . {end.replace('.', ' . ')}"])
        if form == 3:
            return f"{name} {at} {host}.{end}"
        o, c = pick(["()", "[]", "{}", "<>"])
        return pick([f"{name}{o}{at}{c}{host}.{end}", f"{name} {o}{at}{c} {host} {o}{dot}{c} {end.replace('.', f' {o}{dot}{c} ')}", f"{name} {o}{at}{c} {host}.{end}"])

    def ip() -> str:
        return pick([".", ".", "[.]", " . "]).join(str(rng.integers(1, 256)) for _ in range(4))

    def card() -> str:
        d = pick(["4", "5", "3", "6"]) + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick(["", " ", "-", ".", "/"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {a} {b} {c}", f"00{num(2)} {a} {b} {c}", f"0{num(3)}/{num(7)}"])

    def other() -> str:
        k = rng.integers(13)
        hexa = "".join(pick("0123456789abcdef") for _ in range(rng.integers(12, 41)))
        return [f"{num(1)}.{num(1)}.", f"version {num(1)}", f'token = "{hexa}"', f"20{num(2)}-0{num(1)}-1{num(1)}", f"1{num(1)}:3{num(1)}", f"{num(2)},{num(2)}", num(int(rng.integers(1, 9))), f"at {word()}", f"{num(1)}.{num(2)}.{num(1)}", f"{word()} at {word()} {word()}. {word().title()} dot", f"{word()}-{word()}_{word()}", f"https://{plain()}.{plain()}.com/{plain()}?{plain()}={num(2)}", "".join(pick("=*-_~") for _ in range(3)) * 4][k]

    makers, out = (email, ip, card, phone), []
    for _ in range(n):
        text, spans = "", []
        for j in range(rng.integers(1, 4)):
            text += pick(["", " "]) if j == 0 else " "
            text += "".join(word() + stop() for _ in range(pick([0, 1, 2, 3, 5, 8, 12])))
            k = int(rng.integers(8))
            made = makers[k]() if k < 4 else other()
            if len(text) + len(made) > LEARNED - 10:
                break
            if k < 4:
                spans.append((len(text), k, len(text) + len(made)))
            text += made + pick([" ", ".", ",", "!!", "***", "\n"])
        out.append(((text + word())[:LEARNED], spans))
    return out


def as_arrays(samples: Sequence[Sample]) -> tuple[np.ndarray, np.ndarray]:
    ids, gold = np.zeros((len(samples), LEARNED), np.int64), np.zeros((len(samples), LEARNED), np.int64)
    for i, (text, spans) in enumerate(samples):
        e = encode(text[:LEARNED])
        ids[i, : len(e)] = e
        for a, k, b in spans:
            gold[i, a:b] = 2 + 2 * k
            gold[i, a] = 1 + 2 * k
    return ids, gold


def train(samples: Sequence[Sample], rounds: int = 10, seed: int = 3) -> Tagger:
    model = Tagger(seed)
    model.fit(*as_arrays([x for x in samples if x[0]]), rounds, 96, 0.03)
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    return model


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    return train(made_samples(3000, 1))


# ---------------------------------------------------------------- whole texts


def windows(length: int) -> np.ndarray:
    """Where the windows of a text begin; the last one reaches its end."""
    return np.arange(max(length > 0, 1 - (WINDOW - length) // STEP)) * STEP


def tagged(texts: Sequence[str], model: Tagger) -> tuple[np.ndarray, np.ndarray]:
    """The tags of all characters, one text after another, and where each text begins."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    symbols = np.concatenate([encode("".join(texts)), np.zeros(WINDOW, np.uint8)])
    stretches = np.lib.stride_tricks.sliding_window_view(symbols, WINDOW)
    own = [windows(n) for n in lengths.tolist()]
    first = np.concatenate([b + w for b, w in zip(begins, own, strict=True)]) if own else np.zeros(0, np.int64)
    ends = np.repeat(begins + lengths, [len(w) for w in own])
    size = np.minimum(WINDOW, ends - first)
    # of two windows that overlap, each keeps the half of the overlap that is farther from its edge
    a = first + np.where(np.r_[True, first[1:] >= ends[:-1]], 0, (WINDOW - STEP) // 2) if len(first) else first
    b = np.where(first + size < ends, first + STEP + (WINDOW - STEP) // 2, ends)
    tags, place = np.zeros(total, np.int8), np.arange(WINDOW)
    order = np.argsort(-size, kind="stable")  # windows of a length together, so that few places are padding
    for i in range(0, len(order), BATCH):
        w = order[i : i + BATCH]
        ids = stretches[first[w]]
        ids[place >= size[w, None]] = 0
        found = model.decode(ids)
        for r in np.flatnonzero(found.any(1)):
            k = w[r]
            tags[a[k] : b[k]] = found[r, a[k] - first[k] : b[k] - first[k]]
    return tags, begins


def read_spans(tags: Sequence[int], at: int) -> Iterator[Span]:
    """Spans of a stretch of tags that begins at a place of the text."""
    start = kind = None
    for i, t in enumerate([*tags, 0]):
        if kind is not None and t != 2 + 2 * kind:
            yield at + start, kind, at + i
            kind = None
        if t % 2:
            start, kind = i, (t - 1) // 2


#: Ways to write "@" and "." in words or apart; a full stop with blanks counts only with blanks on both sides.
SIGNS = re.compile(
    r"(?P<at>(?<!\s)\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|(?<![\s_-])[\s_-]+at[\s_-]+|(?<!\s)\s*@\s*)"
    r"|(?<!\s)\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|(?<![\s_-])[\s_-]+dot[\s_-]+|(?<!\s)\s+\.\s+",
    re.IGNORECASE,
)
TOP = re.compile(r"\.[A-Za-z]{2,}\Z")


def addresses(s: str) -> list[tuple[int, int]]:
    """Places of addresses in a tagged string, as found once its signs are written as such."""
    out, at, size, parts, starts = [], 0, 0, [], [0]
    places = [0]  # where in s the parts of the rewritten string begin, by their places in it
    for m in SIGNS.finditer(s):
        for piece, begin in ((s[at : m.start()], at), ("@" if m["at"] else ".", m.start())):
            parts.append(piece)
            starts.append(size)
            places.append(begin)
            size += len(piece)
        at = m.end()
    parts.append(s[at:])
    starts.append(size)
    places.append(at)
    rewritten = "".join(parts)
    for a, b in emails(rewritten):
        if TOP.search(rewritten, a, b):
            i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
            out.append((places[i] + a - starts[i], places[j] + b - starts[j]))
    return out


def plausible(kind: int, s: str) -> bool:
    """Whether a tagged string has what its kind must have, if that is no address."""
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)
    d = digits_of(s)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and len(s) > len(d) and not re.search(r"[A-Za-z]", s)


DIGITS = frozenset("0123456789")
HOST = LOCAL - frozenset("._%+")


def whole(text: str, kind: int, a: int, b: int, least: int, most: int) -> tuple[int, int]:
    """A tagged span without blanks and closing marks at its ends, moved out to the ends of its runs of characters within least and most."""
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1] in " \t\r\n.,;:!?*":
        b -= 1
    if a < b:
        left, right = (LOCAL, HOST) if kind == 0 else (DIGITS, DIGITS)
        if text[a] in left:
            while a > least and text[a - 1] in left:
                a -= 1
        if text[b - 1] in right:
            while b < most and text[b] in right:
                b += 1
    return a, b


def added_spans(texts: Sequence[str], base: Sequence[list[Span]], model: Tagger) -> list[list[Span]]:
    """What the network finds beside the base spans of each text."""
    found: list[list[Span]] = [[] for _ in texts]
    tags, begins = tagged(texts, model)
    on = np.flatnonzero(tags)
    owner = np.searchsorted(begins, on, "right") - 1
    cuts = np.flatnonzero((np.diff(on) > 1) | (np.diff(owner) > 0)) + 1
    marked: dict[int, list[Span]] = {}
    for run, i in zip(np.split(on, cuts), owner[np.r_[0, cuts]] if len(on) else (), strict=True) if len(on) else ():
        marked.setdefault(int(i), []).extend(read_spans(tags[run[0] : run[-1] + 1].tolist(), int(run[0] - begins[i])))
    for i, spans in marked.items():
        text, taken, least = texts[i], base[i], 0
        starts, reach = [x for x, _, _ in taken], list(accumulate((y for _, _, y in taken), max))
        for j, (a, k, b) in enumerate(spans):
            a, b = whole(text, k, a, b, least, spans[j + 1][0] if j + 1 < len(spans) else len(text))
            for x, y in ((a + x, a + y) for x, y in addresses(text[a:b])) if k == 0 else ((a, b),) if plausible(k, text[a:b]) else ():
                before = bisect_left(starts, y)
                if x < y and (not before or reach[before - 1] <= x):
                    found[i].append((x, k, y))
                    least = y
            least = max(least, spans[j][2])
    return found


def as_text(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, counts and digest of base spans, all spans, and how many the network added."""
    shared = docs.sparkSession.sparkContext.broadcast(model.p)  # of fixed size
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger()
        own.p = shared.value
        for batch in batches:
            for part, got in slices(batch, "text"):
                texts = [t or "" for t in got]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, own)
                counts = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                digest = pa.array([hashlib.sha256(as_text(b).encode()).hexdigest() for b in base])
                both = pa.array([as_text(sorted([*b, *m])) for b, m in zip(base, more, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, both, pa.array([len(m) for m in more], pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def private_table(docs: DataFrame) -> DataFrame:
    return find(docs, default_tagger())
