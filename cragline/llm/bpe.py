"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece of text exactly one token can end its encoding. Going from left to
right, an automaton gives the vocabulary's tokens that end at each place; the one that is compatible
with the last token of the prefix before it is kept. Following these tokens back from the end gives
the ids that merging pairs by rank would give. Compatible means that the two tokens, encoded as one
string, come out as themselves.

Cases: a null text is encoded as an empty one; an empty text has no ids and decodes to "";
repeated rows give equal rows; an empty table gives an empty one; very long texts are encoded
whole, in time that grows with their length; other columns of the input pass by untouched and may
have any name, those this operator adds excepted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain
from typing import Any

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Entries that a worker's memories of pieces and pairs hold at most.
MEMORY_PIECES, MEMORY_PAIRS = 300_000, 300_000
#: Characters of a text that are cut into pieces at a time.
PART_CHARS = 1_000_000
#: The pre-tokenizer's pattern: contractions, letters, numbers, other signs, white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
LONE_SPACE = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict[str, Any]:
    """Tokens as bytes with their ids, the merges in order, and the special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
    return {"tokens": {raw(s): i for s, i in data["model"]["vocab"].items()}, "merges": [(raw(a), raw(b)) for a, b in merges], "special": {t["content"]: t["id"] for t in data["added_tokens"]}}


class Pieces(dict):
    """Piece -> its ids."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.codec.piece(piece)
        if len(self) < MEMORY_PIECES and len(piece) < 64:
            self[piece] = ids
        return ids


def parts(text: str) -> Iterator[str]:
    """text in parts of about PART_CHARS characters. Each begins with a lone space, where a piece always begins."""
    start = 0
    while len(text) - start > PART_CHARS and (cut := LONE_SPACE.search(text, start + PART_CHARS)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Codec:
    """Encodes and decodes text with one vocabulary. Ranks 0-255 are bytes; then merges, in order."""

    def __init__(self, vocabulary: dict[str, Any]):
        tokens, merges = vocabulary["tokens"], vocabulary["merges"]
        rank = {bytes([b]): b for b in range(256)}
        self.halves = [(b, b) for b in range(256)]
        self.joined: dict[int, int] = {}
        for a, b in merges:
            i, j = rank[a], rank[b]
            self.joined[i << 20 | j] = r = len(self.halves)
            self.halves.append((i, j))
            rank.setdefault(a + b, r)
        self.bytes_of = [b""] * len(self.halves)
        self.automaton = ahocorasick.Automaton()
        for s, r in rank.items():
            self.bytes_of[r] = s
            self.automaton.add_word(s.decode("latin-1"), (r, len(s)))
        self.automaton.make_automaton()
        self.id_of = [tokens.get(s, -1) for s in self.bytes_of]
        self.text_of = {i: s for s, i in tokens.items()} | {i: s.encode() for s, i in vocabulary["special"].items()}
        self.special = vocabulary["special"]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.pieces = Pieces(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right side by side stay as they are.

        The merges that made both are undone, latest first. Had a pair at the border been able to
        merge before the later of the two merges beside it was made, it would have.
        """
        before = len(self.halves)
        while True:
            if self.joined.get(left << 20 | right, before) < before:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                before, left = left, self.halves[left][1]
            else:  # of two equal tokens the left one is made first
                before, right = right + 1, self.halves[right][0]

    def known(self, left: int, right: int) -> bool:
        """``compatible``, and remembered."""
        if len(self.pairs) >= MEMORY_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left << 20 | right] = self.compatible(left, right)
        return fits

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece, of which the pattern makes no two."""
        raw = text.encode("utf-8", "surrogatepass").decode("latin-1")
        last, starts, pair, done = [0] * len(raw), [0] * len(raw), self.pairs.get, -1
        for end, (token, size) in self.automaton.iter(raw):  # ends in order, longest match first
            if end == done:
                continue
            before = end - size
            if before >= 0:
                fits = pair(last[before] << 20 | token)
                if not (self.known(last[before], token) if fits is None else fits):
                    continue
            last[end], starts[end], done = token, before, end
        ids, at = [], len(raw) - 1
        while at >= 0:
            ids.append(self.id_of[last[at]])
            at = starts[at]
        return tuple(reversed(ids))

    def ordinary(self, text: str) -> list[int]:
        """Ids of text without special strings."""
        return [*chain.from_iterable(map(self.pieces.__getitem__, chain.from_iterable(map(PIECES.findall, parts(text)))))]

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.ordinary(text)
        ids: list[int] = []
        for part in self.cut.split(text):
            ids += [self.special[part]] if part in self.special else self.ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str, vocabulary: dict[str, Any]) -> Codec:
    """One codec a vocabulary and process."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(vocabulary)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of token ids and, if asked for, one of the text decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))  # of the vocabulary's size, whatever the input
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    schema = T.StructType([*(f for f in docs.schema if f.name not in (ids, decoded)), *added])
    kept = [f.name for f in docs.schema if f.name not in (ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, shared.value)
        for batch in batches:
            for part, texts in slices(batch, text):
                found = [own.encode(t) if t else [] for t in texts]
                columns = [part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(found, pa.list_(pa.int32()))]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in found], pa.string()))
                names = [*kept, ids] + [decoded] * bool(decoded)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    out = encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
