"""Cutting long texts into pieces at natural boundaries, sized in tokens, with overlap.

A text above the limit is split at its sections, a section that is still too long at its paragraphs, then
at sentences (or lines), words and characters.  The resulting units are packed greedily: a piece takes
units as long as they fit, and the next one starts ``overlap`` tokens before its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import VOCABULARY, ForcedBoundaryEncoder, encoder, ship

LIMIT, OVERLAP = 1024, 64

_NL = rb"(?:\r\n|\r|\n)"
#: By level, coarse to fine, patterns whose match begins where a piece may end: before the white space.  Words, the
#: next level, end before any white space, and need no pattern.
SEPARATORS = (
    ("section", re.compile(rb"\f|" + _NL + rb"(?:[ \t]*" + _NL + rb"){2,}|" + _NL + rb"(?=#{1,6} |[=*_-]{3,}[ \t]*" + _NL + rb"|[A-Z][A-Z0-9 /&-]{3,60}" + _NL + rb")")),
    ("paragraph", re.compile(_NL + rb"[ \t]*" + _NL)),
    ("sentence", re.compile(_NL + rb"""|(?<=[.!?])\s|(?<=[.!?]["')\]])\s|(?<=\xe0\xa5\xa4)(?!\xe0\xa5\xa4)""")),
)
LEVELS = (*(name for name, _ in SEPARATORS), "word", "character")


class Splitter:
    def __init__(self, e: ForcedBoundaryEncoder, limit: int = LIMIT, overlap: int = OVERLAP):
        if not 0 <= overlap < limit:
            raise ValueError("overlap must be less than limit")
        self.e, self.limit, self.overlap = e, limit, overlap

    def _units(self, data: bytes, ends: np.ndarray, whole: np.ndarray, words: np.ndarray) -> list[tuple[int, str]]:
        """(end in tokens, level of that boundary) of the units, in order; none larger than limit - overlap if
        the text has any boundary at all inside."""
        most = self.limit - self.overlap
        offset = np.concatenate([[0], ends])  # offset[t]: bytes before token t
        out: list[tuple[int, str]] = []

        def at_tokens(found: np.ndarray) -> np.ndarray:
            t = np.searchsorted(offset, found)
            return t[(t < len(offset)) & (offset[np.minimum(t, len(offset) - 1)] == found)]

        cuts = [at_tokens(np.array([m.start() for m in p.finditer(data)], np.int64)) for _, p in SEPARATORS] + [words]

        def divide(lo: int, hi: int, level: int, ended_by: str) -> None:
            if hi - lo <= most:
                out.append((hi, ended_by))
            elif level < len(cuts):
                own = cuts[level][np.searchsorted(cuts[level], lo, "right") : np.searchsorted(cuts[level], hi)].tolist()
                for a, b in zip([lo, *own], [*own, hi], strict=True):
                    divide(a, b, level + 1, LEVELS[level] if b != hi else ended_by)
            else:
                while hi - lo > most:
                    inside = np.flatnonzero(whole[lo + 1 : lo + most + 1])
                    lo = lo + 1 + int(inside[-1]) if len(inside) else lo + most
                    out.append((lo, "character"))
                out.append((hi, ended_by))

        divide(0, len(ends), 0, "end")
        return out

    def pieces(self, text: str | None) -> list[tuple[int, int, str, str]]:
        """(first token, token after the last, boundary, text) of each piece; none for a text within the limit."""
        if not text:
            return []
        ids = self.e.encode(text)
        if len(ids) <= self.limit:
            return []
        data = text.encode("utf-8", "replace")
        ends = np.cumsum(self.e.lengths[ids]).astype(np.int64)
        b = np.frombuffer(data + b" ", np.uint8)
        whole = np.concatenate([[True], (b[ends] & 0xC0) != 0x80])  # whole[t]: token t begins a character
        white = np.isin(b, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
        clean = np.concatenate([[True], white[ends] & ~white[ends - 1]])  # ... where the pattern splits anyway
        offset = np.concatenate([[0], ends])
        units = self._units(data, ends, whole, np.flatnonzero(clean[:-1])[1:])
        places = np.array([u for u, _ in units])
        out: list[tuple[int, int, str, str]] = []
        start, n = 0, len(ids)

        def text_of(lo: int, hi: int) -> str:
            return data[offset[lo] : offset[hi]].decode("utf-8", "ignore")

        def fits(hi: int) -> bool:
            """By the tokens of the piece's own text too, which differ where it begins amid a word."""
            return (clean[start] and clean[hi]) or len(self.e.encode(text_of(start, hi))) <= self.limit

        while True:
            if n - start <= self.limit and fits(n):
                out.append((start, n, "end", text_of(start, n)))
                return out
            lo, hi = np.searchsorted(places, start + self.overlap, "right"), np.searchsorted(places, min(start + self.limit, n - 1), "right")
            can = np.arange(hi - 1, lo - 1, -1)
            ends_at = places[can]
            tidy = can[clean[ends_at - self.overlap] & (ends_at - start >= self.limit // 2)]
            legible = can[whole[ends_at - self.overlap]]
            chosen = next(((int(places[k]), units[k][1]) for some in (tidy, legible) for k in some if fits(int(places[k]))), None)
            if chosen is None:
                # between characters at both ends of the overlap; where these never meet (characters of three tokens), at its
                # end alone; then anywhere.  The shortest piece that goes on has overlap + 1 tokens.
                every = range(min(start + self.limit, n - 1), start + self.overlap, -1)
                pools = ([t for t in every if whole[t] and whole[t - self.overlap]], [t for t in every if whole[t]], every)
                end = next((t for pool in pools for t in pool if fits(t)), every[-1])
                chosen = (end, "character")
            out.append((start, chosen[0], chosen[1], text_of(start, chosen[0])))
            start = chosen[0] - self.overlap


def split_long(texts: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, piece, token_from, token_to, boundary, text)``: the pieces of each text of more than ``limit`` tokens.

    Pieces are numbered from 0; token places are those of the whole text, so a piece begins ``overlap`` tokens
    before the end of the one before it.  ``boundary`` names the kind of place where it ends.  Texts within
    the limit, null and empty ones give no rows; a key that comes twice gives its pieces twice.  Where a text
    has no boundary (a word of thousands of tokens) it is cut between characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Splitter(encoder(vocabulary), limit, overlap)
        for b in batches:
            for k, t in zip(b["_key"].to_pylist(), b["_text"].to_pylist(), strict=True):
                if found := s.pieces(t):
                    first, last, kind, own = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(found), b["_key"].type), pa.array(range(len(found)), pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(kind), pa.array(own)],
                        [key, "piece", "token_from", "token_to", "boundary", "text"],
                    )

    ship(texts.sparkSession, vocabulary)
    # a token has at least one byte: shorter texts can't exceed the limit
    source = texts.filter(F.octet_length(text) > limit).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return source.mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, piece int, token_from int, token_to int, boundary string, text string")
