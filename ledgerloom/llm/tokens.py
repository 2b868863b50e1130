"""Encoding with a public byte-level BPE vocabulary by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can't be bridged by any merge: between the two
bytes a cut is certain.  Long texts are cut there into fragments, these are encoded one by one,
and the ids put together equal those of the whole text.  A cut must also leave the pattern that splits texts
before merging undisturbed, which ``_pattern_safe`` decides from the characters beside it.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary lies on the driver's machine, and the pattern that splits text before its merges.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes after which a fragment ends at the next certain cut.
FRAGMENT = 256
#: White space of the pattern, which knows the Unicode property and none of the separators 1c to 1f.
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


def _kind(c: str) -> str:
    return "S" if c in SPACES else k if (k := unicodedata.category(c)[0]) in "LN" else "O"


def _pattern_safe(before: str, after: str) -> bool:
    """Whether the pattern splits the two sides alone as it splits them together.

    ``before``: the last four characters of the left side (fewer only at its start); ``after``: the right
    side's first character.  The pattern looks ahead only behind white space, and takes an
    apostrophe together with up to two letters.
    """
    if not before:
        return False
    left, right = _kind(before[-1]), _kind(after)
    if left == "S":
        return False
    if right == "S":
        return True
    if left == right == "L":
        return len(before) > 3 and all(_kind(c) == "L" for c in before[-3:])
    if left == right == "N":
        return True
    if left == right == "O":
        return before[-1] != "'" and after != "'"
    return before[-1] != "'"


class ForcedBoundaryEncoder:
    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.inside = np.zeros(1 << 16, bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8).astype(np.uint16)
            self.inside[(b[:-1] << 8) | b[1:]] = True
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def certain_cuts(self, data: bytes) -> np.ndarray:
        """Offsets before which a cut is certain by the byte pairs alone."""
        b = np.frombuffer(data, np.uint8)
        return np.flatnonzero(~self.inside[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1

    def fragments(self, text: str, size: int = FRAGMENT) -> Iterator[str]:
        """The text in pieces of some ``size`` bytes, cut at certain places only; more where there are none."""
        data = text.encode("utf-8", "replace")
        cuts, start = self.certain_cuts(data), 0
        k = 0
        while len(data) - start > size:
            k = int(np.searchsorted(cuts, start + size))
            while k < len(cuts):
                at = int(cuts[k])
                if data[at] & 0xC0 != 0x80:  # not within a character
                    before = data[max(start, at - 16) : at].decode("utf-8", "ignore")[-4:]
                    if _pattern_safe(before, data[at : at + 4].decode("utf-8", "ignore")[:1]):
                        break
                k += 1
            if k >= len(cuts):
                break
            yield data[start : int(cuts[k])].decode("utf-8", "replace")
            start = int(cuts[k])
        yield data[start:].decode("utf-8", "replace")

    def encode(self, text: str | None, size: int = FRAGMENT) -> np.ndarray:
        """The ids; none for a null or empty text. Lone surrogates count as U+FFFD."""
        if not text:
            return np.empty(0, np.int32)
        parts = [self.bpe.encode_to_numpy(f, disallowed_special=()) for f in self.fragments(text, size)]
        return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bpe.decode_bytes(ids.tolist())


@lru_cache(2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    """Read once in each worker process, from the copy sent with the job."""
    try:
        sent = SparkFiles.get(os.path.basename(path))
    except AssertionError:  # neither in a worker nor with a context
        sent = path
    return ForcedBoundaryEncoder(sent if os.path.exists(sent) else path)


def ship(spark: SparkSession, path: str) -> None:
    """Sends a vocabulary that lies on the driver's machine to the executors, once for each application."""
    if os.path.exists(path) and not any(f.rpartition("/")[2] == os.path.basename(path) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)


def token_ids(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, fragment: int = FRAGMENT) -> DataFrame:
    """``(key, ids array<int>)``: the ids of each text without special tokens, which are ordinary text here.

    Null and empty texts have the empty list.  Every row gives one row, repeated and null keys included; other
    columns aren't read.  No shuffle: texts are encoded where they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                ids = [e.encode(t, fragment) for t in part["_text"].to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part["_key"], pa.ListArray.from_arrays(pa.array(offsets), values)], [key, "ids"])

    ship(texts.sparkSession, vocabulary)
    source = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return source.mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, tokens int)``: the size of each text in tokens, 0 for null and empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            sizes = [len(e.encode(t)) for t in b["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["_key"], pa.array(sizes, pa.int32())], [key, "tokens"])

    ship(texts.sparkSession, vocabulary)
    source = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return source.mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, tokens int")
