"""Cleaning, checking and embedding of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is cut or filtered from a question.
MAX_QUERY_LENGTH = 2000
INJECTIONS = (
    r"(?i)\n\s*(System|Human|Assistant)\s*:",
    r"(?i)ignore\s+(all\s+)?previous\s+instructions",
    r"(?i)you\s+are\s+now\s+(a|an)\b",
    r"(?i)disregard\s+(all\s+)?(prior|above|previous)",
    r"(?i)forget\s+(everything|all|your)\s+(instructions|rules|guidelines)",
    r"(?i)<\s*/?\s*(system|prompt|instruction)\s*>",
)
DEGENERATE_CHARS, BLOCK_CHARS, LEAST_BLOCKS, UNIQUE_SHARE = 4000, 200, 3, 0.4


def sanitize_queries(query: Column) -> Column:
    """At most 2000 characters, instructions to the model replaced by [filtered], trimmed."""
    out = F.substring(query, 1, MAX_QUERY_LENGTH)
    for pattern in INJECTIONS:
        out = F.regexp_replace(out, pattern, "[filtered]")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def flag_degenerate_text(text: Column) -> Column:
    """True for a long text most of whose blocks of 200 characters repeat."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / F.lit(BLOCK_CHARS)).cast("int") - 1, F.lit(0)))
    blocks = F.transform(starts, lambda i: F.substring(text, i * BLOCK_CHARS + 1, F.lit(BLOCK_CHARS)))
    return F.coalesce((n >= DEGENERATE_CHARS) & (F.size(blocks) >= LEAST_BLOCKS) & (F.size(F.array_distinct(blocks)) / F.size(blocks) < UNIQUE_SHARE), F.lit(False))


def parse_window(window: Column, default_seconds: int = 5 * 3600) -> Column:
    """Seconds of '30m', '5h' or '2d'; the default for anything else or nothing."""
    text = F.lower(F.trim(window))
    n = F.regexp_extract(text, r"^(\d+)([mhd])$", 1).try_cast("long")
    unit = F.regexp_extract(text, r"^(\d+)([mhd])$", 2)
    seconds = n * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when(seconds > 0, seconds).otherwise(default_seconds)


class Embedder(Protocol):
    """A backend: ``embed`` turns a list of texts into as many vectors of ``dim`` numbers."""

    name: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed counts of lower-case words, hashed by the first 32 bits of MD5, scaled to length one: no model file, the same
    everywhere."""

    name = "hashing"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.matrix(pa.array(texts, pa.string())).tolist()

    def matrix(self, texts: pa.Array) -> np.ndarray:
        """Vectors of a batch: words are split and counted over its buffers, and only different ones are hashed."""
        words = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\pL\pN]+")
        row = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        h = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") for w in coded.dictionary.to_pylist()], np.int64)
        sign = np.where(h >> 31, 1.0, -1.0) * np.array([bool(w) for w in coded.dictionary.to_pylist()], float)
        code = coded.indices.to_numpy(zero_copy_only=False)
        out = np.bincount(row * self.dim + h[code] % self.dim, sign[code], len(texts) * self.dim).reshape(len(texts), self.dim) if len(code) else np.zeros((len(texts), self.dim))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed_texts(df: DataFrame, column: str, embedder: Embedder | None = None, to: str = "embedding") -> DataFrame:
    """``df`` with a vector for each text, in batches; a backend loads once per task. Null counts as empty."""
    backend = embedder or HashingEmbedder()

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = pc.fill_null(texts, "")
            if hasattr(backend, "matrix"):
                flat = backend.matrix(texts).astype(np.float32)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            else:
                yield pa.array(backend.embed(texts.to_pylist()), pa.list_(pa.float32()))

    return df.withColumn(to, vectors(F.col(column)))
