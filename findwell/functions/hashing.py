"""Hash tokens and the deterministic stand-in embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from findwell.functions.text import col

# Fixed values of the hash tokenizer.
START, STOP, VOCABULARY, FACTOR = 101, 102, 30_000, 31


def hash_strings(texts: list[str]) -> np.ndarray:
    """Polynomials of the code points in wrapping 64-bit arithmetic, as absolute values (the least number stays)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    back = np.repeat(ends, lengths) - np.arange(len(codes)) - 1  # places from the end of its text
    powers = np.full(int(lengths.max(initial=0)) + 1, FACTOR, dtype=np.uint64)
    powers[0] = 1
    parts = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * np.cumprod(powers, dtype=np.uint64)[back], dtype=np.uint64)])
    h = (parts[ends] - parts[ends - lengths]).view(np.int64)
    return np.where(h == np.iinfo(np.int64).min, h, np.abs(h))


def hash_string(text: str) -> int:
    return int(hash_strings([text])[0])


def token_ids(text: str, most: int) -> list[int]:
    """Ids of the words between a start and a stop id, padded with zeros to ``most``."""
    parts = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
    words = hash_strings(parts[: max(0, most - 2)])
    ids = [START, *np.fmod(words, VOCABULARY).tolist(), STOP][:most]
    return ids + [0] * (most - len(ids))


def mock_vector(text: str, dimensions: int) -> np.ndarray:
    """A unit vector that depends on the text alone: sines of multiples of its hash."""
    with np.errstate(over="ignore"):
        steps = np.array([hash_string(text)], dtype=np.int64) * np.arange(1, dimensions + 1, dtype=np.int64)
    v = (np.sin(steps.astype(np.float64)) * 0.1 + 0.01).astype(np.float32)
    norm = np.sqrt(np.float32((v * v).sum()))
    return v / norm if norm > 0 else v


@arrow_udf(LongType())
def _hash(text: pa.Array) -> pa.Array:
    known = text.drop_null()
    found = iter(hash_strings(known.to_pylist()).tolist())
    return pa.array([next(found) if valid else None for valid in text.is_valid().to_pylist()], pa.int64())


def string_hash(text) -> Column:
    return _hash(col(text))


def tokenized(text, most: int = 256) -> Column:
    """struct<ids, mask> of a text; the mask is 1 where an id belongs to the text. Null counts as empty."""

    @arrow_udf("array<bigint>")
    def ids(t: pa.Array) -> pa.Array:
        return pa.array([token_ids(x or "", most) for x in t.to_pylist()], pa.list_(pa.int64()))

    found = ids(col(text))
    return F.struct(found.alias("ids"), F.transform(found, lambda i: F.when(i != 0, 1).otherwise(0)).alias("mask"))


class MockEmbedder:
    """Embeds texts without a model."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def vectors(self, texts: list[str]) -> list[np.ndarray]:
        """The vectors of a few texts, here."""
        return [mock_vector(t, self.dimensions) for t in texts]

    def embed(self, text) -> Column:
        dimensions = self.dimensions

        @arrow_udf("array<float>")
        def run(t: pa.Array) -> pa.Array:
            return pa.array([None if x is None else mock_vector(x, dimensions) for x in t.to_pylist()], pa.list_(pa.float32()))

        return run(col(text))
