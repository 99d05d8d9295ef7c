"""Embedders: anything with ``dimensions`` and ``embed(text column) -> vector column``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from findwell.functions.hashing import MockEmbedder, token_ids
from findwell.functions.text import col

__all__ = ["Embedder", "MockEmbedder", "OnnxEmbedder"]


class Embedder(Protocol):
    dimensions: int

    def embed(self, text) -> Column: ...


class OnnxEmbedder:
    """A sentence model in an ONNX file that all executors can read.

    ``tokenize(text, most)`` gives the ids of a text, padded with zeros to ``most``. The model is
    loaded once per task and gets batches; token vectors are averaged over the text's own tokens
    and brought to unit length. A null text gives null.
    """

    def __init__(self, path: str, dimensions: int = 384, max_tokens: int = 256, tokenize=token_ids, batch: int = 64):
        self.path, self.dimensions, self.max_tokens, self.tokenize, self.batch = path, dimensions, max_tokens, tokenize, batch

    def pooled(self, session, ids: np.ndarray) -> np.ndarray:
        """Unit vectors of texts given as token ids."""
        mask = (ids != 0).astype(np.int64)
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        out = session.run(None, {i.name: given[i.name] for i in session.get_inputs()})[0]
        if out.ndim == 3:
            out = (out * mask[:, :, None]).sum(axis=1) / np.maximum(1, mask.sum(axis=1, keepdims=True))
        if out.shape[1] != self.dimensions:
            raise ValueError(f"the model gives {out.shape[1]} dimensions, not {self.dimensions}")
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32)

    def embed(self, text) -> Column:
        me = self

        @arrow_udf("array<float>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import onnxruntime

            session = onnxruntime.InferenceSession(me.path, providers=["CPUExecutionProvider"])
            for column in batches:
                texts = column.to_pylist()
                known = [i for i, t in enumerate(texts) if t is not None]
                found: list = [None] * len(texts)
                for at in range(0, len(known), me.batch):
                    part = known[at : at + me.batch]
                    for i, v in zip(part, me.pooled(session, np.array([me.tokenize(texts[k], me.max_tokens) for k in part], dtype=np.int64))):
                        found[i] = v
                yield pa.array(found, pa.list_(pa.float32()))

        return run(col(text))
