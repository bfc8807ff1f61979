"""Unit vectors of texts by an encoder that each worker loads once; vectors are those of the first token."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From (input_ids, attention_mask) of a batch, both int64 of one shape, to hidden states (batch, tokens, width).
Encoder = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: From texts to lists of token ids.
Tokenize = Callable[[list[str]], list[list[int]]]
#: Fixed value: texts in a batch.
BATCH = 8
FILES = ("model.onnx", "tokenizer.json")


def encode_batch(texts: list[str], tokenize: Tokenize, encoder: Encoder) -> np.ndarray:
    """Texts padded with 0 at the right, encoded, and the first token's states as unit vectors; a zero vector stays zero."""
    ids = tokenize(texts)
    shape = (len(ids), max(1, max(map(len, ids))))
    input_ids, mask = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for k, row in enumerate(ids):
        input_ids[k, : len(row)], mask[k, : len(row)] = row, 1
    first = np.asarray(encoder(input_ids, mask), np.float64)[:, 0, :]
    norms = np.linalg.norm(first, axis=1, keepdims=True)
    return (first / np.where(norms == 0, 1, norms)).astype(np.float32)


def onnx_model(folder: str) -> Callable[[], tuple[Tokenize, Encoder]]:
    """A loader of the model in a folder that all workers see; FileNotFoundError at once if a file is missing, so that no job starts."""
    missing = [f for f in FILES if not os.path.isfile(os.path.join(folder, f))]
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")

    def load() -> tuple[Tokenize, Encoder]:
        import onnxruntime
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(os.path.join(folder, FILES[1]))
        session = onnxruntime.InferenceSession(os.path.join(folder, FILES[0]), providers=["CPUExecutionProvider"])
        wanted = {i.name for i in session.get_inputs()}

        def encoder(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            return session.run(None, {k: v for k, v in given.items() if k in wanted})[0]

        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts)], encoder

    return load


def embed(texts: DataFrame, load: Callable[[], tuple[Tokenize, Encoder]], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, v): the vector of each text; null texts have a null one and aren't encoded. `load` runs once a task, on the worker."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenize, encoder = load()
        for f in frames:
            out: list = [None] * len(f)
            known = [(k, t) for k, t in enumerate(f[text_col]) if isinstance(t, str)]
            for at in range(0, len(known), BATCH):
                some = known[at : at + BATCH]
                for (k, _), v in zip(some, encode_batch([t for _, t in some], tokenize, encoder)):
                    out[k] = v
            yield pd.DataFrame({id_col: f[id_col], "v": out})

    return texts.select(F.col(id_col), F.col(text_col)).mapInPandas(run, f"{id_col} {kind}, v array<float>")
