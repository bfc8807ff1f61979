"""Answers of a language model to prompts, by any callable; the default answers from the prompt alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

INVALID = "LLM_INVALID_RESPONSE"


def empty_plan(prompt: str) -> str:
    """The plan without sections, whatever the prompt."""
    return '{"sections": [], "consumables": []}'


def complete(prompts: DataFrame, answer: Callable[[str], str] = empty_plan, id_col: str = "id", prompt_col: str = "prompt") -> DataFrame:
    """(id, content, error): `answer` is called once a prompt on the executors, so it must stand being called again after a lost task.

    A blank or missing answer is LLM_INVALID_RESPONSE, an exception gives its name; null prompts aren't sent and are invalid."""
    kind = prompts.schema[id_col].dataType.simpleString()

    def one(prompt: str | None) -> tuple[str | None, str | None]:
        if not isinstance(prompt, str):
            return None, INVALID
        try:
            text = answer(prompt)
        except Exception as e:  # noqa: BLE001  the error is the row's result
            return None, type(e).__name__
        return (text, None) if text and text.strip() else (None, INVALID)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(p) for p in f[prompt_col]]
            yield pd.DataFrame({id_col: f[id_col], "content": [c for c, _ in got], "error": [e for _, e in got]})

    return prompts.select(id_col, prompt_col).mapInPandas(run, f"{id_col} {kind}, content string, error string")
