"""An evaluation run: samples, replies and their scores as one table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from textrec.operators.inference import Backend, complete_prompts


def evaluate(
    samples: DataFrame,
    backend: str,
    backends: Mapping[str, Backend],
    scorer: Callable[[DataFrame], DataFrame],
    **options,
) -> DataFrame:
    """Ask for a reply to every sample's input and score it."""
    return scorer(complete_prompts(samples, backend, backends, prompt_col="input", **options))
