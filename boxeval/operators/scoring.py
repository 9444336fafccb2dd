"""Batch scoring with a pinned model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_READY: dict[str, object] = {}


class IntegrityError(RuntimeError):
    """The model's bytes are not the pinned ones."""


def _ready(pin: str, load: Callable[[], bytes], build: Callable[[bytes], object]) -> object:
    """The model of this Python worker; a failed load is not kept, so a retry loads again."""
    if pin not in _READY:
        raw = load()
        found = hashlib.sha256(raw).hexdigest()
        if found != pin:
            raise IntegrityError(f"model hash mismatch: expected {pin}, got {found}")
        _READY[pin] = build(raw)
    return _READY[pin]


def score_batch(
    df: DataFrame,
    load: Callable[[], bytes],
    build: Callable[[bytes], object],
    predict: Callable[[object, pd.DataFrame], pd.DataFrame],
    pin: str,
    schema: str,
) -> DataFrame:
    """Score Arrow batches; each worker loads, checks and builds the model once."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(_ready(pin, load, build), batch)

    return df.mapInPandas(score, schema)
