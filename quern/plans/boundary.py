"""The boundary to an external model: requests out, responses in, by key. No network here."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.stage import expect

TRIES, BASE, LONGEST, JITTER, RETRYABLE = 6, 2.0, 60.0, 0.25, frozenset({429, 503})


class ModelError(RuntimeError):
    def __init__(self, code: int):
        super().__init__(f"model error {code}")
        self.code = code


def waits(tries: int = TRIES, draw: Callable[[], float] = random.random) -> Iterator[float]:
    """Seconds before each further try: doubling up to the longest, with jitter."""
    for k in range(tries - 1):
        yield min(LONGEST, BASE * 2**k) * (1 + JITTER * draw())


def call(model: Callable[[list], list], batch: list, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random) -> list:
    """model(batch), tried again after errors that may pass; any other error is raised at once."""
    pauses = waits(draw=draw)
    while True:
        try:
            return model(batch)
        except ModelError as e:
            pause = next(pauses, None)
            if e.code not in RETRYABLE or pause is None:
                raise
            sleep(pause)


def matched(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """requests with their responses' columns; using it fails if a response is missing, unexpected or blank."""
    got = responses.select(F.col(key).alias("_key"), *(c for c in responses.columns if c != key))
    both = requests.join(got, F.col(key) == F.col("_key"), "full_outer")
    return expect(both, F.col(key).isNotNull() & F.col("_key").isNotNull(), "responses don't match requests").drop("_key")
