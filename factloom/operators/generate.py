"""Text generation as a hook: a backend gets prompts in Arrow batches and returns texts with log probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Backend = Callable[[list[list[dict[str, str]]]], list[tuple[str, float | None]]]
#: How soft vectors stand beside the table's text.
VARIANTS = ("replacement", "augmentation", "random")
# How a rate-limited service is asked again.
RETRY_ON, RETRIES, MAX_WAIT = (429, 500, 502, 503), 6, 60.0


def wait_before(attempt: int, retry_after: float | None) -> float:
    """Seconds to wait before the next attempt."""
    return min(retry_after if retry_after is not None else 2.0**attempt, MAX_WAIT)


def generate(messages: DataFrame, make: Callable[[], Backend]) -> DataFrame:
    """(ex_id, messages) to (id, output, seq_logprob). ``make()`` runs once per task, so a model loads once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for b in batches:
            found = backend([[dict(m) if isinstance(m, dict) else m.asDict() for m in ms] for ms in b["messages"]])
            yield pd.DataFrame({"id": b["ex_id"], "output": [t for t, _ in found], "seq_logprob": [p for _, p in found]})

    return messages.mapInPandas(run, "id string, output string, seq_logprob double")


def stub_backend() -> Backend:
    """Returns the first line of the table part of each prompt; stands in for a model in tests."""
    return lambda prompts: [(p[-1]["content"].split("\n\n")[1].split("\n")[0], -0.5) for p in prompts]
