"""The seam to an external detector: one call a row, retried, behind mapInPandas; failures become data."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

RESULT = "row_index long, response string, attempts int, error string"


class Retry(Exception):
    """A failure worth another try; `after` may hold the seconds that the service asked for."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


def call_detector(rows: DataFrame, call: Callable[[int, str], str], retries: int = 2, base_s: float = 0.5, per_minute: float | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(row_index, response, attempts, error) of call(row_index, text) for each row.

    Retry is tried again up to `retries` times with doubled pauses; any other
    exception is the row's error. A task that runs again calls again, so the
    call must be repeatable. With per_minute the rows go through one task, as
    one caller has one allowance.
    """

    def run(batches):
        import pandas as pd

        last = 0.0
        for batch in batches:
            out = []
            for index, text in zip(batch["row_index"], batch["text"], strict=True):
                attempt, response, error = 0, None, None
                while True:
                    attempt += 1
                    if per_minute:
                        sleep(max(0.0, last + 60 / per_minute - time.monotonic()))
                        last = time.monotonic()
                    try:
                        response, error = call(int(index), text or ""), None
                        break
                    except Retry as e:
                        error = str(e)
                        if attempt > retries:
                            break
                        sleep(e.after if e.after is not None else base_s * 2 ** (attempt - 1))
                    except Exception as e:
                        error = str(e)
                        break
                out.append((index, response, attempt, error))
            yield pd.DataFrame(out, columns=["row_index", "response", "attempts", "error"])

    chosen = rows.select("row_index", "text")
    return (chosen.repartition(1) if per_minute else chosen).mapInPandas(run, RESULT)
