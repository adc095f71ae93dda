"""Progress of a job's stages: seconds and errors, told to whoever listens and kept as rows for ``stage_report``."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Progress:
    """``listen`` is called with (stage, seconds or None, error or None) when a stage begins and when it ends.

    A stage that runs again adds to its seconds. Stages must write out what they make, as those of
    ``discover`` do, for a plan that is only declared takes no time.
    """

    def __init__(self, listen: Callable[[str, float | None, str | None], None] | None = None):
        self.listen = listen or (lambda *_: None)
        self.seconds: dict[str, float] = {}
        self.errors: dict[str, str] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        self.listen(name, None, None)
        began = time.monotonic()
        try:
            yield
        except Exception as error:
            self.errors[name] = str(error)
            raise
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began
            self.listen(name, self.seconds[name], self.errors.get(name))

    def rows(self, spark: SparkSession, query_id: int = 0) -> DataFrame:
        """(query_id, stage, seconds, error) so far."""
        return spark.createDataFrame([(query_id, n, s, self.errors.get(n)) for n, s in self.seconds.items()], "query_id long, stage string, seconds double, error string")
