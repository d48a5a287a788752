"""Rules that change while a stream runs: read anew now and then, the same again in a replay."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import folders
from ..functions import pages

#: Seconds between two looks at the rules.
EVERY = 60
#: Batches whose rules stay on record.
REMEMBERED = 1000


class Refreshed:
    """The paywall rules of a JSON file, one version a batch.

    A new batch looks at the file if the last look is ``every`` seconds old. Its rules
    are put on record under ``ledger`` before it runs, so a batch that is run again takes the
    rules it had, whatever the file holds by then; of the last ``REMEMBERED`` batches
    at least. A missing, blank or all-invalid file means the default rules, bad JSON the ones before.
    """

    def __init__(self, spark: SparkSession, path: str, ledger: str, every: float = EVERY, clock: Callable[[], float] = time.monotonic):
        self.spark, self.path, self.ledger, self.every, self.clock = spark, path, ledger, every, clock
        self.looked: float | None = None
        self.current: list[dict] = pages.PAYWALL_RULES

    def _recorded(self) -> list[tuple[int, str]]:
        return folders.inside(self.spark, self.ledger, "batch")

    def _of(self, folder: str) -> list[dict] | None:
        text = folders.read_text(self.spark, f"{folder}/rules.json")
        return None if text is None else json.loads(text)

    def of_batch(self, number: int) -> list[dict]:
        """The rules of a batch."""
        known = self._recorded()
        if (folder := dict(known).get(number)) and (rules := self._of(folder)) is not None:
            return rules
        if self.looked is None:  # a stream that goes on begins with the rules it had
            for _, folder in reversed(known):
                if (rules := self._of(folder)) is not None:
                    self.current = rules
                    break
        if self.looked is None or self.clock() - self.looked >= self.every:
            self.current, self.looked = pages.rules_from_json(folders.read_text(self.spark, self.path), self.current), self.clock()
        name = f"{self.ledger}/batch={number:012d}"
        folders.remove(self.spark, name)  # a record that a crash has cut short
        folders.put_text(self.spark, f"{name}/rules.json", json.dumps(self.current))
        for n, folder in known:
            if n <= number - REMEMBERED:
                folders.remove(self.spark, folder)
        return self.current

    def sink(self, write: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch sink: ``write(batch, rules, number)`` with the batch's rules as a table, a row a domain."""
        return lambda batch, number: write(batch, pages.paywall_rules(batch.sparkSession, self.of_batch(number)), number)
