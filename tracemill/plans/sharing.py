"""What several of the asked analyses use, told before any of them reads a row."""

from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tracemill.sources.schemas import MACHINE_EVENTS, Table
from tracemill.sources.trace import Trace


class _NoRows(Trace):
    """A trace of empty tables that notes which shared results and whether machine events are asked for."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self.asked: set[str] = set()
        self._made: dict[str, DataFrame] = {}

    def _table(self, table: Table) -> DataFrame:
        return self.spark.createDataFrame([], table.schema)

    @property
    def machine_events(self) -> DataFrame:
        self.asked.add(MACHINE_EVENTS.name)
        return self._table(MACHINE_EVENTS)

    @property
    def machine_attributes(self) -> DataFrame:
        return self.spark.createDataFrame([], "line string")

    def shared(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        self.asked.add(name)
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]


def used_by_several(spark: SparkSession, analyses: Iterable[Callable[[Trace], DataFrame]]) -> set[str]:
    """Names of the results, ``machine_events`` among them, that at least two of ``analyses`` use.

    Each analysis is built once over empty tables. One that needs a shared result only through another
    counts as no user of what that is made from, as it is then kept itself.
    """
    probe, users = _NoRows(spark), Counter()
    for analysis in analyses:
        probe.asked = set()
        analysis(probe)
        users.update(probe.asked)
    return {name for name, n in users.items() if n > 1}
