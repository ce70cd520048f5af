"""A data source in Python: the days of a range, made slice by slice."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def calendar_source() -> type[DataSource]:
    """The source's class, made here so that it travels to the workers that
    plan and read as a value, without this package there."""

    class CalendarReader(DataSourceReader):
        def __init__(self, options):
            self.start = datetime.date.fromisoformat(options["start"])
            self.days = (datetime.date.fromisoformat(options["stop"]) - self.start).days + 1
            self.slices = max(1, int(options.get("slices", "1")))

        def partitions(self) -> list[InputPartition]:
            cuts = [self.days * i // self.slices for i in range(self.slices + 1)]
            return [InputPartition(p) for p in zip(cuts, cuts[1:])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for i in range(*partition.value):
                yield (self.start + datetime.timedelta(days=i),)

    class CalendarSource(DataSource):
        """Options: start, stop (ISO dates, both included), slices."""

        @classmethod
        def name(cls) -> str:
            return "calendar"

        def schema(self) -> str:
            return "day date"

        def reader(self, schema) -> DataSourceReader:
            return CalendarReader(self.options)

    return CalendarSource
