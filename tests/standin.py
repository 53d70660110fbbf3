"""A stand-in for a broker's source: it takes Kafka's options, has four messages, and starts as these say."""

import json

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class StandIn(DataSource):
    @classmethod
    def name(cls):
        return "standin"

    def schema(self):
        return "key binary, value binary, topic string, partition int, offset long"

    def streamReader(self, schema):  # noqa: N802
        return Reader(self.options)


class Reader(DataSourceStreamReader):
    def __init__(self, options):
        assert options["kafka.bootstrap.servers"] == "host:9092" and options["kafka.group.id"] == "group"
        self.topic, self.begin = options["subscribe"], 0 if options["startingOffsets"] == "earliest" else 2

    def initialOffset(self):  # noqa: N802
        return {"offset": self.begin}

    def latestOffset(self):  # noqa: N802
        return {"offset": 4}

    def partitions(self, start, end):
        return [InputPartition(k) for k in range(start["offset"], end["offset"])]

    def read(self, partition):
        k = partition.value
        yield (None, json.dumps({"payload": {"id": k, "name": f"n{k}"}}).encode(), self.topic, 0, k)

    def commit(self, end):
        pass
