"""Metric service responses as rows: instant vectors and range matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.text import parse_finite

_RESPONSE = "status string, errorType string, error string, data struct<resultType:string, result:string>"
_VECTOR = "array<struct<metric:map<string,string>, value:array<string>>>"
_MATRIX = "array<struct<metric:map<string,string>, values:array<array<string>>>>"


def _time(seconds: Column) -> Column:
    return F.timestamp_millis(F.round(seconds.try_cast("double") * 1000).cast("long"))


def instant_values(responses: DataFrame, body: str = "body") -> DataFrame:
    """Beside all columns of ``responses``: ``value``, or ``fault`` that says why there is none.

    A response must be a success and hold exactly one series (a vector of
    one, or a scalar) with a finite number.
    """
    parsed = F.from_json(F.col(body), _RESPONSE)
    rows = responses.withColumn("response", parsed)
    kind, raw = F.col("response.data.resultType"), F.col("response.data.result")
    vector = F.from_json(raw, _VECTOR)
    text = F.when(kind == "vector", F.get(F.get(vector, F.lit(0))["value"], F.lit(1))).when(kind == "scalar", F.get(F.from_json(raw, "array<string>"), F.lit(1)))
    fault = (
        F.when(F.coalesce(F.col("response.status"), F.lit("")) != "success", F.lit("not_successful"))
        .when(~F.coalesce(kind.isin("vector", "scalar"), F.lit(False)), F.lit("unsupported_type"))
        .when((kind == "vector") & (F.coalesce(F.size(vector), F.lit(0)) != 1), F.lit("not_one_series"))
        .when(parse_finite(text).isNull(), F.lit("not_finite"))
    )
    return rows.withColumn("fault", fault).withColumn("value", F.when(fault.isNull(), parse_finite(text))).drop("response")


def range_values(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row (observed_at, value) per point of each response's only series, beside its other columns; none for a faulty one."""
    response = F.from_json(F.col(body), _RESPONSE)
    matrix = F.when((response["status"] == "success") & (response["data"]["resultType"] == "matrix"), F.from_json(response["data"]["result"], _MATRIX))
    rows = responses.withColumn("matrix", matrix).where(F.size("matrix") == 1)
    points = rows.withColumn("point", F.explode(F.get("matrix", F.lit(0))["values"])).drop("matrix", body)
    out = points.withColumn("observed_at", _time(F.get("point", F.lit(0)))).withColumn("value", parse_finite(F.get("point", F.lit(1)))).drop("point")
    return out.where(F.col("observed_at").isNotNull() & F.col("value").isNotNull())


class _Part(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        from tidemark.operators.repair import chunks

        start, end, step = (int(self.options[k]) for k in ("start", "end", "step"))
        return [_Part(a, b) for a, b in chunks(start, end, step, int(self.options.get("points", "10000")))]

    def read(self, partition):
        import json
        import urllib.parse
        import urllib.request

        query = urllib.parse.urlencode({"query": self.options["query"], "start": partition.first, "end": partition.last, "step": self.options["step"]})
        address = f"{self.options['address'].rstrip('/')}/api/v1/query_range?{query}"
        with urllib.request.urlopen(address, timeout=float(self.options.get("timeout", "15"))) as answer:
            body = json.load(answer)
        if body.get("status") != "success" or len(body["data"]["result"]) > 1:
            raise ValueError("the range response is no success or holds several series")
        for series in body["data"]["result"]:
            for at, value in series["values"]:
                yield (float(at), str(value))


class MetricRange(DataSource):
    """``spark.read.format("metric_range")``: a range query over HTTP, a partition for each chunk of steps."""

    @classmethod
    def name(cls) -> str:
        return "metric_range"

    def schema(self) -> str:
        return "seconds double, value string"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(dict(self.options))
