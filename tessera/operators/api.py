"""Endpoints of code and of documents, the calls that reach them, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import route_links
from tessera.sources.tables import written


def held(endpoints: DataFrame) -> DataFrame:
    """Endpoints (id, method, path, framework) without the documented ones ('openapi') that code answers under the same
    verb and path."""
    code = endpoints.where("framework <> 'openapi'").select("method", "path").distinct().withColumn("answered", F.lit(True))
    rows = endpoints.join(code, ["method", "path"], "left")
    return rows.where("framework <> 'openapi' or answered is null").select(*endpoints.columns)


def joined(endpoints: DataFrame, clients: DataFrame, hosts: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, totals): links of clients (id, method, path, host, framework) to what is held of the endpoints, and one row of
    totals (endpoints, described, clients, linked, outside, frameworks)."""
    kept = written(held(endpoints))
    links = written(route_links(clients, kept, hosts))
    ends = kept.agg(F.count("*").alias("endpoints"))
    every = endpoints.agg(F.count("*").alias("every"))
    asked = clients.agg(F.count("*").alias("clients"))
    met = links.agg(F.countDistinct("client").alias("linked"))
    names = kept.select("framework").unionByName(clients.select("framework")).distinct().agg(F.array_join(F.sort_array(F.collect_set("framework")), ",").alias("frameworks"))
    total = ends.join(F.broadcast(every)).join(F.broadcast(asked)).join(F.broadcast(met)).join(F.broadcast(names))  # one row each
    out = total.select("endpoints", (F.col("every") - F.col("endpoints")).alias("described"), "clients", "linked", (F.col("clients") - F.col("linked")).alias("outside"), "frameworks")
    return links, out


def by_calls(endpoints: DataFrame, links: DataFrame) -> DataFrame:
    """Endpoints (id, path, ...) with their calls, most called first, then by path and id."""
    n = links.groupBy(F.col("endpoint").alias("id")).agg(F.count("*").alias("calls"))
    return endpoints.join(n, "id", "left").na.fill(0, ["calls"]).orderBy(F.desc("calls"), "path", "id")
