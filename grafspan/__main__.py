"""``python -m grafspan VERB ...``: one command line over the API; results are JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import api
from .graph import Store, single_writer
from .operators import aggregates, lookups
from .operators.analytics import enveloped

READS = {
    "search": lambda i, a: i.search(a.what, limit=a.limit, offset=a.offset, detail=a.detail),
    "resolve": lambda i, a: i.resolve(a.what),
    "describe": lambda i, a: i.describe(a.what),
    "callers": lambda i, a: i.callers(a.what, a.depth, a.limit),
    "callees": lambda i, a: i.callees(a.what, a.depth, a.limit),
    "impact": lambda i, a: i.impact(a.what, a.depth, a.limit),
    "decompose": lambda i, a: i.decompose(a.what, a.depth),
    "flow": lambda i, a: i.flow(a.what, a.depth, a.limit),
    "overview": lambda i, a: i.overview(a.what),
    "implementations": lambda i, a: enveloped(lookups.implementors(i.graph, a.what, limit=a.limit + 1), a.limit),
    "subclasses": lambda i, a: enveloped(lookups.subclasses(i.graph, a.what, limit=a.limit + 1), a.limit),
    "overrides": lambda i, a: enveloped(lookups.overrides(i.graph, a.what, limit=a.limit + 1), a.limit),
    "overridden-by": lambda i, a: enveloped(lookups.overridden_by(i.graph, a.what, limit=a.limit + 1), a.limit),
    "dependents": lambda i, a: enveloped(lookups.injectors(i.graph, a.what, limit=a.limit + 1), a.limit),
    "dependencies": lambda i, a: enveloped(lookups.dependencies(i.graph, a.what, limit=a.limit + 1), a.limit),
    "hierarchy": lambda i, a: enveloped(lookups.hierarchy(i.graph, a.what, a.limit + 1), a.limit),
    "outline": lambda i, a: enveloped(lookups.outline(i.graph, a.what), a.limit),
    "listeners": lambda i, a: enveloped(lookups.listeners(i.graph, a.what or None, a.limit + 1), a.limit),
    "topics": lambda i, a: enveloped(aggregates.topics(i.graph), a.limit),
    "routes": lambda i, a: enveloped(lookups.routes(i.graph, server_exposed=True, limit=a.limit + 1), a.limit),
    "clients": lambda i, a: enveloped(lookups.clients(i.graph, limit=a.limit + 1), a.limit),
    "producers": lambda i, a: enveloped(lookups.producers(i.graph, limit=a.limit + 1), a.limit),
    "jobs": lambda i, a: enveloped(lookups.by_capability(i.graph, "SCHEDULED_TASK", limit=a.limit + 1), a.limit),
    "entities": lambda i, a: enveloped(lookups.by_role(i.graph, "ENTITY", limit=a.limit + 1), a.limit),
    "map": lambda i, a: enveloped(aggregates.map_of(i.graph), a.limit),
    "conventions": lambda i, a: enveloped(aggregates.conventions(i.graph), a.limit),
    "microservices": lambda i, a: enveloped(aggregates.scope_counts(i.graph, "microservice"), a.limit),
    "unresolved": lambda i, a: enveloped(lookups.unresolved_sites(i.graph, limit=a.limit + 1), a.limit),
    "unresolved-stats": lambda i, a: enveloped(aggregates.unresolved_stats(i.graph, a.what or "reason"), a.limit),
    "status": lambda i, a: i.status(),
    "review": lambda i, a: i.review(sys.stdin.read() if a.what in ("", "-") else open(a.what).read()),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="grafspan")
    p.add_argument("verb", choices=["init", "increment", "reprocess", "meta", "erase", *READS])
    p.add_argument("what", nargs="?", default="")
    p.add_argument("--index", required=True)
    p.add_argument("--scope")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--depth", type=int, default=2)
    p.add_argument("--detail", default="normal", choices=list(api.DETAIL))
    p.add_argument("--yes", action="store_true")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("grafspan").getOrCreate()
    if a.verb in ("init", "increment", "reprocess"):
        with single_writer(a.index):
            print(json.dumps({"status": "ok", "result": getattr(api, a.verb)(spark, a.what, a.index)}))
        return 0
    if a.verb == "meta":
        print(json.dumps(Store(spark, a.index).meta()))
        return 0
    if a.verb == "erase":
        Store(spark, a.index).erase(a.yes)
        return 0
    out = READS[a.verb](api.Index.open(spark, a.index, a.scope), a)
    print(json.dumps(out.to_dict(), default=str))
    return 0 if out.rows else 1


if __name__ == "__main__":
    sys.exit(main())
