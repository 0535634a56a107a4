"""Queries over the benchmark tables, by topic."""

from importlib import import_module

TOPICS = ["season", "listings", "stats", "geo", "pages", "places", "model", "streams", "scoring"]


def load_all():
    from staygauge.workloads import registry

    for topic in TOPICS:
        import_module(f"staygauge.workloads.{topic}")
    return registry.QUERIES, registry.SQL
