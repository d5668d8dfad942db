"""Queries: each module binds operators to tables in a registry R."""

#: The modules whose registries make up the queries of the core.
MODULES = ["ledgerspark.plans.integrity", "ledgerspark.plans.names", "ledgerspark.plans.metadata", "ledgerspark.plans.sequences", "ledgerspark.plans.graphs", "ledgerspark.plans.streams", "ledgerspark.plans.records", "ledgerspark.plans.commits"]
