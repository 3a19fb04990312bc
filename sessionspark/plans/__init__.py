from . import queries, records, stores  # noqa: F401  records and stores add to the queries of queries
