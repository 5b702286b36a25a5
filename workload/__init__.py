"""Queries over the given tables, one or more per operator, each with its SQL counterpart."""


def registry():
    from workload import ingest, structured, taxonomies, text

    found = {}
    for module in (structured, text, taxonomies, ingest):
        found.update(module.QUERIES)
    return found
