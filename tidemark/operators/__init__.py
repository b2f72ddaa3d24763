"""DataFrame operators: schema, filters, expansion, joins, aggregates, windows, merges, quality."""
from . import aggregate, enrich, expand, filters, joins, merge, quality, schema, window  # noqa: F401
