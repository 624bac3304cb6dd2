"""Named queries on the driver tables, each with DuckDB SQL where SQL can say the same."""

from billscope.queries import (  # noqa: F401
    aggregates,
    chains,
    enrichment,
    histories,
    learning,
    rowwise,
    scalars,
    sources,
    textual,
)
from billscope.queries.registry import ORACLES, QUERIES  # noqa: F401
