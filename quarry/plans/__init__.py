"""All registered plans."""

from quarry.plans import archive, cascade, dimensions, identities, lineage, measures, pixels, readings, reports, resolution  # noqa: F401
from quarry.plans.catalog import QUERIES, SQL  # noqa: F401
