"""All registered queries. Importing the catalogs fills the registry."""

from reefpulse.plans import catalog_bins, catalog_clean, catalog_lunar, catalog_shape, catalog_tests  # noqa: F401
from reefpulse.plans.registry import LATER, ORACLES, QUERIES

ORACLES.update({name: sql() for name, sql in LATER.items()})
