"""All registered queries; importing a catalog module registers its queries."""

from spendlens.plans import catalog_attribution, catalog_audience, catalog_ingest, catalog_metrics, catalog_scoring, catalog_streaming  # noqa: F401
from spendlens.plans.registry import ORACLE, QUERIES  # noqa: F401
