"""All registered queries."""

from noticeworks.plans import analyses, documents, ingestion, matching  # noqa: F401
from noticeworks.plans.registry import ORACLES, QUERIES  # noqa: F401
