"""Importing this module fills the catalogue, section by section."""

from tidemark.plans import aggregates, associations, contract_checks, joining, monthly, provenance, ranking, resampling, scans, texts  # noqa: F401
from tidemark.plans.registry import CATALOG  # noqa: F401
