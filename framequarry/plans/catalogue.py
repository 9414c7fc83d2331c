"""All queries of the library by name, and their SQL oracles."""

from __future__ import annotations

from . import job_queries, mask_queries, pixel_queries, rule_queries, service_queries, flow_queries, format_queries, scene_queries, address_queries, image_queries  # noqa: F401, I001  (they register their queries; the last reuses SQL of the first)
from .registry import ORACLES, QUERIES  # noqa: F401
