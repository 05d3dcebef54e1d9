"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, jaccard, language, merkle, multiindex, packing, pii, quality, secrets, sharding, topk, urls, whitening  # noqa: F401
from .common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
