"""All queries of this package: importing it fills QUERIES and ORACLES."""

from sparktab.llm import (bpe, centroids, chat, decontaminate, html, langid, mixing, neardup, pii, ppm, quality, repair,  # noqa: F401
                          sharding)
from sparktab.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
