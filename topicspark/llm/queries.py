"""Imports every module that registers a query."""

from topicspark.llm import (bpe, convnet, fingerprints, htmltext, licences, neardup, packing, quality_rules, repeats, runs,  # noqa: F401
                            secrets, urls, whitening)
from topicspark.llm.registry import ORACLES, QUERIES  # noqa: F401
