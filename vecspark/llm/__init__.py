"""Operators of a training-data pipeline. Nothing outside this subpackage imports it, but for the entry's guard."""

from vecspark.llm.registry import ORACLE, QUERIES  # noqa: F401
from vecspark.llm import alignment, decontaminate, langid, licenses, mixing, quality, resampling, secret_scan, sharding, simhash, substring_dedup, suffix_dedup, unigram  # noqa: F401  (registration)
