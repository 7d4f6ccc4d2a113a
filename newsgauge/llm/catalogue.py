"""The named queries of this subpackage. Each module registers its own."""

from newsgauge.llm.common import ORACLE, QUERIES
from newsgauge.llm import exact_dedup, impact_search, near_dup, packing, page_text, periodic_runs, personal_data, piece_codec, secret_scan, token_files, toxicity, url_rules, whitening  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
