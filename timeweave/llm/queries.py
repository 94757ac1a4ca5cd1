"""Importing this module registers every query of the folder."""

from timeweave.llm import byte_bpe, decontamination, fill_in_middle, hard_negatives, html_text, language_id, metric_search, near_duplicates, reply_trees, secrets, sentence_pieces, substring_dedup, url_rules  # noqa: F401
from timeweave.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
