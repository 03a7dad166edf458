"""All registered queries of this subpackage."""

from rowloom.llm import (  # noqa: F401
    bpe, decontaminate, fingerprints, hard_negatives, language, near_dup, quotations, resharding, sentence_spans, url_templates, vector_codes, vector_links, warc,
)
from rowloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
