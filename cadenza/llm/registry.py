"""All queries of this subpackage and their oracles."""

from __future__ import annotations

from importlib import import_module

MODULES = ["token_files", "piece_codec", "token_counts", "shards", "quality", "warc", "decontaminate", "shingle_join", "pii", "url_filter", "phrases", "divergence", "vector_join"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
