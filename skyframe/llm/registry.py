"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from skyframe.llm import compression, decontaminate, html, jaccard, langid, licenses, linededup, packing, quality, search, secrets, warc, whitening

MODULES = [html, jaccard, langid, linededup, licenses, secrets, packing, quality, warc, decontaminate, search, whitening, compression]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
