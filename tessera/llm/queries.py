"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, html, mixing, pii, quality, simhash, suffixes, toxicity, warc

QUERIES = {k: f for m in (quality, mixing, simhash, suffixes, toxicity, pii, html, warc, chat, decontaminate) for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {**chat.SQL}
