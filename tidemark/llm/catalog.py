"""The registries of the operators on training data."""

from __future__ import annotations

from tidemark.llm import queries_corpus, queries_text

REGISTRIES = [queries_corpus.R, queries_text.R]
