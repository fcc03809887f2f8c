"""The registered queries of the library and their SQL."""

from __future__ import annotations

from foliant.plans import columns, corpora, evaluation, files, memory, panels, texts

_PARTS = (evaluation, memory, texts, panels, corpora, columns, files)
QUERIES: dict = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for part in _PARTS for k, s in part.ORACLES.items()}
