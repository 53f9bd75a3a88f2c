"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from . import dashboards, flows, keywords, nested, phrases, profiles, records, scores, streams, suggestion_lists, suggestions, texts, variants, weighted_terms, wording  # noqa: F401
from ._register import ORACLES, QUERIES  # noqa: F401
