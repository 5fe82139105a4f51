"""All registered queries of the message domain."""

from __future__ import annotations

from colloquy.plans import corpus_queries, message_queries
from colloquy.plans.message_queries import flagship
from colloquy.plans.views import REGISTRY, Query

__all__ = ["corpus_queries", "flagship", "message_queries", "registry"]


def registry() -> dict[str, tuple[Query, str | None]]:
    return dict(REGISTRY)
