"""All registries of the core."""

from __future__ import annotations

from threadloom.plans import body_queries, data_quality, store_queries, text_queries, thread_queries
from threadloom.plans.registry import Registry


def registries() -> list[Registry]:
    return [data_quality.registry, store_queries.registry, text_queries.registry, body_queries.registry, thread_queries.registry]
