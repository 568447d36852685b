"""Extraction strategies by name: each turns pages into rows; users may add their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from crawlweave.operators.page_tree import field_dataset, page_trees
from crawlweave.operators.search import page_blocks, passage_search

Strategy = Callable[[DataFrame, dict], DataFrame]


def _markdown(pages: DataFrame, config: dict) -> DataFrame:
    return page_trees(pages, ["markdown"]).select("page_id", "url", "markdown")


def _schema(pages: DataFrame, config: dict) -> DataFrame:
    return field_dataset(pages, config["schema"]["fields"])


def _cosine(pages: DataFrame, config: dict) -> DataFrame:
    blocks = page_blocks(pages, config.get("word_count_threshold", 10))
    return passage_search(
        blocks, config["semantic_filter"], config.get("top_k", 3), config.get("max_dist", 0.2), per_page=True
    )


STRATEGIES: dict[str, Strategy] = {"markdown": _markdown, "schema": _schema, "cosine": _cosine}


def register(name: str, strategy: Strategy) -> None:
    STRATEGIES[name] = strategy


def extract(pages: DataFrame, config: dict) -> DataFrame:
    name = config.get("extraction_strategy", "markdown")
    if name not in STRATEGIES:
        raise ValueError(f"unknown extraction strategy {name!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[name](pages, config)
