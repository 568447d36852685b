"""Worker routing, priority, queues and task configuration as expressions.

``config`` is a struct column; keys it lacks count as unset, so a job only declares the
settings it uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.functions import fixed as K

CONFIG = T.StructType(
    [
        T.StructField("force_headless", T.BooleanType()),
        T.StructField("enable_ai_extraction", T.BooleanType()),
        T.StructField("extraction_strategy", T.StringType()),
        T.StructField("semantic_filter", T.StringType()),
        T.StructField("complex_content", T.BooleanType()),
        T.StructField("enable_smart_routing", T.BooleanType()),
        T.StructField("high_priority_domains", T.ArrayType(T.StringType())),
        T.StructField("timeout", T.IntegerType()),
        T.StructField("retries", T.IntegerType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("follow_redirects", T.BooleanType()),
        T.StructField(
            "llm_config",
            T.StructType(
                [
                    T.StructField("provider", T.StringType()),
                    T.StructField(
                        "schema",
                        T.StructType(
                            [
                                T.StructField(
                                    "fields",
                                    T.ArrayType(
                                        T.StructType(
                                            [
                                                T.StructField("name", T.StringType()),
                                                T.StructField("selector", T.StringType()),
                                                T.StructField("type", T.StringType()),
                                            ]
                                        )
                                    ),
                                )
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)


def empty_config() -> Column:
    return F.lit(None).cast(CONFIG)


def _any_word(url: Column, words) -> Column:
    low = F.lower(url)
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def _on(flag: Column, default: bool = False) -> Column:
    return F.coalesce(flag, F.lit(default))


def route_ingest(url: Column, config: Column) -> Column:
    headless = _on(config["force_headless"]) | _any_word(url, K.INGEST_SCRIPT_WORDS)
    return F.when(headless, "headless").otherwise("http")


def route_smart(url: Column, config: Column) -> Column:
    asked = (
        _on(config["enable_ai_extraction"])
        | F.coalesce(config["extraction_strategy"].isin("llm", "cosine"), F.lit(False))
        | config["semantic_filter"].isNotNull()
        | _on(config["complex_content"])
    )
    readable = _any_word(url, K.SMART_CONTENT_WORDS) & _on(config["enable_smart_routing"], True)
    return (
        F.when(asked | readable, "crawl4ai")
        .when(_any_word(url, K.SMART_SCRIPT_WORDS), "headless")
        .otherwise("http")
    )


def priority(url: Column, config: Column) -> Column:
    favoured = F.exists(
        F.coalesce(config["high_priority_domains"], F.array().cast("array<string>")),
        lambda d: F.contains(url, d),
    )
    return F.when(favoured, 5).when(_any_word(url, K.DOCUMENT_SUFFIXES), 3).otherwise(1)


def task_config(config: Column) -> Column:
    filled = F.struct(
        F.coalesce(config["timeout"], F.lit(30)).alias("timeout"),
        F.coalesce(config["retries"], F.lit(3)).alias("retries"),
        config["user_agent"].alias("user_agent"),
        F.coalesce(config["headers"], F.create_map().cast("map<string,string>")).alias("headers"),
        _on(config["follow_redirects"], True).alias("follow_redirects"),
    )
    return F.when(config.isNotNull(), filled)


def queue_name(worker: Column) -> Column:
    args: list[Column] = []
    for kind, queue in K.QUEUES.items():
        args += [F.lit(kind), F.lit(queue)]
    return F.coalesce(F.try_element_at(F.create_map(*args), worker), F.lit(K.QUEUES["http"]))


def config_problem(config: Column) -> Column:
    """Why an extraction config is unusable; null when it is fine."""
    strategy = F.coalesce(config["extraction_strategy"], F.lit("markdown"))
    timeout = F.coalesce(config["timeout"], F.lit(30))
    fields = config["llm_config"]["schema"]["fields"]
    return (
        F.when((strategy == "llm") & config["llm_config"].isNull(), "llm_config required")
        .when((strategy == "llm") & config["llm_config"]["schema"].isNull(), "schema required")
        .when((strategy == "llm") & fields.isNull(), "schema.fields required")
        .when(
            (strategy == "llm") & F.exists(fields, lambda f: f["name"].isNull() | f["type"].isNull()),
            "field needs name and type",
        )
        .when((strategy == "cosine") & config["semantic_filter"].isNull(), "semantic_filter required")
        .when((timeout < 1) | (timeout > 300), "timeout out of range")
    )
