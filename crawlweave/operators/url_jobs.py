"""Jobs over URL columns: inventory, validation report, robots rules, link graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import fixed as K
from crawlweave.functions import html as H
from crawlweave.functions import urls as U
from crawlweave.operators.skew import join_lookup


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{K.WS}+|{K.WS}+$", "")


def classify_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``norm_url`` and ``verdict``: skipped, invalid or valid.

    The normalized URL comes out of a generator, which filters on it are not pushed
    through; otherwise each of them would normalize every URL again.
    """

    def norm(s: Column) -> Column:
        skipped = (s == "") | s.startswith("#") | s.startswith("//")
        return F.when(~skipped, U.normalize_url(s))

    return df.select(
        "*", F.explode(F.transform(F.array(_stripped(F.col(url))), norm)).alias("norm_url")
    ).withColumn(
        "verdict",
        F.when(F.col("norm_url").isNull(), "skipped")
        .when(U.is_valid_url(F.col("norm_url")), "valid")
        .otherwise("invalid"),
    )


def clean_urls(
    df: DataFrame, url: str = "url", order: Sequence[str] = ("file", "pos"), scope: Sequence[str] = ()
) -> DataFrame:
    """One row per distinct valid URL with the place it was first seen and how often it occurs.

    ``scope`` limits deduplication, e.g. to one file. First-wins is an aggregate, so copies
    collapse before the shuffle and a URL with very many copies costs nothing extra.
    """
    valid = classify_urls(df, url).filter("verdict = 'valid'")
    first = F.min(F.col(order[0]) if len(order) == 1 else F.struct(*order)).alias("first_seen")
    return valid.groupBy(*scope, "norm_url").agg(first, F.count("*").alias("occurrences"))


def url_report(df: DataFrame, url: str = "url", scope: Sequence[str] = ("file",)) -> DataFrame:
    """Counts total / valid / invalid / duplicates per file; skipped rows count in total only."""
    per_url = classify_urls(df, url).groupBy(*scope, "verdict", "norm_url").agg(F.count("*").alias("n"))
    is_valid = F.col("verdict") == "valid"
    return per_url.groupBy(*scope).agg(
        F.sum("n").alias("total"),
        F.count_if(is_valid).alias("valid"),
        F.coalesce(F.sum(F.when(F.col("verdict") == "invalid", F.col("n"))), F.lit(0)).alias("invalid"),
        F.coalesce(F.sum(F.when(is_valid, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
    )


def url_features(df: DataFrame, url: str = "url") -> DataFrame:
    u = F.col(url)
    return df.select(
        "*",
        U.domain(u).alias("domain"),
        U.path_depth(u).alias("path_depth"),
        U.has_query(u).alias("has_query_params"),
        U.is_secure(u).alias("is_secure"),
    )


def robots_filter(urls: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """Adds ``allowed``. ``rules`` has one row per line: host, agent, ord, path, allow.

    The group written for this agent replaces the ``*`` group; inside a group the first
    line whose path is a prefix decides; no rule means allowed. A host's lines are one
    robots file, so gathering them per host is bounded by that file, and the join is
    one-to-many on the host.
    """
    named = F.lower("agent") != "*"
    usable = rules.filter((F.col("agent") == "*") | F.contains(F.lower(F.lit(agent)), F.lower("agent")))
    per_host = usable.groupBy("host").agg(
        F.sort_array(
            F.collect_list(F.struct(F.when(named, 0).otherwise(1).alias("rank"), "ord", "path", "allow"))
        ).alias("_rules")
    )
    target = F.concat(
        F.when(U.part(F.col(url), 3) == "", F.lit("/")).otherwise(U.part(F.col(url), 3)),
        F.when(U.has_query(F.col(url)), F.concat(F.lit("?"), U.part(F.col(url), 4))).otherwise(""),
    )
    joined = urls.withColumn("host", U.domain(F.col(url))).withColumn("_target", target)
    joined = join_lookup(joined, per_host, ["host"])
    group = F.filter("_rules", lambda r: r["rank"] == F.get("_rules", F.lit(0))["rank"])
    first = F.get(
        F.filter(group, lambda r: (r["path"] == "*") | F.startswith(F.col("_target"), r["path"])), F.lit(0)
    )
    decided = F.when(first["path"] == "", F.lit(True)).otherwise(first["allow"])
    return joined.withColumn("allowed", F.coalesce(decided, F.lit(True))).drop("_rules", "_target")


def link_edges(pages: DataFrame) -> DataFrame:
    """(src_url, dst_url, src_domain, dst_domain, internal), one row per distinct link of a page."""
    return (
        pages.select(F.col("url").alias("src_url"), F.explode(H.links(H.live_markup(F.col("html")), F.col("url"))).alias("dst_url"))
        .withColumn("src_domain", U.domain(F.col("src_url")))
        .withColumn("dst_domain", U.domain(F.col("dst_url")))
        .withColumn("internal", F.col("src_domain") == F.col("dst_domain"))
    )


def link_degrees(edges: DataFrame) -> DataFrame:
    """Edges out of and into each domain, and how many of them stay inside."""
    sides = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src_domain").alias("domain"), F.lit(1).alias("o"), F.lit(0).alias("i"),
                         F.col("internal").cast("int").alias("own")),
                F.struct(F.col("dst_domain").alias("domain"), F.lit(0).alias("o"), F.lit(1).alias("i"),
                         F.lit(0).alias("own")),
            )
        ).alias("e")
    ).select("e.*")
    return sides.groupBy("domain").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("own").alias("internal_links")
    )


def top_linked(edges: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most linked URLs, by distinct linking pages."""
    return (
        edges.groupBy("dst_url").agg(F.count("*").alias("n_links"))
        .orderBy(F.desc("n_links"), "dst_url").limit(k)
    )


def link_split(pages: DataFrame) -> DataFrame:
    found = H.links(H.live_markup(F.col("html")), F.col("url"))
    return (
        pages.select("page_id", "url", found.alias("links"))
        .withColumn("internal", H.internal_links(F.col("links"), F.col("url")))
        .withColumn("external", H.external_links(F.col("links"), F.col("url")))
    )
