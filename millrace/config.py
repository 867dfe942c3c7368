"""Per-tenant settings with their defaults, as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Defaults of a tenant's settings.
DEFAULTS = {
    "retrieval_top_k": 5, "rrf_k": 60, "top_k_narrow": 1, "top_k_broad": 5, "breadth_score_threshold": 0.0, "breadth_score_gap": 0.3,
    "placeholder_max_distinct_ratio": 0.4, "variant_ambiguity_score_gap": 0.3, "history_window": 6, "session_ttl_s": 86_400, "embed_batch": 16,
}

#: Settings tables are broadcast up to this many tenants, and bytes as JSON, and joined by shuffle beyond.
BROADCAST_TENANTS, BROADCAST_BYTES = 100_000, 64 << 20


def with_defaults(config: DataFrame) -> DataFrame:
    """Missing columns added, and nulls replaced, by the defaults."""
    for name, value in DEFAULTS.items():
        old = F.col(name) if name in config.columns else F.lit(None)
        config = config.withColumn(name, F.coalesce(old, F.lit(value)))
    return config


def small(table: DataFrame, most: int = BROADCAST_TENANTS) -> DataFrame:
    """`table`, to be broadcast if it has at most `most` rows and BROADCAST_BYTES."""
    first = table.limit(most + 1)
    n, size = first.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]))))).first()
    return F.broadcast(table) if n <= most and (size or 0) <= BROADCAST_BYTES else table
