"""All registered queries of the library, by name, and their SQL."""

from __future__ import annotations

from matchforge.plans import metric_queries, more_queries, shred_queries, source_queries  # noqa: F401  these register their queries
from matchforge.plans import queries as plans


def flagship(spark, sf_dir: str):
    """Leakage-safe solo priors of every game's teams."""
    return plans.smo20_solo_prior_features(spark, sf_dir)


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
