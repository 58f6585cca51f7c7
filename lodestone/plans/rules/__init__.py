"""Keep rules in the order in which they are tried; the first that holds gives the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...config import Config
from . import base, frameworks, language

#: Plugins in order of evaluation (fixed order).
PLUGINS = {
    "python": language.python,
    "entry-points": language.entry_points,
    "pytest": language.pytest,
    "fastapi": frameworks.fastapi,
    "flask": frameworks.flask,
    "click": frameworks.click,
    "celery": frameworks.celery,
    "airflow": frameworks.airflow,
    "django": frameworks.django,
    "graphene": frameworks.graphene,
    "textual": frameworks.textual,
    "homeassistant": frameworks.homeassistant,
    "ansible": frameworks.ansible,
    "alembic": frameworks.alembic,
    "sqlalchemy": frameworks.sqlalchemy,
    "pydantic": frameworks.pydantic,
}


def keep_reason(config: Config) -> Column:
    """struct<plugin, why> of the first rule that holds, or null."""
    found: list[tuple[str, str, Column]] = []
    if config.plugins:
        for plugin, rules in PLUGINS.items():
            found += [(plugin, why, cond) for why, cond in rules(config)]
    found.append(("python", "overrides an inherited member", F.col("is_override") & (F.col("kind").isin("method", "property") | base.is_attribute)))
    return F.coalesce(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(plugin).alias("plugin"), F.lit(why).alias("why"))) for plugin, why, cond in found))
