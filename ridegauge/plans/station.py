"""Station diagnosis from daily demand to clusters, and the slice labels forecasts use."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ridegauge.config import StationConfig
from ridegauge.operators import categories as cat, clustering as cl, panel as pn
from ridegauge.operators.keyed import last_per_key
from ridegauge.session import cut_lineage

SLICE_COLUMNS = [
    "station_id", "history_group", "station_category", "cluster_label", "is_short_history", "is_zero_almost_always",
    "appears_active_recently",
]


def diagnose_stations(daily: DataFrame, config: StationConfig = StationConfig()) -> dict[str, DataFrame | None]:
    """Panel, inventory, labelled and clustered summary, and the tables derived from them."""
    daily = cut_lineage(daily)
    panel = pn.analysis_panel(daily, config)
    inventory = pn.station_inventory(daily, config)
    categorized = cut_lineage(cat.categorize(pn.station_summary(daily, config, panel), config))
    clustered, profile, selection = cl.cluster_stations(categorized, config)
    return {
        "station_panel": panel,
        "station_inventory": inventory,
        "station_summary": clustered,
        "category_summary": cat.category_summary(categorized),
        "cluster_profile": profile,
        "cluster_selection": selection,
    }


def slice_lookup(
    daily: DataFrame, stored: DataFrame | None = None, config: StationConfig = StationConfig(), order: str | None = None
) -> DataFrame:
    """Stored labels when given (last row per station by ``order``), else computed from the observed days."""
    if stored is not None and "station_id" in stored.columns:
        keep = [c for c in SLICE_COLUMNS if c in stored.columns]
        rows = stored.select(*keep, *([order] if order else []))
        return last_per_key(rows, ["station_id"], [order]).drop(order) if order else rows.dropDuplicates(["station_id"])
    return diagnose_stations(daily, config)["station_summary"].select(*SLICE_COLUMNS)
