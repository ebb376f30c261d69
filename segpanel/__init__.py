"""segpanel: segment-panel analytics for point events, expressed as Spark DataFrame operators."""

from segpanel.roles import AnomalyConfig, Box, HotspotConfig, QualityConfig, Roles

__all__ = ["AnomalyConfig", "Box", "HotspotConfig", "QualityConfig", "Roles"]
