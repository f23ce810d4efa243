"""Station count analytics as Spark DataFrame plans."""

from stationflow.config import BacktestConfig, MartConfig, PanelConfig

__all__ = ["BacktestConfig", "MartConfig", "PanelConfig"]
