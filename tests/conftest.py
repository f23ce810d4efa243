import os
import sys
from datetime import date, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def synthetic_days(spark):
    """Three stations with weekly shape, level and gaps; enough days for every feature."""
    import math

    rows = []
    for station, level in ((1, 200.0), (2, 900.0), (3, 4000.0)):
        for i in range(620):
            day = date(2022, 1, 1) + timedelta(days=i)
            if (i * 7 + station) % 41 == 0:
                continue
            noise = ((i * 2654435761 + station * 97) % 1000) / 1000.0 - 0.5
            volume = level * (1 + 0.3 * (day.weekday() < 5) + 0.1 * math.sin(i / 58.0)) * (1 + 0.1 * noise)
            rows.append((station, day, volume, True))
    return spark.createDataFrame(rows, "station_id long, date date, station_volume double, valid_day boolean")


@pytest.fixture(scope="session")
def synthetic_cfg():
    from stationflow.config import PanelConfig

    return PanelConfig(
        window_start=date(2022, 1, 1), window_end=date(2023, 9, 12), coverage_threshold=0.5, min_valid_days=100,
        train_end=date(2023, 3, 31), val_end=date(2023, 6, 30),
    )


@pytest.fixture(scope="session")
def synthetic_panel(synthetic_days, synthetic_cfg):
    from stationflow.lineage import settle
    from stationflow.operators.panel import build_panel

    return settle(build_panel(synthetic_days, synthetic_cfg))
