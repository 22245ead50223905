import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("pvspark-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "4g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pvspark-test-ckpt-"))
    yield s
    s.stop()


def ts(s: str):
    from datetime import datetime, timezone
    return datetime.fromisoformat(s.replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None)


@pytest.fixture
def ramp(spark):
    """History ramp: ac_energy_kwh = hour index (+1000 per site), 200 h."""
    from datetime import datetime, timedelta

    def make(sites=1, hours=200, drop=()):
        rows = []
        t0 = datetime(2025, 1, 1)
        for s in range(sites):
            for h in range(hours):
                if h in drop:
                    continue
                rows.append((f"site-{s}", t0 + timedelta(hours=h), float(h + 1000 * s), 100.0, 20.0, 10.0, 50.0, 2.0))
        return spark.createDataFrame(rows, "site_id string, timestamp timestamp, ac_energy_kwh double, ghi_w_m2 double, "
                                           "ambient_temperature_c double, cloud_cover_pct double, relative_humidity_pct double, "
                                           "wind_speed_m_s double")
    return make
