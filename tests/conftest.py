import os
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import Row, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(s.conf.get("spark.checkpoint.dir"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def make_record(**changes):
    """A record that passes all gates, with invented values."""
    from ledgerlake.schemas import RECORD, SOURCE_CLASSES

    day = date(2025, 1, 1)
    proof = lambda confidence="High": Row(source_class=SOURCE_CLASSES["SEC_EDGAR"], method="filing", checked_at=day, source_url="https://example.com/f", confidence=confidence, note=None, fetched_at=None, content_hash=None, snapshot_path=None)
    base = {f.name: None for f in RECORD.fields} | {
        "fo_id": "fo_1", "name": "Alder Family Office", "fo_type": "Single-Family Office", "fo_type_evidence": "states so", "fo_type_confidence": "High", "investing_sectors": ["Healthcare"],
        "website": "https://alder.example.com", "hq_country": "United States", "hq_state": "TX", "principal_name": "Jane Roe", "discovery_source": SOURCE_CLASSES["NEWS"],
        "verification_sources": [Row(source_class=SOURCE_CLASSES["SEC_EDGAR"], verifies="identity", accessed_at=day, url=None), Row(source_class=SOURCE_CLASSES["SEC_IAPD"], verifies="type", accessed_at=day, url=None)],
        "signals": [Row(text="bought shares", source_class=SOURCE_CLASSES["NEWS"], event_date=day, source_url="https://example.com/s", confidence="Medium")], "record_confidence": "High", "data_as_of": day,
        "could_not_verify": [], "provenance": {k: proof() for k in ("name", "website", "hq_country", "principal_name", "description", "investment_thesis", "estimated_aum", "principal_email", "principal_phone", "hq_phone")}}
    base |= changes
    return tuple(base[f.name] for f in RECORD.fields)


@pytest.fixture(scope="session")
def records(spark):
    from ledgerlake.schemas import RECORD

    def make(*changes):
        return spark.createDataFrame([make_record(**c) for c in changes], RECORD)

    return make
