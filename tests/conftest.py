import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


EMAIL = "id bigint, message_id string, subject string, from_name string, from_email string, date string, body string, list_name string, thread_id string, in_reply_to string, refs string, priority string, relevance_score double, relevance_reason string, raw_json_path string, processed int, created_at double"


@pytest.fixture(scope="session")
def emails(spark):
    """emails(rows): dicts with some columns to a full table, plus a column that clashes with names used inside."""
    names = [c.split()[0] for c in EMAIL.split(", ")]

    def make(rows, extra=False):
        df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EMAIL)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit("clash") for c in ("node", "key", "state", "h", "thread", "sender", "p", "root", "n")}) if extra else df

    return make


@pytest.fixture(scope="session")
def threads(spark):
    kind = "id string, root_message_id string, subject string, start_date string, end_date string, email_count bigint, participant_count bigint, summary_zh string, key_points string, consensus string, design_decisions string, related_files string, related_functions string, tags string, processed int, translated_html_path string, created_at double, hidden int"
    names = [c.split()[0] for c in kind.split(", ")]
    return lambda rows: spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kind)
