import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[*]")
        .appName("skywatch-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="skywatch-wh-"))
    )
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def write_lines(directory, name, lines):
    path = os.path.join(str(directory), name)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


# FIXTURES.md section 2.1: summary edge cases (CSV with header).
SUMMARY_CSV = [
    "details,date,city,state,country,shape,summary,report_date,posted_date,month_count",
    'd1,12/1998,Reno,NV,USA,disk,"x, y",01/05/1999,01/28/1999,5',
    "d2,01/1999,Reno,NV,USA,light,z,01/06/1999,01/28/1999,7",
    "d3,02/1999,Yuma,AZ,USA,,z,01/06/1999,,",
    "d4,junk,Yuma,AZ,USA,orb,z,01/06/1999,02/01/1999,9",
]

# FIXTURES.md section 2.2: extra delimited-text rows.
EXTRA_TEXT = [
    "d5,junk,Yuma",
    "d6,junk,Yuma,AZ,USA,orb,z,01/06/1999,02/01/1999,9,extra",
    "d7,junk,Yuma,AZ,USA,orb,z,01/06/1999,02/01/1999, 4",
    "d8,junk,Yuma,AZ,USA,orb,z,01/06/1999,02/01/1999,4.7",
]


@pytest.fixture()
def summary_csv(tmp_path):
    return write_lines(tmp_path, "sightings.csv", SUMMARY_CSV)


@pytest.fixture()
def text_file(tmp_path):
    return write_lines(tmp_path, "sightings.txt", SUMMARY_CSV + EXTRA_TEXT)
