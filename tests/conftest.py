import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    entry._ship(session)
    return session


MEMO = """Internal Memo
From: Jonas Weber (jonas.weber@nordwind.com)
To: Mira Lund (m.lund@nordwind.com)

Jonas Weber joined the call about Project Heron. Mira Lund said staging is at 192.168.10.42.
Call Jonas at +1 (555) 867-5309 or 555-234-5678; files are on ftp.nordwind.com
and https://intranet.nordwind.com/heron. Log of jweber: gateway 10.0.0.1, proxy 172.16.0.254.
Nordwind Trading and NORDWIND TRADING agreed.
"""


@pytest.fixture
def memo(spark):
    return spark.createDataFrame([(1, MEMO)], "id int, text string")


@pytest.fixture
def roster(spark):
    rows = [(0, "Jonas Weber", "jonas.weber@nordwind.com", "jweber"), (1, "Mira Lund", None, None)]
    return spark.createDataFrame(rows, "pos bigint, full_name string, email string, username string")
