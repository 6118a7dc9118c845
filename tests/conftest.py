import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FACILITY_SCHEMA = (
    "unique_id string, name string, address_stateOrRegion string, district string, address_city string, "
    "address_zipOrPostcode string, latitude string, longitude string, facilityTypeId string, operatorTypeId string, "
    "description string"
)
A, B, C = (f"{i}1111111-1111-1111-1111-111111111111" for i in "123")
FACILITIES = [
    (A, '{"name":"Asha Hospital"}', "Orissa", None, "Cuttack", "753 001", "18.0", "(85.0)", "Nursing Home", "Private", "Has a NICU and blood bank."),
    (A, "Asha Clinic", "Orissa", None, "Cuttack", "753001", "18.0", "85.0", "clinic", "Govt", None),
    (A, "Asha Clinic", "Orissa", None, "Cuttack", "753001", "18.0", "85.0", "clinic", "Govt", None),
    (B, "Lone Doc", "Karnataka", None, "Mysuru", None, "x", "85.0", "doctor", None, "gynaecology and obstetrics"),
    (C, "Nowhere", None, None, None, None, "1", "2", "hospital", None, "trauma care"),
    ("bad", "No uuid", "Kerala", None, None, None, "1", "2", "hospital", None, "x"),
    (C, " nan ", "Kerala", None, None, None, "1", "2", "hospital", None, "x"),
]
DIRECTORY = [
    ("753001", "ORISSA", "Cuttack", "HO", "H", "18.1", "85.1"), ("753001", "ORISSA", "Cuttack", "SO", "S", "18.3", "NA"),
    ("753001", "ORISSA", "Angul", "BO", "B", None, None), ("n/a", "ORISSA", "Angul", "XX", "B", None, None),
]
DISTRICTS = [
    ("Cuttack", "Odisha", "1,000", "80.5", "40", "60", "90", "(70.1)", "30"),
    ("Cuttack", "ODISHA", "1,001", "80.5", "40", "60", "90", "(70.1)", "30"),
    ("Mysore", "Karnataka", "900", "90", "30", "50", "91", "*", "31"),
]


@pytest.fixture(scope="session")
def raw(spark):
    directory = "pincode string, statename string, district string, officename string, officetype string, latitude string, longitude string"
    districts = (
        "district_name string, state_ut string, households_surveyed string, institutional_birth_5y_pct string, "
        "child_u5_who_are_stunted_height_for_age_18_pct string, all_w15_49_who_are_anaemic_pct string, "
        "hh_improved_water_pct string, hh_use_improved_sanitation_pct string, hh_member_covered_health_insurance_pct string"
    )
    return (
        spark.createDataFrame(FACILITIES, FACILITY_SCHEMA), spark.createDataFrame(DIRECTORY, directory),
        spark.createDataFrame(DISTRICTS, districts),
    )
