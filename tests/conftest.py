import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def assay_train(spark):
    """Twelve long rows: a full triple, a gap, a duplicate with two values, a null block, far-apart rows."""
    rows = [
        (1, "a", "b", "c", "C[Dy]N", "BRD4", 1),
        (2, "a", "b", "c", "C[Dy]N", "HSA", 0),
        (3, "a", "b", "c", "C[Dy]N", "sEH", 1),
        (4, "a", "d", "e", "Cl[Dy]", "BRD4", 0),
        (5, "a", "d", "e", "Cl[Dy]", "sEH", 1),
        (6, "f", "b", "g", "Br", "BRD4", 1),
        (7, "f", "b", "g", "Br", "BRD4", 0),
        (8, "f", "b", "g", "Br", "HSA", 1),
        (9, "h", None, "c", "O", "HSA", 1),
        (10, "i", "j", "k", "[Dy]O[Dy]", "BRD4", 1),
        (11, "l", "m", "n", "N", "BRD4", 0),
        (12, "i", "j", "k", "[Dy]O[Dy]", "HSA", 1),
    ]
    return spark.createDataFrame(
        rows, "id long, block1 string, block2 string, block3 string, smiles string, protein_name string, binds byte"
    )


@pytest.fixture(scope="session")
def assay_test(spark):
    rows = [
        (100, "a", "b", "c", "C[Dy]", "BRD4"), (101, "a", "b", "c", "C[Dy]", "HSA"),
        (102, "a", "b", "c", "C[Dy]", "sEH"), (103, "d", "e", "f", "N[Dy]", "BRD4"),
        (104, "d", "e", "f", "N[Dy]", "sEH"), (105, "g", "h", "i", "O", "HSA"),
    ]
    return spark.createDataFrame(
        rows, "id long, block1 string, block2 string, block3 string, smiles string, protein_name string"
    )


@pytest.fixture(scope="session")
def extra_counts(spark):
    return spark.createDataFrame([("S1", 0), ("S2", 1), ("S3", 7), ("S4", -1)], "smiles string, binds long")


@pytest.fixture(scope="session")
def predictions(spark):
    """Eight rows, three labels: missing codes, an all-missing row, ties, scores 0 and 1, no positives."""
    rows = [
        (0, 1, 0, 0, 0.9, 0.2, 0.1), (1, 0, 1, 0, 0.4, 0.8, 0.3), (2, 1, 2, 0, 0.4, 0.5, 0.6),
        (3, 0, 0, 2, 0.1, 0.0, 0.5), (4, 2, 2, 2, 0.7, 0.7, 0.7), (5, 1, 1, 0, 1.0, 0.8, 0.2),
        (6, 0, 0, 0, 0.4, 0.8, 0.9), (7, 2, 1, 0, 0.3, 1.0, 0.0),
    ]
    return spark.createDataFrame(rows, "k long, a int, b int, c int, pa double, pb double, pc double")
