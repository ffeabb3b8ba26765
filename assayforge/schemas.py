"""Explicit schemas of the inputs and outputs (no inference on read)."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data contract.
LABEL_MISSING = 2
ID_MISSING = -1
NOT_SELECTED = -1
PAD_ID = 0
MASK_ID = 1
FIRST_TOKEN_ID = 2
TRAIN, VALIDATION, TEST = 0, 1, 2
PROTEINS = ("BRD4", "HSA", "sEH")
BLOCK_COLUMNS = ("block1", "block2", "block3")
RAW_COLUMN_NAMES = {
    "buildingblock1_smiles": "block1",
    "buildingblock2_smiles": "block2",
    "buildingblock3_smiles": "block3",
    "molecule_smiles": "smiles",
}
EXTRA_COLUMN_NAMES = {"new_structure": "smiles", "read_count": "binds"}

_RAW_KEYS = [
    T.StructField("buildingblock1_smiles", T.StringType()),
    T.StructField("buildingblock2_smiles", T.StringType()),
    T.StructField("buildingblock3_smiles", T.StringType()),
    T.StructField("molecule_smiles", T.StringType()),
    T.StructField("protein_name", T.StringType()),
]

RAW_TRAIN = T.StructType([*_RAW_KEYS, T.StructField("binds", T.ByteType())])
RAW_TEST = T.StructType([T.StructField("id", T.LongType()), *_RAW_KEYS])
EXTRA_COUNTS = T.StructType([
    T.StructField("new_structure", T.StringType()),
    T.StructField("read_count", T.LongType()),
])
UNIFIED = T.StructType([
    T.StructField("smiles", T.StringType()),
    T.StructField("binds", T.ArrayType(T.ByteType())),
    T.StructField("subset", T.ByteType()),
    T.StructField("smiles_no_linker", T.StringType()),
])
VOCABULARY = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("token_id", T.IntegerType()),
])
RECORDS = T.StructType([
    T.StructField("smiles", T.ArrayType(T.StringType())),
    T.StructField("ecfp", T.ArrayType(T.IntegerType())),
    T.StructField("binds", T.ArrayType(T.ByteType())),
    T.StructField("subset", T.ByteType()),
])
SUBMISSION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("binds", T.DoubleType()),
])
