"""Declared schemas and the header names used at the CSV edge."""

from pyspark.sql import types as T

# fixed values: CSV header -> column name
CSV_NAMES = {
    "UDI": "udi",
    "Product ID": "product_id",
    "Type": "type",
    "Air temperature [K]": "air_temp",
    "Process temperature [K]": "process_temp",
    "Rotational speed [rpm]": "rpm",
    "Torque [Nm]": "torque",
    "Tool wear [min]": "tool_wear",
    "Machine failure": "machine_failure",
    "TWF": "twf",
    "HDF": "hdf",
    "PWF": "pwf",
    "OSF": "osf",
    "RNF": "rnf",
}

_RAW_TYPES = {"udi": T.LongType(), "product_id": T.StringType(), "type": T.StringType()}
_LABELS = {"machine_failure", "twf", "hdf", "pwf", "osf", "rnf"}


def _raw_type(name: str) -> T.DataType:
    return _RAW_TYPES.get(name, T.IntegerType() if name in _LABELS else T.DoubleType())


RAW_SCHEMA = T.StructType([T.StructField(name, _raw_type(name)) for name in CSV_NAMES.values()])
CSV_SCHEMA = T.StructType([T.StructField(header, _raw_type(name)) for header, name in CSV_NAMES.items()])

READING_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("machine_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("type", T.StringType()),
    T.StructField("air_temp", T.DoubleType()),
    T.StructField("process_temp", T.DoubleType()),
    T.StructField("rpm", T.DoubleType()),
    T.StructField("torque", T.DoubleType()),
    T.StructField("tool_wear", T.DoubleType()),
    T.StructField("machine_failure", T.IntegerType()),
])
