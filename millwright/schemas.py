"""Column lists and source schemas shared by every layer."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- Fixed values: column names and horizons that results must match ----
TYPE_COLUMNS = [
    "type_surchauffe",
    "type_baisse_pression",
    "type_vibration",
    "type_bruit_mecanique",
    "type_surconsommation",
    "type_blocage_mecanique",
    "type_alarme_capteur",
    "type_arret_urgence",
    "type_defaut_qualite",
]
RAW_SIGNALS = ["temperature_c", "pressure_bar", "voltage_mean_v", "rotation_mean_rpm", "pieces_produced"]
PREFIX_OF_SIGNAL = {
    "temp": "temperature_c",
    "pressure": "pressure_bar",
    "voltage": "voltage_mean_v",
    "rotation": "rotation_mean_rpm",
}
MACHINE_COLUMNS = [
    "machine_code", "commissioning_date", "max_daily_capacity", "max_hourly_capacity_pieces",
    "model", "production_line", "location", "criticality",
]
MAINTENANCE_COLUMNS = [
    "maintenance_id", "machine_code", "maintenance_at", "maintenance_type", "action_type",
    "component", "description", "related_incident_id", "duration_hours",
]
MEMORY_HOURS = (6, 12, 24)
LABEL_HOURS = (6, 12, 24, 48)
SPLIT_PROBS = (0.70, 0.85)
SPLIT_NAMES = ("train", "validation", "test")
FAHRENHEIT_ABOVE = 80.0
CRITICALITIES = ["LOW", "MEDIUM", "HIGH"]
MAINTENANCE_TYPES = ["proactive", "reactive"]
# ---- end of fixed values ----

SIGNALS = list(PREFIX_OF_SIGNAL)
PIECES = "pieces_produced_1h"
HOURLY_COLUMNS = [f"{p}_{stat}_1h" for p in SIGNALS for stat in ("mean", "max")] + [PIECES]
GOLD_IDS = ["machine_id_std", "window_start", "window_end", "split_set"]
GOLD_LABELS = [f"label_failure_next_{h}h" for h in LABEL_HOURS] + [
    f"future_incident_count_{h}h" for h in LABEL_HOURS
]
MACHINE_ATTRIBUTES = MACHINE_COLUMNS[1:]
GOLD_FEATURES = [
    *HOURLY_COLUMNS,
    *MACHINE_ATTRIBUTES,
    "incident_count_1h",
    "incident_max_severity_1h",
    *TYPE_COLUMNS,
    "incident_count_prev_24h",
    "incident_max_severity_prev_24h",
    "incident_count_prev_7d",
    *[f"{c}_count_prev_24h" for c in TYPE_COLUMNS],
    "hours_since_last_incident",
    "maintenance_count_1h",
    "maintenance_count_prev_30d",
    "days_since_last_maintenance",
    *[f"{p}_{stat}_{n}h" for p in SIGNALS for n in MEMORY_HOURS for stat in ("mean", "max", "std")],
    *[f"{p}_{name}" for p in SIGNALS for name in ("trend_6h", "delta_1h", "delta_3h")],
    *[f"{p}_{name}" for p in SIGNALS for name in ("zscore_24h", "zscore_machine")],
    "pieces_produced_sum_24h",
    "capacity_utilization_pct",
]
GOLD_COLUMNS = [*GOLD_IDS, *GOLD_FEATURES, *GOLD_LABELS]



def gold_struct(columns: list[str]) -> T.StructType:
    """Types of the standard gold feature and label columns, by name."""
    texts = ("model", "production_line", "location", "criticality")
    wholes = ("incident_count", "maintenance_count", "future_incident_count", "type_")

    def kind(name: str) -> T.DataType:
        if name == "commissioning_date":
            return T.DateType()
        if name in texts:
            return T.StringType()
        if name.startswith("label_"):
            return T.BooleanType()
        if name.startswith(wholes):
            return T.LongType()
        if name.startswith(("max_", "incident_max_severity")):
            return T.IntegerType()
        return T.DoubleType()

    return T.StructType([T.StructField(c, kind(c)) for c in columns])


BRONZE_TELEMETRY = ["row_seq", "machine_id", "timestamp", *RAW_SIGNALS, "ingested_at"]
BRONZE_INCIDENTS = [
    "incident_id", "date", "time", "operator_key", "machine_id", "severity", "comment", "shift",
    *TYPE_COLUMNS, "ingested_at",
]
SILVER_TELEMETRY = ["machine_id", "timestamp", *RAW_SIGNALS, "machine_id_std", "window_start"]
SILVER_INCIDENTS = [
    "incident_id", "date", "time", "operator_key", "machine_id", "severity", "comment", "shift",
    "incident_at", "window_start", "machine_id_std", *TYPE_COLUMNS,
]
SILVER_MAINTENANCE = [*MAINTENANCE_COLUMNS, "maintenance_hour"]

TELEMETRY_REQUIRED = ["machine_id", "timestamp", *RAW_SIGNALS]
INCIDENT_REQUIRED = ["incident_id", "date", "time", "machine_id", "severity", *TYPE_COLUMNS]

LAYER_TABLES = {
    "bronze": ["telemetry_raw", "incidents_raw", "machine", "maintenance"],
    "silver": ["telemetry", "incidents", "machine", "maintenance"],
    "gold": ["gold_dataset"],
}

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_ts", T.StringType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("layer", T.StringType()),
        T.StructField("source_layer", T.StringType()),
        T.StructField("run_dir", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("telemetry_rows", T.LongType()),
        T.StructField("telemetry_rows_usable", T.LongType()),
        T.StructField("machines", T.LongType()),
        T.StructField("reference_machines", T.LongType()),
        T.StructField("maintenances", T.LongType()),
        T.StructField("column_count", T.IntegerType()),
        T.StructField("split_counts", T.MapType(T.StringType(), T.LongType())),
    ]
)
