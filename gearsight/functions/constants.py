"""Names, thresholds and texts shared by every operator."""

# --- fixed values: column names -------------------------------------------------------
SENSORS = ["air_temp", "process_temp", "rpm", "torque", "tool_wear"]
MODES = ["twf", "hdf", "pwf", "osf", "rnf"]
TARGET = "machine_failure"
ID_COLUMNS = ["udi", "product_id"]
RISK_FLAGS = ["twf_risk_flag", "hdf_risk_flag", "pwf_risk_flag", "osf_risk_flag"]
GENERAL_FLAGS = ["high_wear_flag", "high_torque_flag", "low_rpm_flag", "high_temp_flag", "power_anomaly_flag"]
CORE_SIGNALS = ["air_temp", "process_temp", "rpm", "torque", "power", "temp_diff"]
LAG_SIGNALS = ["torque", "rpm", "power"]
COMPOSITES = ["thermal_strain", "total_stress_index", "thermal_gradient_ratio",
              "vibration_torque_impact", "electrical_thermal_stress"]
# z-score column -> the column it standardises
ZSCORES = {"rpm_zscore": "rpm", "torque_zscore": "torque", "power_zscore": "power",
           "wear_zscore": "tool_wear", "temp_diff_zscore": "temp_diff"}

# --- fixed values: context defaults ----------------------------------------------------
ENV_DEFAULTS = {
    "ambient_temp": 293.0,
    "ambient_humidity": 55.0,
    "atmospheric_pressure": 1013.0,
    "grid_voltage_fluctuation": 0.0,
    "factory_load_density": 0.5,
    "operator_skill_proxy": 3,
    "particulate_matter_pm10": 40.0,
    "ambient_vibration_noise": 1.0,
}
ENV_FIELDS = list(ENV_DEFAULTS)

# --- fixed values: rules ---------------------------------------------------------------
TYPE_CODES = {"L": 0, "M": 1, "H": 2}
TYPE_LABELS = {0: "L (Low)", 1: "M (Medium)", 2: "H (High)"}
OSF_LIMIT = {0: 11000, 1: 12000, 2: 13000}
OSF_LIMIT_UNKNOWN = 12000
RISK_TIERS = [(0.05, "Low"), (0.20, "Medium"), (0.50, "High")]
TOP_TIER = "Critical"
TIERS = ["Low", "Medium", "High", "Critical"]
WINDOWS = (5, 15)
CONTEXT_WINDOWS = (5, 30)
BUFFER_LEN = 30
N_SESSIONS = 40
FLEET_SIZE = 12
HISTORY_LEN = 60
ALERTS_KEPT = 50
NOISE_TIERS = [("Baseline (0%)", 0.0), ("Low Distortion (1%)", 0.01),
               ("Moderate Jitter (5%)", 0.05), ("Severe Corruption (10%)", 0.10)]
NOISE_KEYWORDS = ["temperature", "speed", "torque", "wear", "temp", "rpm"]
TWF_DISTANCE_EDGES = [-300, 0, 50, 100, 150, 300]

# --- fixed values: texts ---------------------------------------------------------------
REASONS = {
    "twf_risk_flag": "Tool Wear Failure risk — tool wear in critical replacement window",
    "hdf_risk_flag": "Heat Dissipation Failure risk — low temp differential + low rotational speed",
    "pwf_risk_flag": "Power Failure risk — power output outside safe operating band",
    "osf_risk_flag": "Overstrain Failure risk — torque x tool wear exceeds type-rated threshold",
}
ACTIONS = {
    "twf_risk_flag": "Schedule tool replacement before next shift.",
    "hdf_risk_flag": "Check coolant/heat dissipation system and rotational speed setpoint.",
    "pwf_risk_flag": "Inspect power supply/load — running outside rated power band.",
    "osf_risk_flag": "Reduce load or replace tool — cumulative strain has exceeded rated threshold.",
    "torque": "Inspect torque/load — trending abnormally high.",
    "tool_wear": "Tool wear trending up — plan replacement soon.",
    "process_temp": "Monitor cooling — process temperature trending high.",
    "power": "Inspect drive/power system — output trending abnormally.",
}
DRIVER_ACTIONS = ["twf_risk_flag", "hdf_risk_flag", "pwf_risk_flag", "osf_risk_flag",
                  "torque", "tool_wear", "process_temp", "power"]
NO_ACTION = "No immediate action — continue routine monitoring."
NOMINAL_REASON = "Nominal operating conditions"
NOMINAL_ACTION = "No action needed."
ROUTINE_RANGE = "No physics thresholds breached in this window — routine monitoring sufficient."
