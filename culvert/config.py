"""Thresholds of the consistency checks, in one place."""

UTILITIES = ("SD", "SS", "W")
GRAVITY = ("SD", "SS")

COHERENCE_VIABLE = 0.40
COHERENCE_ESCALATE = 0.70
COHERENCE_PREMIUM = 0.50
CROWN_SPREAD_FT = 0.5
CROWN_DROP_RATIO = 10.0
CROWN_MIN_DROP_FT = 2.0
BAD_RATIO = 0.30
STATION_DELTA_FT = 0.5
CROWN_SLOPE_RATIO = 5.0
HINT_CLOSE_FT, HINT_MEDIUM_FT, HINT_FAR_FT = 5.0, 10.0, 25.0
INFER_HIGH_FT, INFER_MEDIUM_FT, INFER_LOW_FT = 2.0, 10.0, 30.0
GRADE_A, GRADE_B, GRADE_C = 0.10, 0.30, 0.50
MERGE_STATION_FT, MERGE_OFFSET_FT = 3.0, 1.0
EDGE_LENGTH_TOL, EDGE_SLOPE_TOL = 2.0, 0.0010
INVERT_TOL = 0.01
SLOPE_TOL = 0.0002
RIM_TOL = 0.10
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 0.70, 0.40
PACKAGE_WARN, PACKAGE_FAIL = 0.15, 0.30

#: Structure types, without separators, of each utility.
UTILITY_TYPES = {
    "SD": ("SDMH", "SDCB", "CB", "INLET", "DI", "CATCHBASIN"),
    "SS": ("SSMH", "CO", "CLEANOUT"),
    "W": (
        "WV", "GV", "FH", "HYDRANT", "BEND", "TEE", "WATERVALVE", "GATEVALVE", "FIREHYDRANT", "BLOWOFF",
        "AIRVALVE", "PRV", "METER", "REDUCER", "SERVICECONNECTION",
    ),
}

#: Water fittings, which need no offset.
WATER_FITTINGS = (
    "gate_valve", "fire_hydrant", "blow_off", "air_valve", "prv", "meter", "tee", "reducer", "bend", "service_connection",
)

STATUSES = ("ok", "dry_run", "skipped_low_coherence", "validation_error", "runtime_error", "missing_text_layer")
CONFIDENCES = ("none", "low", "medium", "high")
