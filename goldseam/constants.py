"""Fixed values.

Everything in this module must keep exactly these values for results to be
comparable between runs, versions and engines: type names, lookup tables, word
lists, patterns, thresholds and code names.
"""

# --- cast policy -----------------------------------------------------------
POLICY_VERSION = "phase3.1-policy-v1"
CAST_TARGETS = ("int64", "float64", "bool", "object")
BLOCKED_TARGET_SPELLINGS = ("Int64", "Float64", "Boolean")
NULL_REJECTING_TARGETS = ("int64", "bool")

INTEGER_TEXT = r"^[+-]?(0|[1-9][0-9]*)\z"
DECIMAL_TEXT = r"^[+-]?(0|[1-9][0-9]*)([.][0-9]+)?\z"
ASCII_WHITESPACE = " \t\r\n\f\x0b"
TRUE_TOKENS = ("true", "1")
FALSE_TOKENS = ("false", "0")
NON_FINITE_TOKENS = (
    "nan", "-nan", "+nan",
    "inf", "-inf", "+inf",
    "infinity", "-infinity", "+infinity",
)

# Doubles bounding int64: the lower bound is inside, the upper one outside.
INT64_LOW = -9.223372036854775808e18
INT64_HIGH = 9.223372036854775808e18

# --- reason codes and statuses ---------------------------------------------
PARSE_ERROR = "PARSE_ERROR"
FRACTIONAL_VALUE = "FRACTIONAL_VALUE"
OUT_OF_RANGE = "OUT_OF_RANGE"
PRECISION_LOSS = "PRECISION_LOSS"
AMBIGUOUS_BOOLEAN = "AMBIGUOUS_BOOLEAN"
NON_FINITE_NUMBER = "NON_FINITE_NUMBER"
NULL_TARGET_INCOMPATIBLE = "NULL_TARGET_INCOMPATIBLE"
UNSUPPORTED_SOURCE_VALUE = "UNSUPPORTED_SOURCE_VALUE"
UNSUPPORTED_TARGET_DTYPE = "UNSUPPORTED_TARGET_DTYPE"
ROUND_TRIP_MISMATCH = "ROUND_TRIP_MISMATCH"

CONVERSION_STATUSES = ("SAFE", "UNSAFE", "UNSUPPORTED", "ERROR")

DECISION_FIELDS = (
    "column_name", "status", "source_dtype", "target_dtype", "policy_version",
    "total_count", "null_count", "converted_count", "failed_count",
    "diagnostic_count", "reason_codes",
)

# --- logical types -----------------------------------------------------------
EXTENDED_DTYPES = ("decimal", "date", "datetime", "datetime_tz", "uuid", "json")

DATABASE_TYPE_TO_DTYPE = {
    "bigint": "int64",
    "integer": "int64",
    "smallint": "int64",
    "text": "object",
    "character varying": "object",
    "character": "object",
    "double precision": "float64",
    "real": "float64",
    "boolean": "bool",
    "numeric": "decimal",
    "date": "date",
    "timestamp without time zone": "datetime",
    "timestamp with time zone": "datetime_tz",
    "uuid": "uuid",
    "json": "json",
    "jsonb": "json",
}

DTYPE_TO_DATABASE_TYPE = {
    "int64": "bigint",
    "float64": "double precision",
    "object": "text",
    "bool": "boolean",
    "decimal": "numeric",
    "date": "date",
    "datetime": "timestamp without time zone",
    "datetime_tz": "timestamp with time zone",
    "uuid": "uuid",
    "json": "jsonb",
}

# Frequent dtype spellings that a Gold schema may declare besides the logical ones. Whatever else pandas knows
# as a dtype may be declared too; pandas itself is asked for the rest.
FREQUENT_FRAME_DTYPE = (
    r"^(u?int(8|16|32|64)|U?Int(8|16|32|64)|float(16|32|64)|Float(32|64)"
    r"|complex(64|128)|bool|boolean|object|str|string|category"
    r"|timedelta64\[(s|ms|us|ns)\]|datetime64\[(s|ms|us|ns)(, UTC)?\])\z"
)

# --- plans and governance ------------------------------------------------------
REORDER_CONFIDENCE = 0.90
RENAME_CONFIDENCE = 0.85
STRICT_CAST_CONFIDENCE = 0.85
DROP_INVALID_CONFIDENCE = 0.70
AUTO_APPROVE_THRESHOLD = 0.92
APPROVAL_THRESHOLD = 0.80
REORDER_PREFIX = "REORDER_COLUMNS TO "
DROP_INVALID_MARKER = "WITH_DROP_INVALID"

COMPONENT_VERSIONS = {
    "profile": "1.0",
    "governance": "1.0",
    "repair": "1.0",
}
REORDER_POLICY_VERSION = "phase3.3-policy-v1"

# --- identifiers, fingerprints, ledgers ----------------------------------------
IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_]{0,62}\z"
MAX_IDENTIFIER_LENGTH = 63
VERSION_SUFFIX_HEX = 16
SCHEMA_NAME = r"^[a-z][a-z0-9_]*\z"
FINGERPRINT = r"^[0-9a-f]{64}\z"
FAILURE_CODE = r"^[A-Z][A-Z0-9_]{1,63}\z"
GOLD_FORMAT_VERSION = 1
PROVENANCE_FORMAT_VERSION = 1
FAILURE_REASON_MAX_LENGTH = 1000

RUN_PURPOSES = ("SIMULATION", "LIVE_REVALIDATION")
TICKET_TAKEN_STATUSES = (
    "PENDING", "RUNNING", "COMPLETED", "ROLLING_BACK", "ROLLED_BACK",
)
TARGET_BUSY_STATUSES = ("PENDING", "RUNNING", "ROLLING_BACK")
STALE_SECONDS = 300
