"""Column names and versions that several modules share."""

SYMBOL = "underlying_symbol"
DATE = "quote_date"
TARGET_DATE = "target_date"
DECISION_TS = "effective_decision_timestamp"
TARGET_TS = "target_effective_decision_timestamp"
DAY = (SYMBOL, DATE)

# Completion states and artifact identities of the surface tables.
OBSERVED = "observed"
INTERPOLATED = "interpolated"
EXTRAPOLATED = "extrapolated_boundary_fill"
MISSING = "missing"
GRID_SCHEMA_VERSION = "surface_grid_v2"
MATURITY_COORDINATE = "ACT/365_years_from_effective_decision_to_last_tradable_close"
MONEYNESS_COORDINATE = "log_spot_moneyness"
SURFACE_VERSION = "completed_surface_v1"

SURFACE_IDS = (
    "surface_grid_schema_version",
    "surface_grid_hash",
    "maturity_coordinate",
    "moneyness_coordinate",
    "target_surface_version",
    "surface_config_hash",
)
