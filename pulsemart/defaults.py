"""They decide results and must not drift between operators."""

# Hours of telemetry re-read by each load: the full batch, and the change-fed batch.
BATCH_LOOKBACK_HOURS = 168
CHANGE_LOOKBACK_HOURS = 2

# Retention in days of the mart and its rollups, and of raw samples.
MART_RETENTION_DAYS = 365
RAW_RETENTION_DAYS = 90

# Report list paging.
LIST_LIMIT = 30
LIST_LIMIT_MIN = 1
LIST_LIMIT_MAX = 100

# Consent events shown per profile, rows shown by the recent-change report, days by the fleet report.
CONSENT_HISTORY_LIMIT = 50
RECENT_CHANGES_LIMIT = 10
FLEET_DAYS = 7

# A message that comes again within this time of its first arrival is the same delivery.
REDELIVERY = "1 day"

# Consumer lag above which the change feed counts as degraded.
LAG_THRESHOLD = 1000

# Health bands: (good from, warn from) for rates and battery, warn below for errors.
SUCCESS_BANDS = (95, 85)
BATTERY_BANDS = (50, 20)
ERROR_WARN_BELOW = 5

# Domains of coded columns.
DEVICE_STATUSES = ("manufactured", "sold", "active", "maintenance", "retired")
MODEL_CATEGORIES = ("arm", "leg", "hand", "finger")
REGIONS = ("russia", "europe")
MOVEMENT_TYPES = ("grip", "release", "rotate_left", "rotate_right", "flex", "extend")
CONSENT_ACTIONS = ("granted", "revoked")
CHANGE_OPERATIONS = ("c", "u", "d", "r")

# Rows of one nested document page; longer documents continue on further pages.
