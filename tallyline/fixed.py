"""Fixed values of the billing data contract.

Everything in this file must equal the published contract for results to
agree (enumerations, thresholds, texts, formats). There is no logic here.
"""

# -- fixed values: event types, in contract order ---------------------------
EVENT_TYPES = [
    "subscription_created",
    "subscription_updated",
    "subscription_cancelled",
    "invoice_paid",
    "invoice_failed",
    "invoice_refunded",
    "invoice_disputed",
    "usage_recorded",
    "payment_succeeded",
    "payment_failed",
    "refund_issued",
    "dispute_created",
    "dispute_won",
    "dispute_lost",
]

SUBSCRIPTION_TYPES = [
    "subscription_created",
    "subscription_updated",
    "subscription_cancelled",
]
MONEY_TYPES = [
    "invoice_paid",
    "invoice_refunded",
    "invoice_disputed",
    "payment_succeeded",
    "payment_failed",
]
REFUND_TYPES = ["invoice_refunded", "refund_issued"]
DISPUTE_TYPES = ["invoice_disputed", "dispute_created", "dispute_lost"]
PAYMENT_TYPES = ["invoice_paid", "payment_succeeded"]
INVOICED_TYPES = ["invoice_paid", "invoice_failed"]

# -- fixed values: the eleven fields of the source hash, in hash order -------
HASH_FIELDS = [
    "tenant_id",
    "project_id",
    "event_id",
    "event_type",
    "timestamp",
    "customer_id",
    "subscription_id",
    "invoice_id",
    "amount_cents",
    "currency",
    "plan_id",
]

# -- fixed values: enumerations ----------------------------------------------
SUBSCRIPTION_STATUSES = ["active", "canceled", "past_due", "unpaid", "paused"]
ANOMALY_TYPES = [
    "missing_invoice",
    "double_charge",
    "refund_spike",
    "dispute_spike",
    "payment_failure_spike",
    "usage_drop",
    "mrr_discrepancy",
    "duplicate_event",
    "out_of_sequence",
]
SEVERITIES = ["low", "medium", "high", "critical"]
FINDING_SEVERITY_ORDER = ["critical", "high", "medium", "low", "info"]
DISCREPANCY_REASONS = [
    "missing_invoice",
    "double_charge",
    "incorrect_plan",
    "currency_mismatch",
    "period_mismatch",
    "other",
]
COST_CATEGORIES = ["subscription", "usage", "refund", "dispute", "other"]

# -- fixed values: formats ---------------------------------------------------
TENANT_PATTERN = r"^[a-z0-9-]+\z"
PROJECT_PATTERN = r"^[a-z0-9-_]+\z"
CURRENCY_PATTERN = r"^[A-Z]{3}\z"
# ISO-8601 UTC, `Z` only, any number of fraction digits
TIMESTAMP_PATTERN = (
    r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
    r"T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?Z\z"
)

# -- fixed values: report defaults -------------------------------------------
CONTRACT_VERSION = "1.0.0"
MODULE_ID = "finops"
REPORT_TYPE = "finops"
REPORT_ID_PREFIX = "finops-report-"
STABLE_TIMESTAMP = "1970-01-01T00:00:00.000Z"
DEFAULT_PERIOD_START = "2024-01-01T00:00:00.000Z"
DEFAULT_PERIOD_END = "2024-01-31T23:59:59.999Z"
COST_CAPABILITY = "finops.cost_snapshot"

# -- fixed values: job types and their time limits ---------------------------
JOB_ANOMALY_SCAN = "autopilot.finops.anomaly_scan"
JOB_CHURN_RISK = "autopilot.finops.churn_risk_report"
JOB_RECONCILE = "autopilot.finops.reconcile"
JOB_TYPES = [JOB_ANOMALY_SCAN, JOB_CHURN_RISK, JOB_RECONCILE]

# -- fixed values: texts of the anomaly detectors ----------------------------
ANOMALY_ACTIONS = {
    "duplicate_event": "Review event ingestion pipeline for duplicate handling",
    "missing_invoice": "Verify invoice generation and payment collection for this subscription",
    "double_charge": "Immediately review and refund duplicate charges",
    "refund_spike": "Review refund patterns and identify root cause",
    "dispute_spike": "Review fraud patterns and improve dispute prevention",
    "payment_failure_spike": "Review payment method and consider customer outreach",
    "cancel_before_create": "Review event data integrity",
    "payment_after_cancel": "Verify if payment is legitimate or requires refund",
}

# -- fixed values: texts of the churn report ---------------------------------
LEVEL_ACTIONS = {
    "critical": "Immediate: Contact customer success team for intervention",
    "high": "Schedule proactive customer outreach within 48 hours",
    "medium": "Monitor for additional signals; include in next health review",
}
SIGNAL_ACTIONS = {
    "payment_failures": "Payment: Review billing settings and payment methods",
    "usage_drop": "Usage: Investigate adoption blockers with customer",
    "support_tickets": "Support: Ensure all tickets resolved satisfactorily",
    "plan_downgrade": "Revenue: Explore upgrade incentives or alternative plans",
    "no_recent_login": "Engagement: Send re-activation campaign",
}
SIGNAL_NOTES = {
    "payment_failures": "Payment failures correlate with involuntary churn risk",
    "usage_drop": "Usage drops often precede voluntary churn",
    "support_tickets": "Support friction correlates with churn intent",
    "plan_downgrade": "Downgrades often precede full cancellation",
    "no_recent_login": "Inactivity indicates potential disengagement",
}

# -- fixed values: cost refusal texts ----------------------------------------
REFUSE_NO_DATA = "INSUFFICIENT_DATA: No billing events or ledger provided"
REFUSE_NO_EVENTS = "INSUFFICIENT_EVENTS: At least one billing event required"
REFUSE_CURRENCY = "CURRENCY_MISMATCH: Multiple currencies detected"
REFUSE_PERIOD = "INVALID_PERIOD: period_start must be before period_end"

# -- fixed values: redaction patterns and words -------------------------------
# `WS` spells out the white space class of the contract, which is wider than
# the ASCII one of Java and RE2.
WS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
ASSIGNED_KEY = r"(?i)[a-zA-Z0-9_]+_key" + WS + r"*[:=]" + WS + r"*['\"]?[a-zA-Z0-9_-]{16,}['\"]?"
ASSIGNED_TOKEN = r"(?i)[a-zA-Z0-9_]+_token" + WS + r"*[:=]" + WS + r"*['\"]?[a-zA-Z0-9_-]{16,}['\"]?"
ASSIGNED_SECRET = r"(?i)[a-zA-Z0-9_]+_secret" + WS + r"*[:=]" + WS + r"*['\"]?[a-zA-Z0-9_-]{16,}['\"]?"
SK_KEY = r"sk-[a-zA-Z0-9]{32,}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CLOUD_KEY_ID = r"AKIA[0-9A-Z]{16}"
PEM_HEADER = r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----"
LIVE_PAYMENT_KEY = r"sk_live_[0-9a-zA-Z]{24,}"
ACCESS_TOKEN = r"ghp_[0-9a-zA-Z]{36}"
LONG_TOKEN = r"[a-zA-Z0-9_-]{24,}"

REDACTED = "[REDACTED]"
TYPED_PATTERNS = [
    ("key", ASSIGNED_KEY, "[REDACTED_KEY]"),
    ("token", ASSIGNED_TOKEN, "[REDACTED_TOKEN]"),
    ("secret", ASSIGNED_SECRET, "[REDACTED_SECRET]"),
    ("sk", SK_KEY, "[REDACTED_SK]"),
    ("email", EMAIL, "[REDACTED_EMAIL]"),
]
INLINE_PATTERNS = [
    ("cloud_key_id", CLOUD_KEY_ID, REDACTED),
    ("pem_header", PEM_HEADER, REDACTED),
    ("live_payment_key", LIVE_PAYMENT_KEY, REDACTED),
    ("sk", SK_KEY, REDACTED),
    ("access_token", ACCESS_TOKEN, REDACTED),
    ("key", ASSIGNED_KEY, REDACTED),
    ("token", ASSIGNED_TOKEN, REDACTED),
    ("secret", ASSIGNED_SECRET, REDACTED),
]
WHOLE_VALUE_PATTERNS = [
    CLOUD_KEY_ID,
    PEM_HEADER,
    LIVE_PAYMENT_KEY,
    SK_KEY,
    ACCESS_TOKEN,
    EMAIL,
]
PATTERN_LIST = [
    ("email", EMAIL, "[REDACTED_EMAIL]"),
    ("token", LONG_TOKEN, "[REDACTED_TOKEN]"),
]
SENSITIVE_KEY_WORDS = [
    "password",
    "secret",
    "token",
    "api_key",
    "apikey",
    "access_key",
    "private_key",
    "authorization",
    "credential",
    "stripe_key",
    "aws_secret",
    "client_secret",
    "refresh_token",
    "session_token",
]

# -- fixed values: threshold profiles ------------------------------------------
ANOMALY_DEFAULTS = {
    "refund_spike_threshold_cents": 100000,
    "refund_spike_threshold_pct": 10.0,
    "dispute_spike_threshold": 5,
    "payment_failure_spike_threshold": 0.25,
    "duplicate_event_window_seconds": 300,
    "usage_drop_threshold_pct": 50.0,
}
CHURN_DEFAULTS = {
    "payment_failure_weight": 0.3,
    "usage_drop_weight": 0.25,
    "support_ticket_weight": 0.2,
    "plan_downgrade_weight": 0.15,
    "inactivity_weight": 0.1,
    "risk_score_low_threshold": 30.0,
    "risk_score_medium_threshold": 50.0,
    "risk_score_high_threshold": 75.0,
}
# what each shipped profile changes against the defaults above
PROFILE_CHANGES = {
    "base": {},
    "jobforge": {
        "refund_spike_threshold_cents": 50000,
        "payment_failure_spike_threshold": 0.2,
        "payment_failure_weight": 0.35,
        "usage_drop_weight": 0.3,
    },
    "settler": {
        "refund_spike_threshold_cents": 25000,
        "dispute_spike_threshold": 3,
        "duplicate_event_window_seconds": 60,
        "payment_failure_weight": 0.4,
        "risk_score_high_threshold": 70.0,
    },
    "readylayer": {
        "usage_drop_threshold_pct": 30.0,
        "refund_spike_threshold_pct": 5.0,
        "usage_drop_weight": 0.35,
        "support_ticket_weight": 0.25,
    },
    "aias": {
        "usage_drop_threshold_pct": 40.0,
        "refund_spike_threshold_cents": 75000,
        "usage_drop_weight": 0.4,
        "inactivity_weight": 0.15,
    },
    "keys": {
        "duplicate_event_window_seconds": 180,
        "payment_failure_spike_threshold": 0.15,
        "payment_failure_weight": 0.25,
        "support_ticket_weight": 0.3,
    },
}
DEFAULT_REPORT_PROFILE = "jobforge"

# -- fixed values: request metadata -------------------------------------------
JOB_TIMEOUTS = {JOB_ANOMALY_SCAN: 300, JOB_CHURN_RISK: 600, JOB_RECONCILE: 300}
JOB_MAX_RETRIES = 3
DRY_RUN_FIELD = "jobforge_dry_run"
ACTION_FIELDS = ["action", "action_type", "action_name"]

# -- fixed values: stand-alone requests ----------------------------------------
STANDALONE_CAPABILITIES = {
    JOB_ANOMALY_SCAN: "anomaly_detect",
    JOB_CHURN_RISK: "churn_assess",
    JOB_RECONCILE: "mrr_reconcile",
}
CHURN_NOTE = "Operational insights only - not financial advice"
SCAN_THRESHOLDS = {
    "refund_spike_threshold_cents": 100000,
    "dispute_spike_threshold": 5,
    "payment_failure_spike_threshold": 0.25,
}
CHURN_WEIGHTS = {
    "payment_failure": 0.3,
    "usage_drop": 0.25,
    "support_tickets": 0.2,
    "plan_downgrade": 0.15,
    "inactivity": 0.1,
}
