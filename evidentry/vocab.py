"""Closed vocabularies and numeric constants.

Everything in this module is a fixed value: it must equal the values used by
producers of the evidence tables, otherwise rows are quarantined.
"""

from __future__ import annotations

# --- fixed values: request side ------------------------------------------------
REQUEST_ACTIONS = (
    "read", "write", "create", "update", "delete", "search", "compare",
    "login", "logout", "register", "checkout", "purchase", "other",
)
LOGGED_ACTIONS = REQUEST_ACTIONS + ("events",)
ENDPOINT_CLASSES = (
    "public_content", "compare_index", "compare_noindex", "challenge_worker",
    "other_public", "account", "login", "checkout", "other",
)
PUBLIC_CRAWLER_ENDPOINTS = ("public_content", "compare_index", "other_public")
ROLLOUT_ENDPOINTS = ("public_content", "compare_index", "compare_noindex", "other_public")
ROLLOUT_ENDPOINTS_SORTED = tuple(sorted(ROLLOUT_ENDPOINTS))
COHORTS = (
    "standard", "reduced_motion", "keyboard_only", "fallback_path",
    "sensor_missing", "unknown",
)
CRAWLER_CLASSES = (
    "unknown", "search_indexer", "answer_engine", "training_crawler",
    "user_triggered_agent", "preview", "monitoring", "other",
)
BENEFICIAL_CRAWLERS = ("search_indexer", "answer_engine", "user_triggered_agent", "preview")
CRAWLER_VERIFICATIONS = ("unknown", "ip_ua_registry", "fcrdns_ua", "http_signature")
TRANSPORT_PROTOCOLS = ("http1", "http2", "http3", "unknown")
TRANSPORT_SECURITY = ("direct_tls", "trusted_proxy_tls", "plaintext", "unknown")
ADDRESS_SOURCES = ("direct", "trusted_proxy", "invalid_trusted_proxy", "unknown")
FINGERPRINT_CLASSES = ("unknown", "browser_consistent", "automation_consistent", "anomalous")
FINGERPRINT_METHODS = ("unknown", "tls", "http2", "tls_http2")
NETWORK_REPUTATIONS = ("unknown", "low_risk", "elevated_risk", "high_risk")
NETWORK_TYPES = (
    "unknown", "residential", "mobile", "hosting", "enterprise", "education", "anonymizer",
)
CHALLENGE_VERDICTS = ("suspicious", "failed", "blocked", "allowed", "passed", "unknown")
ACTIONS = ("allow", "observe", "delay", "throttle", "challenge", "block")
RISKY_ACTIONS = ("delay", "throttle", "challenge", "block")
MODES = ("shadow", "canary", "enforce")
BROWSER_EVENT_KINDS = ("pointer", "scroll", "visibility", "navigation", "performance")

# --- fixed values: local evidence side -------------------------------------------
LOCAL_SOURCES = (
    "access_gateway", "browser_sensor", "challenge_service", "policy_engine",
    "decoy_service", "outcome_service",
)
LOCAL_ENDPOINTS = (
    "public_content", "account", "authentication", "transaction", "api", "decoy", "other",
)
SENSITIVE_ENDPOINTS = ("account", "authentication", "transaction")
LOCAL_ACTIONS = ("read", "write", "authenticate", "other")
STATUS_CLASSES = ("success", "redirect", "client_error", "server_error", "unknown")
COLLECTION_STATES = ("complete", "partial", "missing")
LEVELS = ("none", "low", "medium", "high")
DECOY_LEVELS = ("none", "rendered", "touched", "submitted")
CHALLENGE_STATES = ("none", "issued", "passed", "failed", "abandoned", "fallback")
LABEL_CLASSES = ("unknown", "human_confirmed", "operator_confirmed_abuse")
LABEL_PROVENANCES = ("none", "authenticated_account", "operator_review")
LABEL_CONFIDENCES = ("unknown", "confirmed")
LABEL_TRIPLES = (
    ("unknown", "none", "unknown"),
    ("human_confirmed", "authenticated_account", "confirmed"),
    ("human_confirmed", "operator_review", "confirmed"),
    ("operator_confirmed_abuse", "operator_review", "confirmed"),
)

# --- fixed values: delayed outcomes ----------------------------------------------
OUTCOMES = (
    "human_confirmed", "operator_confirmed_abuse", "successful_action",
    "challenge_passed", "challenge_failed", "challenge_abandoned",
    "appeal_requested", "fallback_used", "unknown",
)
OUTCOME_TRIPLES = (
    ("human_confirmed", "authenticated_account", "confirmed"),
    ("human_confirmed", "operator_review", "confirmed"),
    ("operator_confirmed_abuse", "operator_review", "confirmed"),
    ("successful_action", "server_observed", "confirmed"),
    ("challenge_passed", "server_observed", "confirmed"),
    ("challenge_failed", "server_observed", "confirmed"),
    ("challenge_abandoned", "server_observed", "confirmed"),
    ("appeal_requested", "server_observed", "confirmed"),
    ("appeal_requested", "user_feedback", "confirmed"),
    ("fallback_used", "server_observed", "confirmed"),
    ("fallback_used", "user_feedback", "confirmed"),
    ("unknown", "unknown", "unknown"),
)
TERMINAL_OUTCOMES = ("challenge_passed", "challenge_failed", "challenge_abandoned", "fallback_used")

# --- fixed values: versions ------------------------------------------------------
POLICY_VERSION = "default-v5"
MODEL_VERSION = "transparent-baseline-v13"

# --- fixed values: identifier patterns -------------------------------------------
STABLE_VALUE = r"^[A-Za-z0-9_.:-]{1,128}$"
ROLLOUT_ID = r"^[a-z0-9][a-z0-9_.:-]{2,63}$"
DETECTOR_ID = r"^[a-z][a-z0-9_]{2,63}$"
EVIDENCE_CODE = r"^[A-Z][A-Z0-9_]{2,63}$"
SESSION_KEY = r"^[A-Za-z0-9_-]{22}$"

MICROS = 1_000_000
MINUTE_US = 60 * MICROS
