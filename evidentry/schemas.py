"""Explicit schemas of the evidence tables (never inferred)."""

from __future__ import annotations

LABEL = "struct<class:string,provenance:string,confidence:string>"
EVIDENCE = ("struct<collection_status:string,automation_evidence:string,abuse_intent_evidence:string,"
            "continuity_evidence:string,decoy_interaction:string,challenge_lifecycle:string>")
LOCAL_INPUT = (
    "schema_version string, observed_at string, subject_ref string, session_ref string, "
    "source string, endpoint_class string, action_class string, status_class string, "
    f"evidence {EVIDENCE}, label {LABEL}")
LOCAL_EVENT = (
    "line_no long, observed_at timestamp, subject_id string, session_id string, source string, "
    f"endpoint_class string, action_class string, status_class string, evidence {EVIDENCE}, label {LABEL}")
OBSERVATIONS = (
    "struct<user_agent_present:boolean,browser_event_count:int,browser_events_verified:boolean,"
    "honeypot_hits:int,verified_decoy_hits:int,challenge_verdict:string,external_risk_score:double,"
    "policy_alert:boolean,verified_bot:boolean,crawler_class:string,crawler_verification:string,"
    "transport_protocol:string,transport_security:string,client_address_source:string,"
    "edge_fingerprint_class:string,edge_fingerprint_method:string,network_reputation:string,"
    "network_type:string,server_session_verified:boolean>")
REQUEST = (
    "observed_at timestamp, line_no long, session_id string, action string, endpoint_class string, "
    f"evaluation_cohort string, sequence long, observations {OBSERVATIONS}, expected_action string, "
    "expected_computed_action string")
SCORES = "struct<automation_risk:double,abuse_intent_risk:double,account_continuity:double>"
DECISION = (
    "struct<decision_id:string,request_action:string,endpoint_class:string,evaluation_cohort:string,"
    f"action:string,computed_action:string,mode:string,rollout_id:string,scores:{SCORES},"
    "reason_codes:array<string>,policy_version:string,model_version:string,assurance_level:int,"
    "assurance_withheld:boolean>")
OUTCOME = ("struct<decision_id:string,endpoint_class:string,outcome:string,provenance:string,"
           "confidence:string>")
LOG_RECORD = (
    "ingest_order long, schema_version string, kind string, recorded_at timestamp, "
    f"session_key string, decision {DECISION}, outcome {OUTCOME}")
BROWSER_BATCH = (
    "session_id string, sensor_version string, received_at timestamp, line_no long, "
    "events array<struct<sequence:long,elapsed_bucket_ms:long,kind:string,value_bucket:int>>")
