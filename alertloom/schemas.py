"""Declared schemas. Files are read with these, never inferred."""

from __future__ import annotations

EVENT = (
    "struct<format:string,ts:string,host:string,service:string,signal:string,raw:string,window:array<string>,"
    "messages:array<struct<t:string,role:string,text:string>>,channel_kind:string,actor:string,outcome:string>"
)
CHANGE = (
    "struct<id:string,hosts:array<string>,start:string,end:string,status:string,type:string,"
    "expected_signals:array<struct<signal:string,max_impact:string>>>"
)
INCIDENT = (
    "struct<id:string,entity:string,status:string,event_type:string,failure_mode:string,impact:string,urgency:string,priority:string>"
)
CONTEXT = (
    f"struct<asset:struct<host:string,criticality:string,env:string,owner:string>,active_changes:array<{CHANGE}>,"
    f"active_incidents:array<{INCIDENT}>>"
)
EVIDENCE = (
    "struct<primary_type:string,signal:string,impact:string,urgency:string,actionable:boolean,secondary_types:array<string>,"
    "owner:string,secondary_owners:array<string>,established:array<string>,suspected:array<string>,missing_context:array<string>,"
    "threatens_critical:boolean,compromise_evidence:boolean,provisional_reason:string,immediate_action:string>"
)
LABEL = (
    "struct<event_type:string,secondary_types:array<string>,owner:string,secondary_owners:array<string>,impact:string,urgency:string,"
    "priority:string,notification:string,page_now:boolean,page_target:string,response:string,ack_target:string,handling:string,"
    "provisional:boolean,provisional_reason:string,missing_facts:array<string>,triage_owner:string,fact_finding_deadline:string,"
    "owner_review_target:string,immediate_action:string,applied_rules:array<struct<rule:string,reason:string>>,rubric_version:string>"
)
CASE = (
    "case_id string, cohort string, split string, dataset_kind string, pair_id string, pair_role string, parent_case_id string, "
    "template_family string, wrapper_family string, archetype string, variant string, seed_source string, template_id string, "
    "attack_technique string, slang_term string, pair_relation string, spoof_kind string, "
    f"event {EVENT}, context {CONTEXT}, questions array<string>, evidence {EVIDENCE}, label_status string, label {LABEL}, "
    "expected struct<choice:string,noul:boolean,score:string>, _bad string"
)
CASE_V1 = "id string, pair_id string, state string, question string, kind string, target string, options array<string>, adversarial boolean, _bad string"
TEMPLATE = (
    "source string, system string, template_id string, template string, upstream_commit string, source_file string, "
    "source_file_sha256 string, license string, num_placeholders int, placeholder_kinds array<string>, attack_technique string, "
    "executor string, input_arguments map<string,string>, _bad string"
)
THREAD = (
    "thread_id string, channel string, channel_kind string, dataset_kind string, synthetic boolean, trust string, "
    "event_ref struct<kind:string,id:string>, original_message_count int, truncated_messages int, truncated_chars_messages int, "
    "pair_id string, scenario string, messages array<struct<ts:string,role:string,author:string,text:string>>, _bad string"
)
