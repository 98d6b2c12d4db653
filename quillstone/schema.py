"""Row types, enumerations and constants of the knowledge store."""

from __future__ import annotations

STATUSES = ("ACTIVE", "SUPERSEDED", "CONTRADICTED", "PROMOTED", "STALE")
#: When several passes change one row, the strongest status wins.
STRENGTH = {"ACTIVE": 0, "PROMOTED": 1, "STALE": 2, "SUPERSEDED": 3, "CONTRADICTED": 4}
ROLES = ("SUBJECT", "OBJECT", "OTHER")
#: Authority tiers, strongest first; their place in the list is the ordinal.
TIERS = ("PRIMARY", "SECONDARY", "DERIVED", "UNKNOWN")
TIER_OF_KIND = {"connector": "PRIMARY", "uri": "SECONDARY", "file": "SECONDARY", "content": "DERIVED"}
TRUST_OF_TIER = {"PRIMARY": 0.9, "SECONDARY": 0.75, "DERIVED": 0.6, "UNKNOWN": 0.5}
KNOWLEDGE_TYPES = ("SEMANTIC", "EPISODIC", "PROCEDURAL", "WORKING")
LIFECYCLES = ("PROJECTED", "ADOPTED", "SKIPPED", "FAILED", "STALE")
OUTCOMES = ("MARKED", "TRANSITIONED", "HARD_DELETED", "SKIPPED")
EDGE_HAS_PROPOSITION, EDGE_MENTIONS, EDGE_HAS_ENTITY, EDGE_GROUNDED_IN = "HAS_PROPOSITION", "MENTIONS", "HAS_ENTITY", "GROUNDED_IN"
TRUST_KEY = "trust_score"

#: Row types as DDL, so that this module can be imported where there is no session.
MENTION = "struct<span:string,type:string,resolved_id:string,role:string>"
TEMPORAL = "struct<observed_at:timestamp,valid_from:timestamp,valid_to:timestamp,invalidated_at:timestamp,supersedes:array<string>,contradicts:array<string>>"
PROPOSITIONS = (
    f"""id string, context_id string, text string, mentions array<{MENTION}>, confidence double, decay double,
    importance double, reasoning string, grounding array<string>, created timestamp, content_revised timestamp,
    metadata_revised timestamp, pinned boolean, last_accessed timestamp, status string, level int, source_ids array<string>,
    reinforce_count int, trust_score double, metadata map<string,string>, uri string, temporal {TEMPORAL}"""
)
PROVENANCE = "proposition_id string, kind string, key string, display string, chunk_id string, start_offset int, end_offset int, content_hash string"
ENTITIES = "id string, name string, description string, labels array<string>, properties map<string,string>"
EDGES = "source_id string, target_id string, type string, confidence double, decay double, description string, source_ids array<string>, authority string"
RELATIONS = "ord int, predicate string, knowledge_type string, subject_type string, object_type string, min_confidence double, min_authority string, demote_to string"
FACTS = "predicate string, arg0 string, arg1 string, confidence double, source_ids array<string>"
