"""Schemas of the graph and of what it is built from."""

from __future__ import annotations

NODES = "id string, name string, type string, label string, properties map<string,string>, embedding array<float>, sources array<string>, confidence double, created_at timestamp, updated_at timestamp"
EDGES = "eid string, src string, dst string, rel string, t_announce string, t_effective string, source string"
TRIPLE = "struct<subj:string,rel:string,obj:string,time:string,source:string>"
PATHS = f"path_id string, hops int, node_ids array<string>, node_names array<string>, node_labels array<string>, triples array<{TRIPLE}>"
FACTS = (
    "subject string, subject_type string, predicate string, object string, object_type string, confidence double, sentiment double, "
    "temporal struct<t_announce:string,t_effective:string,t_observe:string,t_impact:string>, source_text string, properties map<string,string>"
)
TURNS = "session_id string, seq long, query string, answer string, entities array<string>, entity_ids array<string>, event_names array<string>, at timestamp"
PROFILES = "id string, name string, email string, language string, investor_type string, risk_appetite string, created_at timestamp"
INVESTOR_TYPES, RISK_APPETITES = ("Retail", "Institutional", "Student"), ("Low", "Medium", "High")
