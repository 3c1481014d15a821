"""Record shapes: persona documents, run logs, memory nodes, facts and edges."""

from __future__ import annotations

TURN = "struct<role:string,content:string>"
QUESTION = "struct<question_id:string,question:string,answer:string,conflict_type:string,ability_target:string,difficulty:string>"
SESSION = (
    "struct<Session_ID:int,Date:string,Session_Type:string,Event_Types:array<string>,Session_Outline:string,"
    f"Session_Dialogue:map<string,array<{TURN}>>,Session_Questions:array<{QUESTION}>,"
    "Static_Conflict_Information:array<struct<Conflict_ID:string,Role:string,Target_Field_Path:string,Value:string>>,"
    "Conditional_Conflict_Information:array<struct<Conflict_ID:string,Rule_ID:string,Role:string,Item:string,Condition:string>>,"
    "Others_Dynamic_Information:array<struct<Attribute:string,Role:string,Value:string>>,"
    "Updated_Attributes:array<struct<Attribute:string,Before:string,After:string>>>"
)
PERSONA = f"ID string, Full_Session_Chain array<{SESSION}>, metadata struct<persona_seed:string>"
NODE = "id string, scope_id string, chain_id string, node_type string, text string, entities array<string>, event_time_start string, event_time_end string, valid_from string, valid_to string, confidence double, importance double, metadata string"
FACT = "id string, scope_id string, state_id string, subject string, dimension string, aspect string, value string, valid_from string, valid_to string, confidence double, status string"
EDGE = "id string, scope_id string, source string, target string, type string, trust string, confidence double"
CHAIN = "id string, scope_id string, topic_id string, rolling_summary string"
API_CALL = "provider string, timestamp string, success boolean, token_usage struct<prompt_tokens:long,completion_tokens:long>, module string"
#: Kinds of nodes, and of edges in three families.
NODE_TYPES = ("event", "semantic_state", "chain_head")
NORMAL_TIMES = ("absolute", "resolved_relative")
