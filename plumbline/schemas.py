"""Record schemas, pinned: sources are read with these and never inferred."""

from __future__ import annotations

CANDIDATE = "struct<ord:int,id:string,text:string>"
QUESTION = f"struct<ord:int,id:string,type:string,instructions:string,criteria:array<{CANDIDATE}>>"
SHARE = "struct<ord:int,id:string,score:double,prob:double>"

REQUEST = f"request_id string, state string, questions array<{QUESTION}>"
RESULT = f"request_id string, model map<string,string>, answers array<struct<question_id:string,type:string,choice:string,shares:array<{SHARE}>>>, input_tokens bigint, calibration string"
SUITE = f"name string, split string, question {QUESTION}, examples array<struct<id:string,text:string,label:string>>, provenance map<string,string>"
TICKET = "id string, group_id string, split string, text string"
ATTEMPT = f"id string, repeat int, seconds double, choice string, shares array<{SHARE}>, error_type string, model string"
PREDICTION = "id string, choice string, probabilities array<double>, ranking array<string>"
RANKING_CASE = f"id string, k int, state string, instructions string, candidates array<{CANDIDATE}>, relevant array<string>"

TRACE_FIELDS = (
    "route string, retrieval array<string>, reranking_input array<string>, reranking array<string>, reranking_complete boolean, context_input array<string>, "
    "context array<string>, context_text string, answer string, errors map<string,string>, blocked map<string,string>, replay boolean"
)
JUDGMENT_FIELDS = "relevance map<string,int>, evidence_sets array<array<string>>, evidence_texts map<string,string>, acceptable_routes array<string>, correct boolean, grounded boolean"
RAG_CASE = f"case_id string, query string, parameters string, case_ord int, {JUDGMENT_FIELDS}"
RAG_ATTEMPT = f"case_id string, repeat int, query string, system string, {TRACE_FIELDS}, output_sha256 string, step_errors array<string>, error_phase string, review_correct boolean, review_grounded boolean, review_scores map<string,double>, duration_seconds double, review_duration_seconds double"
GATE = "metric string, minimum double, maximum double, min_coverage double"

REVIEW_SHEET = "packet_sha256 string, id string, text_json string, reviewer string, label string, notes string"
VOTE = "id string, reviewer int, label string"
TRIAL = "system string, run_id string, case_id string, phase string, i int, seconds double"
SNAPSHOT = "id string, token_ids array<bigint>, pooled array<double>, vector array<double>"
