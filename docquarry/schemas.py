"""Explicit schemas of the stored record kinds."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


ANNOTATION_DDL = (
    "struct<unanswerable:boolean,extractive_spans:array<string>,yes_no:boolean,"
    "free_form_answer:string,evidence:array<string>,highlighted_evidence:array<string>>"
)
BUNDLE_DDL = (
    f"struct<answer:array<{ANNOTATION_DDL}>,annotation_id:array<string>,worker_id:array<string>>"
)
QAS_DDL = (
    "struct<question:array<string>,question_id:array<string>,nlp_background:array<string>,"
    "topic_background:array<string>,paper_read:array<string>,search_query:array<string>,"
    f"question_writer:array<string>,answers:array<{BUNDLE_DDL}>>"
)
TRANSPORT_DDL = (
    "struct<provider_attempt_count:bigint,retry_count:bigint,rate_limit_response_count:bigint,"
    "rate_limit_retry_count:bigint,other_transient_retry_count:bigint,"
    "schema_output_retry_count:bigint,pacing_sleep_seconds:double,"
    "retry_backoff_sleep_seconds:double,retry_after_used:boolean,"
    "final_provider_error_category:string,final_http_status:int,"
    "final_provider_error_type:string,final_provider_error_code:string,"
    "final_retry_decision:string>"
)
_SOURCE = (
    "rank:int,doc_id:string,file_name:string,chunk_id:string,page:int,distance:double,"
    "similarity:double,fusion_score:double,content_preview:string,file_type:string,"
    "doc_type:string,section_header:string"
)



def papers() -> T.StructType:
    """The source dataset, cut down to the columns that are used."""
    return _struct(f"id string, qas {QAS_DDL}, full_text struct<section_name:array<string>>")


SAVED_PAPER_DDL = f"struct<id:string,qas:{QAS_DDL}>"


def answer_attempts() -> T.StructType:
    return _struct(
        f"paper_id string, question_id string, question string, gold_answers {BUNDLE_DDL}, "
        "conversation_id string, raw_answer string, cleaned_answer string, status string, "
        "error string, elapsed_seconds double"
    )


def request_log() -> T.StructType:
    return _struct(
        "timestamp string, conversation_id string, query_id int, kb_mode string, "
        "active_doc_names array<string>, query struct<original:string,rewritten:string>, "
        "retrieval struct<route:string,fusion_alpha:double,retrieval_top_n:int,"
        "rerank_candidate_n:int,rerank_top_k:int,fusion_threshold:double,"
        "latency:struct<total_seconds:double,dense_seconds:double,bm25_seconds:double,"
        "fusion_seconds:double,rerank_seconds:double>,num_fusion_survivors:int,"
        f"num_reranker_candidates:int,raw_retrieval:array<struct<{_SOURCE}>>,"
        f"final_sources:array<struct<{_SOURCE},rerank_score:double>>,rerank_margin:double,"
        "retrieval_relevance:string,relevance_score:double,relevance_explanation:string,"
        "retrieval_eval_latency:double,num_final_sources:int>, "
        "generation struct<answer:string,groundedness_label:string,"
        "groundedness_explanation:string,groundedness_eval_latency:double>, "
        "llm_metrics struct<total_tokens:bigint,latency_seconds:double>"
    )


def judge_attempts() -> T.StructType:
    return _struct(
        "paper_id string, question_id string, judge_model string, evaluator_version string, "
        "resume_key string, attempt_number int, status string, generation_status string, "
        "threshold double, semantic_score double, passed boolean, judge_reason string, "
        "matched_reference_index int, matched_annotation_id string, matched_reference string, "
        "matched_answer_type string, elapsed_seconds double, "
        f"judge_transport {TRANSPORT_DDL}, "
        "reference_evaluations array<struct<reference_index:int,annotation_id:string,"
        "answer_type:string,reference_answer:string,judge_evidence:struct<source:string,"
        "ordered_values:array<string>,sha256:string>,status:string,semantic_score:double,"
        "passed:boolean,judge_reason:string,judge_error:struct<type:string,message:string>,"
        f"judge_transport:{TRANSPORT_DDL}>>"
    )
