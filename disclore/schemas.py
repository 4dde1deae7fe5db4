"""Schemas of the inputs and results, and column guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "struct<eventId:string,eventName:string>"
REPORT = "mayaReportId string, publicationDate string, title string, url string, isPriorityReport boolean, isCorrection boolean, issuer array<struct<issuerName:string>>, events array<struct<eventId:string,eventName:string>>, attachedfiles array<struct<url:string>>"
DAILY = "mayaReports struct<result:array<struct<" + ",".join(x.strip().replace(" ", ":", 1) for x in ("mayaReportId string", "publicationDate string", "title string", "url string", "isPriorityReport boolean", "isCorrection boolean", "issuer array<struct<issuerName:string>>", "events array<struct<eventId:string,eventName:string>>", "attachedfiles array<struct<url:string>>")) + ">>>"
CHUNK = "doc_id string, chunk_id int, text string"
CHUNK_VECTOR = "doc_id string, chunk_id int, vector array<float>"
DOC_VECTOR = "doc_id string, vector array<double>"
PROMPTS = "prompts array<struct<handle:string,category_handle:string,name:string,prompt_text:string,text:string,prompt:string>>"
SUMMARY = "doc_id string, category_handle string, summary string, keywords array<string>, error struct<type:string,message:string,actual_content_summary:string>, raw_response string"
_SCORES = "struct<accuracy:int,completeness:int,conciseness:int,clarity:int,relevance:int>"
JUDGEMENT = f"analysis struct<gold_standard_summary:string,evaluation_scores:map<string,map<string,int>>,verdict:struct<winner:string,rationale:string>>, optimized_prompt string"
LOG = "file_id string, processed_at string, input_key string, output_key string, status string, duration_ms bigint, error_message string"
ENRICHMENT = ("company_name_he", "company_name_en", "registration_number", "form_type", "submission_date", "subject", "proof_id")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``, or a ValueError that names the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that the frame has."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise ValueError(f"none of {', '.join(names)} among {', '.join(df.columns)}")


def first_prefixed(df: DataFrame, prefix: str) -> str:
    for n in df.columns:
        if n.startswith(prefix):
            return n
    raise ValueError(f"no column starts with {prefix}")
