"""Schemas of postings, verdicts and the tables that runs keep."""

from __future__ import annotations

JOB = (
    "ord bigint, title string, company string, location string, job_url string, description string, job_type string, source string, date_posted string, posted_ts timestamp, "
    "origin string, pre_flagged_low_quality boolean, pre_flagged_trusted boolean, similarity double, weighted_score double"
)
VERDICT = "is_valid boolean, verdict string, tech_fit int, experience_fit int, logistics_fit int, match_percentage int, compensation string, effort string, suspicious boolean, scam boolean"
RAW = "title string, company string, location string, job_url string, description string, job_type string, date_posted string"
SEEN = "user_id string, job_url string, evaluated_at timestamp"
HISTORY = "user_id string, job_url string, embedding array<double>, embedded_at timestamp"
USAGE = "user_id string, provider string, model string, day date, requests bigint, requests_failed bigint, tokens bigint, peak_rpm bigint"
