"""Explicit schemas of the domain tables; nothing is inferred on read."""

from __future__ import annotations

MEMORY = (
    "id string, memory_type string, content string, context string, resolution string, tier string, hit_count long, status string, "
    "created_at timestamp_ntz, last_hit_at timestamp_ntz, embedding array<float>, tags array<string>, summary_l0 string, overview_l1 string"
)
CONTRIBUTION = "id long, memory_id string, content string, context string, resolution string, created_at timestamp_ntz"
CLUSTER = "cluster_id string, topic string, centroid array<double>, skill_slug string, superseded_slugs array<string>, created_at timestamp_ntz, updated_at timestamp_ntz"
CLUSTER_MEMBER = "cluster_id string, memory_id string, added_at timestamp_ntz"
EVOLUTION = (
    "id string, skill_slug string, cluster_id string, old_version string, new_version string, old_score double, new_score double, status string, "
    "trigger string, memory_count long, new_memory_ids array<string>, superseded_skills array<string>, mutation_summary string, timestamp timestamp_ntz"
)
SKILL = "slug string, version string, name string, description string, categories array<string>, embedding array<float>, published_at long, local_path string"
CATALOG_SKILL = (
    "full_name string, name string, display_name string, path string, description string, description_en string, owner string, category_id string, "
    "category_name string, embedding array<float>, created_at timestamp_ntz"
)
CATEGORY = "name string, description string"
SESSION = "id string, session_file string, source_agent_id string, segmented boolean, labeled boolean, memory_extracted boolean, quality_metrics string, created_at timestamp_ntz"
SEGMENT = (
    "id string, agent_id string, session_file string, segment_index long, start_line long, end_line long, fingerprint string, topic string, "
    "labeled boolean, memory_extracted boolean, quality_metrics string, created_at timestamp_ntz"
)
SFT_RUN = (
    "id string, eligible_count long, samples_exported long, base_model string, parent_checkpoint string, epochs long, status string, "
    "checkpoint_path string, error_message string, created_at timestamp_ntz, finished_at timestamp_ntz"
)
EXTRACT_PROGRESS = "agent_id string, session_file string, lines long, updated_at timestamp_ntz"
RAW_UPLOAD = "id string, source string, payload binary, size long, meta string, http_method string, http_path string, created_at timestamp_ntz"
AGENT = "user_id string, agent_id string, display_name string, created_at timestamp_ntz, last_sync_at timestamp_ntz"
PROFILE = "user_id string, agent_id string, resources map<string,string>, product string, revision long, updated_at timestamp_ntz"
SHARE = "token string, source_user_id string, source_agent_id string, visibility string, snapshot string, short_code string, created_at timestamp_ntz"
MESSAGE = (
    "role string, content string, tool_calls array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>, "
    "reasoning_content string, name string, tool_call_id string, stop_reason string"
)
