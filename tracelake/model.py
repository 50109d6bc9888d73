"""The data model: schemas of the activity stream's tables (as DDL), and the bundle of tables that operators take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

SESSIONS = "id string, project string, started_at long, ended_at long, signature array<struct<obs_type:string,n:long>>, summary string, summarization_ms long"
PROMPTS = "id long, session_id string, timestamp long, source string, content string"
OBSERVATIONS = "id long, session_id string, prompt_id long, timestamp long, obs_type string, source_event string, tool_name string, file_path string, content string, metadata string, is_pinned boolean, phase string, scope string, locus string, novelty string, friction string"
WORK_UNITS = "session_id string, episode long, started_at long, ended_at long, intent string, first_prompt_id long, last_prompt_id long, hot_files array<string>, phase_signature struct<investigate:long,execute:long,failures:long,diverge:long,converge:long,internal:long,external:long,routine:long,novel:long,smooth:long,friction:long>, obs_count long, summary string, obs_trace string"
TASKS = "id long, created_at long, status string, prompt string, project string, cwd string, tmux_target string, started_at long, completed_at long, error string, run_after long, output_path string"
COMMITS = "commit string, file string, timestamp long, author string, message string, insertions long, deletions long"
HOOKS = "session_id string, cwd string, hook_event_name string, tool_name string, tool_input string, tool_response string, transcript_path string, source string, prompt string"
#: Of ``observations.metadata``; unknown fields are ignored, and a malformed text is null.
METADATA = "redacted boolean, failed boolean, response string, branch string, commit_hash string, commit_message string, files_changed long, insertions long, deletions long, new_files array<string>, remote_url string, hash_range string"


@dataclass(frozen=True)
class Tables:
    """What queries read. Any of them may be None if a query doesn't need it."""

    sessions: DataFrame | None = None
    prompts: DataFrame | None = None
    observations: DataFrame | None = None
    work_units: DataFrame | None = None
    tasks: DataFrame | None = None
    commits: DataFrame | None = None
