"""Scalar functions of the activity model as Spark columns: all of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.model import METADATA

# Words that carry no intent.
INTENT_STOPWORDS = [
    "a", "an", "the", "and", "or", "to", "of", "in", "for", "with", "on", "at", "by", "from", "is", "it",
    "this", "that", "be", "as", "are", "was", "were", "been", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "can", "has", "have", "had", "not", "no", "up", "out", "about", "into", "over", "after", "before",
]

# How much a type of action weighs in rankings.
TYPE_WEIGHTS = {"file_edit": 1.0, "command": 0.67, "session_compact": 0.5, "mcp_call": 0.33}
OTHER_TYPE_WEIGHT, OTHER_PROJECT_WEIGHT = 0.17, 0.3

# Tool names and the types they stand for.
TOOL_TYPES = {"Bash": "command", "Read": "file_read", "Write": "file_write", "Edit": "file_edit", "Grep": "search", "Glob": "search", "Task": "task_spawn", "WebFetch": "web_fetch", "WebSearch": "web_search"}

REFERENCE_SEGMENTS = ("library", "ADR", "design", "docs", ".claude", "node_modules")


def exp_decay(age: Column, half_life: float) -> Column:
    """1 at age 0, 1/2 at the half-life; 0 throughout if that isn't positive."""
    return F.exp(age * F.lit(-math.log(2) / half_life)) if half_life > 0 else F.lit(0.0)


def type_weight(obs_type: Column) -> Column:
    out = F.lit(OTHER_TYPE_WEIGHT)
    for name, weight in TYPE_WEIGHTS.items():
        out = F.when(obs_type == name, weight).otherwise(out)
    return out


def project_weight(project: Column, wanted: str) -> Column:
    """A boost, not a filter."""
    return F.when(project == wanted, 1.0).otherwise(OTHER_PROJECT_WEIGHT)


def failed(metadata: Column) -> Column:
    """Whether the metadata's flag is true; false for null or malformed metadata."""
    return F.coalesce(F.get_json_object(metadata, "$.failed") == "true", F.lit(False))


def details(metadata: Column) -> Column:
    return F.from_json(metadata, METADATA)


def word_count(text: Column) -> Column:
    """Spaces and one more: a double space counts twice."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def intent_keywords(text: Column) -> Column:
    """Words of letters, digits and underscores of more than two bytes that aren't stopwords; repeats are kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: (F.octet_length(w) > 2) & ~w.isin(INTENT_STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Of sets; 0 if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def classify_tool(name: Column) -> Column:
    out = F.when(name.contains("__"), "mcp_call").otherwise("tool_other")
    for tool, kind in reversed(TOOL_TYPES.items()):
        out = F.when(name == tool, kind).otherwise(out)
    return out


def classify_bash(command: Column) -> Column:
    """git_push over git_commit over github over command, looking at each part between ``&&`` and ``;``."""
    parts = F.transform(F.split(command, "&&|;"), lambda p: F.array_remove(F.split(p, r"\s+"), ""))

    def git(sub: str) -> Column:
        return F.exists(parts, lambda w: (F.array_position(w, "git") > 0) & F.coalesce(F.array_contains(F.slice(w, F.greatest(F.array_position(w, "git").cast("int"), F.lit(1)) + 1, F.greatest(F.size(w), F.lit(1))), sub), F.lit(False)))

    return F.when(git("push"), "git_push").when(git("commit"), "git_commit").when(F.exists(parts, lambda w: F.coalesce(F.get(w, F.lit(0)) == "gh", F.lit(False))), "github").otherwise("command")


def extract_content(tool: Column, tool_input: Column) -> Column:
    """What an invocation was about, by tool, from its JSON input."""
    field = lambda path: F.coalesce(F.get_json_object(tool_input, f"$.{path}"), F.lit(""))
    grep = F.when(field("path") == "", field("pattern")).otherwise(F.concat(field("pattern"), F.lit(" in "), field("path")))
    task = F.coalesce(F.get_json_object(tool_input, "$.description"), F.get_json_object(tool_input, "$.prompt"), F.lit(""))
    return (
        F.when(tool == "Bash", F.substring(field("command"), 1, 500))
        .when(tool.isin("Read", "Write", "Edit"), field("file_path"))
        .when(tool == "Grep", grep)
        .when(tool == "Glob", field("pattern"))
        .when(tool == "Task", F.substring(task, 1, 200))
        .when(tool == "WebFetch", field("url"))
        .when(tool == "WebSearch", field("query"))
        .when(tool == "AskUserQuestion", F.coalesce(F.get_json_object(tool_input, "$.questions[0].question"), tool))
        .otherwise(tool)
    )


def extract_file_path(tool: Column, tool_input: Column) -> Column:
    return F.when(tool.isin("Read", "Write", "Edit"), F.get_json_object(tool_input, "$.file_path")).when(tool.isin("Grep", "Glob"), F.get_json_object(tool_input, "$.path"))


def git_details(obs_type: Column, response: Column) -> Column:
    """What a commit's or push's output tells; of several lines that tell the same, the last counts."""
    lines = F.transform(F.split(response, r"\r?\n"), lambda x: F.trim(x))
    last = lambda keep: F.try_element_at(F.filter(lines, keep), F.lit(-1))
    head = last(lambda x: x.rlike(r"^\[[^\]]*\S\s+\S[^\]]*\]"))
    titled = last(lambda x: x.rlike(r"^\[[^\]]*\]\s*\S"))
    stat = last(lambda x: x.contains("changed") & (x.contains("insertion") | x.contains("deletion")))
    number = lambda word: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(stat, rf"(\d+)\s+{word}", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))
    inside = F.split(F.regexp_extract(head, r"^\[([^\]]*)\]", 1), r"\s+")
    files = F.transform(F.filter(lines, lambda x: x.rlike("^(create|delete) mode")), lambda x: F.element_at(F.split(x, " "), -1))
    moved = last(lambda x: x.contains("..") & x.contains("->"))
    commit, push = obs_type == "git_commit", obs_type == "git_push"
    return F.struct(
        F.when(commit, F.try_element_at(inside, F.lit(1))).when(push, F.nullif(F.regexp_extract(moved, r"(\S+)\s+->", 1), F.lit(""))).alias("branch"),
        F.when(commit & head.isNotNull(), F.try_element_at(inside, F.lit(-1))).alias("commit_hash"),
        F.when(commit, F.nullif(F.trim(F.regexp_replace(titled, r"^\[[^\]]*\]", "")), F.lit(""))).alias("commit_message"),
        F.when(commit & stat.isNotNull(), number("file")).alias("files_changed"),
        F.when(commit & stat.isNotNull(), number("insertion")).alias("insertions"),
        F.when(commit & stat.isNotNull(), number("deletion")).alias("deletions"),
        F.when(commit & (F.size(files) > 0), files).alias("new_files"),
        F.when(push, F.substring(last(lambda x: x.startswith("To ")), 4, 1 << 20)).alias("remote_url"),
        F.when(push, F.regexp_extract(moved, r"^(\S+)", 1)).alias("hash_range"),
    )


def normalize_command(raw: Column) -> Column:
    """A command without its user folder, bin folder, pipe to head or tail, and arguments of a subcommand."""
    s = F.regexp_replace(raw, r"^/home/[^/]*/", "")
    s = F.regexp_replace(s, r"^(?:~/\.cargo/bin/|\.cargo/bin/|/usr/local/bin/|/usr/bin/)", "")
    s = F.regexp_replace(s, r"(?s)\s*\|\s*(?:tail|head)[^|]*$", "")
    s = F.trim(F.regexp_replace(F.rtrim(s), r"\s*2>&1$", ""))
    words = F.array_remove(F.split(s, r"\s+"), "")
    return F.when((F.size(words) > 2) & F.get(words, F.lit(0)).isin("cargo", "npm", "git", "docker", "kubectl", "go"), F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))).otherwise(s)


def is_diagnostic(command: Column) -> Column:
    """Whether a failure of this command is expected: probes, clean-up, sleeping, sourcing."""
    return command.rlike(r"^\s*(which|type|command|hash)(\s|$)") | command.rlike(r"^(tmux kill-|tmux has-session|sleep |source |\. |export )")


def error_signature(response: Column) -> Column:
    """The first line that names a known class of error, else the first that isn't blank; 120 characters."""
    lines = F.filter(F.transform(F.split(response, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    known = F.filter(lines, lambda x: x.rlike(r"not found|No such file|exit code|exit status|error\[E|^error:|Permission denied|EACCES|Connection refused|ECONNREFUSED"))
    return F.substring(F.coalesce(F.get(known, F.lit(0)), F.get(lines, F.lit(0)), F.lit("")), 1, 120)


def is_reference_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, REFERENCE_SEGMENTS)))


def short_path(path: Column) -> Column:
    """The last two segments."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(path)


def short_intent(text: Column) -> Column:
    """Its first 80 characters."""
    return F.when(F.char_length(text) > 80, F.concat(F.substring(text, 1, 80), F.lit("..."))).otherwise(text)


def clipped(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def relative_time(ts: Column, as_of: int | Column) -> Column:
    """Minutes (one at least), hours or days ago; a date from a week on, with its year if another."""
    age = F.lit(as_of) - ts
    day, now = F.timestamp_seconds(ts), F.timestamp_seconds(F.lit(as_of))
    date = F.when(F.year(day) == F.year(now), F.date_format(day, "MMM d")).otherwise(F.date_format(day, "MMM d, yyyy"))
    return F.when(age < 3600, F.concat(F.greatest(F.floor(age / 60), F.lit(1)).cast("string"), F.lit("m ago"))).when(age < 86400, F.concat(F.floor(age / 3600).cast("string"), F.lit("h ago"))).when(age < 7 * 86400, F.concat(F.floor(age / 86400).cast("string"), F.lit("d ago"))).otherwise(date)


def day_start(date: Column) -> Column:
    """Seconds at midnight UTC of a strict YYYY-MM-DD; null for anything else."""
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_timestamp(F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))))


def phase_label(signature: Column) -> Column:
    """investigate, execute or mixed, the prevailing scope, and whether there were failures."""
    g = signature.getField
    base = F.when(g("investigate") > g("execute"), "investigate").when(g("execute") > g("investigate"), "execute").otherwise("mixed")
    scope = F.when(g("diverge") > g("converge"), "→diverge").when(g("converge") > g("diverge"), "→converge").otherwise("")
    return F.concat(base, scope, F.when(g("failures") > 0, "+failures").otherwise(""))


def low_quality_intent(intent: Column) -> Column:
    """Too short to say anything (under ten bytes), or an address."""
    return (F.octet_length(F.trim(intent)) < 10) | F.trim(intent).rlike("^https?://")


def is_revert(message: Column) -> Column:
    return message.rlike(r"(?i)^revert\b|(?i)\brollback\b")


def derive_project(cwd: Column, git_root: Column, home: str) -> Column:
    """The folder's name: that of the repository's root if there is one, "home" for the home folder."""
    base = F.regexp_replace(F.coalesce(git_root, cwd), "/+$", "")
    return F.when(F.coalesce(cwd, F.lit("")) == "", "unknown").when(F.regexp_replace(cwd, "/+$", "") == home.rstrip("/"), "home").when(base == "", "unknown").otherwise(F.element_at(F.split(base, "/"), -1))


def friction_label(failures: Column) -> Column:
    return F.when(F.coalesce(failures, F.lit(0)) > 0, "friction").otherwise("smooth")


def strip_fences(text: Column) -> Column:
    """A model's answer without the Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def shannon_entropy(text: Column) -> Column:
    """Bits a byte of the text's bytes."""
    code = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    n = F.size(code).cast("double")
    terms = F.transform(F.array_distinct(code), lambda b: F.size(F.filter(code, lambda x: x == b)) / n)
    return F.when(n > 0, -F.aggregate(terms, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def action_line(obs_type: Column, path: Column, content: Column, labels: list[Column], metadata: Column) -> Column:
    """An action for a summary: type and labels, file and 60 characters of it or 80 without a file, and what failed, 120 characters."""
    tag = F.concat(F.lit("["), F.concat_ws("|", obs_type, *labels), F.lit("] "))
    short = F.substring(content, 1, 60)
    base = F.concat(tag, F.when(path.isNull(), F.substring(content, 1, 80)).when(short == "", path).otherwise(F.concat(path, F.lit(" - "), short)))
    error = F.substring(F.coalesce(F.get_json_object(metadata, "$.response"), F.lit("")), 1, 120)
    return F.when(~failed(metadata), base).when(error == "", F.concat(base, F.lit(" FAILED"))).otherwise(F.concat(base, F.lit(" FAILED: "), error))


def log_message(obs_type: Column, path: Column, content: Column, metadata: Column) -> Column:
    """An action for a log: a commit by hash, message and lines, a push by range, branch and remote, else its file or 80 characters."""
    of = lambda x, other: F.coalesce(F.get_json_object(metadata, f"$.{x}"), F.lit(other))
    commit = F.concat(F.lit("git_commit: ["), of("commit_hash", "?"), F.lit("] "), of("commit_message", ""), F.lit(" ("), of("insertions", "0"), F.lit("+/"), of("deletions", "0"), F.lit("−)"))
    push = F.concat(F.lit("git_push: "), of("hash_range", "?"), F.lit(" "), of("branch", "?"), F.lit(" → "), of("remote_url", "?"))
    return F.when((obs_type == "git_commit") & metadata.isNotNull(), commit).when((obs_type == "git_push") & metadata.isNotNull(), push).otherwise(F.concat(obs_type, F.lit(": "), F.coalesce(path, F.substring(content, 1, 80))))


def row_title(path: Column, content: Column) -> Column:
    """A file, or 60 characters of what was done."""
    return F.coalesce(path, F.when(F.char_length(content) > 60, F.concat(F.substring(content, 1, 60), F.lit("..."))).otherwise(content))
