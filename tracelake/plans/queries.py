"""The library's operators as named queries over the driver's tables. Reports have an order and a limit, others none."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import kernels, scalar
from tracelake.functions.reliable import checkpoint, delete, folder
from tracelake.model import Tables
from tracelake.operators import classify, code_history, context, episodes, fleet, kept_index, lifecycle, metrics, patterns, ranking, search, stance, start_context, training
from tracelake.sources import driver_tables as src
from tracelake.sources import sinks
from tracelake.streaming import ingest

PROJECT, SESSION = "p3", "3-w1"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def text_list(column) -> DataFrame:
    return F.array_join(column, "|")


def loaded(spark: SparkSession, sf_dir: str) -> tuple[Tables, int]:
    t = src.tables(spark, sf_dir)
    return t, src.as_of(t.observations)


def with_episodes(t: Tables) -> Tables:
    """Episodes annotated; every third with a summary of its own."""
    w = episodes.annotate(t, episodes.detect(t))
    summary = F.concat(F.lit('{"intent":"episode","next_steps":["step '), (F.col("first_prompt_id") % 7).cast("string"), F.lit('"]}'))
    return replace(t, work_units=w.withColumn("summary", F.when(F.col("first_prompt_id") % 3 == 0, summary)))


# --- rankings and lookups ---


@query
def recent_context_project(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return ranking.recent_context(t, as_of=now, project=PROJECT)


@query
def recent_context_all(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return ranking.recent_context(t, as_of=now, limit=100)


@query
def get_observations(spark, sf_dir):
    return ranking.get_observations(loaded(spark, sf_dir)[0], [5, 3, 900, 1, 99_999_999]).select("id", "session_id", "timestamp", "obs_type", "file_path", "content", "is_pinned", "position")


@query
def timeline(spark, sf_dir):
    return ranking.timeline(src.tables(spark, sf_dir), 500, before=5, after=5)


@query
def session_summaries(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return ranking.session_summaries(t, project=PROJECT, before=now - 86400).select("id", "started_at", "ended_at", F.get_json_object("summary", "$.intent").alias("intent"))


@query
def session_trace(spark, sf_dir):
    r = ranking.session_trace(src.tables(spark, sf_dir), "c5")
    return r.select("prompt_id", "prompt_timestamp", "source", "prompt", text_list(F.transform("observations", lambda x: F.concat_ws(":", x["timestamp"].cast("string"), x["obs_type"]))).alias("observations"))


@query
def session_trace_loose(spark, sf_dir):
    r = ranking.session_trace(src.tables(spark, sf_dir), SESSION)
    return r.select("prompt_id", "prompt_timestamp", "source", text_list(F.transform("observations", lambda x: F.concat_ws(":", x["timestamp"].cast("string"), x["id"].cast("string"), x["obs_type"]))).alias("observations"))


@query
def file_history(spark, sf_dir):
    r = ranking.file_history(src.tables(spark, sf_dir), "/src/c3/p0.rs")
    return r.select("session_id", "project", "last_touch", "n_touches", "intent", text_list(F.transform("touches", lambda x: F.concat_ws(":", x["timestamp"].cast("string"), x["obs_type"]))).alias("touches"))


@query
def status_totals(spark, sf_dir):
    return ranking.status(src.tables(spark, sf_dir))


@query
def obs_type_top5(spark, sf_dir):
    return ranking.type_counts(src.tables(spark, sf_dir))


@query
def session_signature(spark, sf_dir):
    return ranking.signatures(src.tables(spark, sf_dir)).select("session_id", text_list(F.transform("signature", lambda x: F.concat_ws(":", x["obs_type"], x["n"].cast("string")))).alias("signature"))


@query
def latest_prompts(spark, sf_dir):
    return ranking.latest_prompts(src.tables(spark, sf_dir))


@query
def prompt_as_of(spark, sf_dir):
    t = src.tables(spark, sf_dir)
    o = t.observations.where("prompt_id IS NOT NULL").withColumn("timestamp", F.col("timestamp") + 4)
    return ranking.link_prompts(o, t.prompts).select("id", "session_id", "timestamp", "prompt_id")


# --- stance ---


@query
def stance_quadrants(spark, sf_dir):
    return stance.quadrants(src.tables(spark, sf_dir))


@query
def stance_current(spark, sf_dir):
    return stance.current(src.tables(spark, sf_dir))


@query
def stance_shifts(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return stance.shifts(t, as_of=now)


@query
def stance_dimensions(spark, sf_dir):
    return stance.dimensions(src.tables(spark, sf_dir))


# --- patterns ---


def _patterns(df: DataFrame) -> DataFrame:
    return df.select("kind", "pattern", "session_count", "heat", F.size("sessions").cast("long").alias("n_sessions"), F.element_at("sessions", 1).alias("first_session"), "example")


@query
def failed_commands(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return _patterns(patterns.failed_commands(t, as_of=now))


@query
def unresolved_reads(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return _patterns(patterns.unresolved_reads(t, as_of=now))


@query
def recurring_errors(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return _patterns(patterns.recurring_errors(t, as_of=now))


@query
def repeated_intents(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return _patterns(patterns.repeated_intents(t, as_of=now))


@query
def repeated_intents_parts(spark, sf_dir):
    """Parts as sessions, ten minutes apart, whose intents are names and brands: many sets of words that are alike by degrees."""
    d = src.read(spark, sf_dir, "part")
    intent = F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit("")))
    sessions = d.select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_partkey") * 600).alias("started_at"), F.to_json(F.struct(intent.alias("intent"))).alias("summary"))
    now = sessions.agg(F.coalesce(F.max("started_at"), F.lit(0))).first()[0]
    return _patterns(patterns.repeated_intents(Tables(sessions=sessions), as_of=now))


@query
def pattern_heat_normalized(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return patterns.all_patterns(t, as_of=now).select("kind", "pattern", "session_count", "heat")


@query
def stuck_loops(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    evidence = patterns.failed_commands(t, as_of=now).unionByName(patterns.recurring_errors(t, as_of=now))
    return patterns.stuck_loops(patterns.repeated_intents(t, as_of=now), evidence)


# --- search ---


def _corpus(spark, sf_dir, stemmed: bool = False) -> tuple[search.Index, DataFrame]:
    docs = src.read(spark, sf_dir, "documents")
    return search.build(docs, "doc_id", "text", stemmed), docs.select("doc_id", "lang", "source", F.substring("text", 1, 120).alias("preview"))


def _search(name: str, text: str, limit: int = 20) -> None:
    def run(spark, sf_dir):
        index, docs = _corpus(spark, sf_dir)
        return search.relevance(index, docs, "doc_id", text, limit).select("doc_id", "lang", "source", "preview", "rank")

    QUERIES[name] = run


SEARCHES = {"search_and": "the hand", "search_or": "hand OR elle", "search_not": "the NOT hand", "search_not_neighbours": "the NOT hand elle OR shthe", "search_phrase": '"in the"', "search_prefix": "hand*"}
for _name, _text in SEARCHES.items():
    _search(_name, _text)


@query
def search_bm25(spark, sf_dir):
    return search.matches(_corpus(spark, sf_dir)[0], "hand OR shthe OR elle").select(F.col("doc").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query
def search_filtered(spark, sf_dir):
    index, docs = _corpus(spark, sf_dir)
    return search.relevance(index, docs.where("source = 'src1'"), "doc_id", "the OR la", 10, offset=2).select("doc_id", "rank")


@query
def fts_search(spark, sf_dir):
    """The flagship: observations by text, recency and type."""
    t, now = loaded(spark, sf_dir)
    index = search.build(t.observations, "id", "content")
    return search.observations(index, t, "cargo OR building", as_of=now, order_by="blended").select("id", "session_id", "obs_type", "content", "score")


@query
def fts_search_filtered(spark, sf_dir):
    """Of a project, a type and an open range of times, by relevance."""
    t, now = loaded(spark, sf_dir)
    index = search.build(t.observations, "id", "content")
    return search.observations(index, t, "test OR run", as_of=now, project=PROJECT, obs_type="command", before=now - 86400, after=now - 20 * 86400, limit=50).select("id", "timestamp", "rank")


@query
def search_kept(spark, sf_dir):
    """All documents in an index that is kept: English ones first, then the others; one source is removed and comes back."""
    docs = src.read(spark, sf_dir, "documents")
    path = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    kept_index.create(spark, path, stemmed=False, buckets=16)
    kept_index.add(spark, path, docs.where("lang = 'en'"), "doc_id", "text")
    kept_index.add(spark, path, docs, "doc_id", "text")
    kept_index.remove(spark, path, docs.where("source = 'src1'"), "doc_id")
    kept_index.merge(spark, path)
    kept_index.add(spark, path, docs.where("source = 'src1'"), "doc_id", "text")
    found = search.matches(kept_index.load(spark, path), '"in the" OR hand*').select(F.col("doc").alias("doc_id"), F.round("rank", 6).alias("rank"))
    found = checkpoint(found)
    delete(spark, path)
    return found


@query
def search_tiered(spark, sf_dir):
    return search.tiered(_corpus(spark, sf_dir)[0], "hand and erthe").withColumnRenamed("doc", "doc_id")


@query
def search_porter(spark, sf_dir):
    docs = src.read(spark, sf_dir, "documents")
    return search.relevance(search.build(docs, "doc_id", "text", stemmed=True), docs.select("doc_id", "lang"), "doc_id", "handing OR elles", 20).select("doc_id", "lang", "rank")


@query
def fts_integrity(spark, sf_dir):
    """What an index of documents lacks when every ninth one is missing from it."""
    docs = src.read(spark, sf_dir, "documents").select("doc_id", "text")
    index = search.build(docs.where("doc_id % 9 <> 0"), "doc_id", "text", stemmed=False)
    return search.missing_postings(index, docs, "doc_id", "text").groupBy("side", "doc").agg(F.count("*").alias("n")).withColumnRenamed("doc", "doc_id")


@query
def episode_search_fts(spark, sf_dir):
    t = with_episodes(src.tables(spark, sf_dir))
    own = t.observations.where("prompt_id IS NOT NULL")
    return search.episodes_matching(search.build(own, "id", "content"), own, t.work_units, "p0 OR cargo").select("session_id", "episode", "rank")


@query
def episode_search_tiered(spark, sf_dir):
    """No observation has the word, so the episodes' own texts are looked at."""
    t = with_episodes(src.tables(spark, sf_dir))
    own = t.observations.where("prompt_id IS NOT NULL")
    return search.episodes_tiered(search.build(own, "id", "content"), own, t.work_units, "episode").select("tier", "session_id", "episode", "rank")


@query
def episode_search_like(spark, sf_dir):
    t = with_episodes(src.tables(spark, sf_dir))
    return search.episodes_like(t.work_units, "THE", 20).select("session_id", "episode", "started_at")


# --- episodes ---


@query
def episodes_detect(spark, sf_dir):
    return episodes.detect(src.tables(spark, sf_dir))


@query
def episodes_annotate(spark, sf_dir):
    t = src.tables(spark, sf_dir)
    w = episodes.annotate(t, episodes.detect(t))
    return w.select("session_id", "episode", "first_prompt_id", "last_prompt_id", "obs_count", text_list("hot_files").alias("hot_files"), *[F.col(f"phase_signature.{c}").alias(c) for c in episodes.COUNTERS], scalar.phase_label(F.col("phase_signature")).alias("label"))


@query
def episodes_friction(spark, sf_dir):
    t = src.tables(spark, sf_dir)
    return episodes.label_friction(t, episodes.annotate(t, episodes.detect(t))).select("id", "friction")


@query
def episodes_obs_trace(spark, sf_dir):
    t = src.tables(spark, sf_dir)
    w = episodes.detect(t).withColumn("obs_trace", F.lit(None).cast("string"))
    return episodes.backfill_traces(t, w).select("session_id", "episode", "obs_trace")


@query
def episodes_store(spark, sf_dir):
    t = src.tables(spark, sf_dir)
    w = episodes.detect(t)
    return episodes.store(w.where(F.col("first_prompt_id") % 2 == 0).withColumn("intent", F.lit("old")), w).select("session_id", "episode", F.when(F.col("intent") == "old", "old").otherwise("new").alias("kind"))


@query
def summary_payload(spark, sf_dir):
    p = episodes.payload(src.tables(spark, sf_dir))
    return p.select("session_id", "obs_count", F.md5("payload").alias("payload_md5"))


@query
def episode_payload(spark, sf_dir):
    t = src.tables(spark, sf_dir)
    p = episodes.episode_payload(t, episodes.annotate(t, episodes.detect(t)), least=1)
    return p.select("session_id", "episode", F.md5("payload").alias("payload_md5"))


@query
def variant_averages(spark, sf_dir):
    """Projects as variants."""
    s = src.tables(spark, sf_dir).sessions.where(F.col("summary").isNotNull())
    return classify.variant_averages(classify.summary_quality(s), "project")


@query
def maintenance(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    out = lifecycle.maintain(t, as_of=now + 75 * 86400)
    s = out.sessions.join(out.observations.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    return s.select("id", F.coalesce("n", F.lit(0)).alias("n"), (F.col("summary") == episodes.SENTINEL).alias("sentinel"))


@query
def template_summaries(spark, sf_dir):
    s = episodes.template_summary(episodes.payload(src.tables(spark, sf_dir)))
    return classify.summary_quality(s).select("session_id", "json_valid", "fields_present", "array_compliance", "intent_words", "files_read_count", "files_edited_count")


@query
def catch_up_candidates(spark, sf_dir):
    return episodes.catch_up(src.tables(spark, sf_dir))


# --- context ---


@query
def context_episodes(spark, sf_dir):
    t, _ = loaded(spark, sf_dir)
    t = with_episodes(t)
    now = (t.prompts.agg(F.max("timestamp")).first()[0] or 0) + 1
    r = context.recent_episodes(t, "p2", as_of=now)
    return r.select("session_id", "episode", "started_at", "title", "obs_count", "label", text_list("hot_files").alias("hot_files"))


@query
def context_fallback_summaries(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return context.fallback_summaries(with_episodes(t), PROJECT, as_of=now).select("id", "started_at")


@query
def context_suggested_tasks(spark, sf_dir):
    return context.suggested_tasks(with_episodes(src.tables(spark, sf_dir)), "p2")


@query
def context_local_activity(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return context.local_activity(t, PROJECT, as_of=now)


@query
def context_cross_pins(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return context.cross_project_pins(t, PROJECT, as_of=now)


@query
def context_activity_lines(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return context.activity_lines(context.local_activity(t, PROJECT, as_of=now), as_of=now).select("part", "timestamp", "title")


@query
def start_contexts(spark, sf_dir):
    """Each session begins, and is compacted when its last action is over: what either start is told."""
    t = with_episodes(src.tables(spark, sf_dir))
    s = t.sessions.select(F.col("id").alias("session_id"), "project", F.explode(F.array(F.struct(F.col("started_at").alias("t"), F.lit(False).alias("recovery")), F.struct((F.col("ended_at") + 1).alias("t"), F.lit(True).alias("recovery")))).alias("x"))
    return start_context.at_starts(t, s.select("session_id", "project", "x.*"))


@query
def start_pins(spark, sf_dir):
    """For each session the ten newest pins, of its project and of the others, of before its end."""
    t = src.tables(spark, sf_dir)
    o = ranking.with_project(t.observations, t.sessions).where("is_pinned")
    marks = o.select("project", F.col("timestamp").alias("at"), "id", F.struct("id").alias("m"))
    s = t.sessions.select("project", F.col("ended_at").alias("at"), F.struct("id").alias("s"))
    both = start_context.latest(marks, s, ["id"], 10).withColumn("own", F.lit(True)).drop("i").unionByName(start_context.latest_of_others(marks, s, ["id"], 10).withColumn("own", F.lit(False)))
    return both.select(F.col("s.id").alias("session_id"), "own", F.col("m.id").alias("id"))


# --- functions ---


@query
def redact_regex(spark, sf_dir):
    d = src.read(spark, sf_dir, "documents")
    out = kernels.redact_patterns(F.col("text"))
    return d.select("doc_id", F.md5(out).alias("redacted_md5"), (out != F.col("text")).alias("redacted"))


@query
def redact_entropy(spark, sf_dir):
    d = src.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(kernels.redact(F.col("text"), "strict")).alias("redacted_md5"))


@query
def shannon_entropy(spark, sf_dir):
    d = src.read(spark, sf_dir, "orders")
    return d.select("o_orderkey", F.round(scalar.shannon_entropy(F.concat_ws("-", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus")), 6).alias("entropy"))


@query
def intent_keywords(spark, sf_dir):
    p = src.prompts(spark, sf_dir)
    return p.select("id", scalar.word_count(F.col("content")).cast("long").alias("word_count"), text_list(scalar.intent_keywords(F.col("content"))).alias("keywords"))


@query
def jaccard_pairs(spark, sf_dir):
    """Each prompt with the next of its session."""
    p = src.prompts(spark, sf_dir).withColumn("words", scalar.intent_keywords(F.col("content")))
    p = p.withColumn("after", F.lead("words").over(Window.partitionBy("session_id").orderBy("id"))).where(F.col("after").isNotNull())
    return p.select("id", F.round(scalar.jaccard(F.col("words"), F.col("after")), 6).alias("jaccard"))


@query
def classify_tool_bash(spark, sf_dir):
    t = src.tables(spark, sf_dir)
    o = t.observations.select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("cd x && git -C /y push; "), "content")).when(F.col("id") % 4 == 1, F.concat(F.lit("git add . ; git commit -m '"), "content", F.lit("'"))).when(F.col("id") % 4 == 2, F.lit("gh pr list")).otherwise(F.concat(F.lit("echo git; echo push "), "content")).alias("command"), F.element_at(F.array(*map(F.lit, ("Bash", "Glob", "mcp__x", "Other", "Edit"))), (F.col("id") % 5 + 1).cast("int")).alias("tool"))
    return o.select("id", scalar.classify_bash(F.col("command")).alias("bash_type"), scalar.classify_tool(F.col("tool")).alias("tool_type"))


@query
def normalize_commands(spark, sf_dir):
    o = src.tables(spark, sf_dir).observations.where("obs_type = 'command'")
    c = F.concat(F.when(F.col("id") % 3 == 0, "/home/u/").otherwise(""), F.col("content"), F.when(F.col("id") % 2 == 0, " 2>&1 | tail -5").otherwise(""))
    return o.select("id", scalar.normalize_command(c).alias("normalized"), scalar.is_diagnostic(F.col("content")).alias("diagnostic"))


#: Commands and words that reach each rule of the labels.
LABELLED = (
    "npm install lodash", "pip install x", "git clone ../x", "cargo install ripgrep", "grep -rn foo .", "ssh host", "docker ps", "run tests/ now", "docker pull y", "gh pr list", "curl localhost", "git diff src/a.rs",
    "cargo build", "CARGO TEST", "git log", "echo traceback", "python -m pytest", "python3 x.py", "why does it fail", "search all for it", "Timed out", "ERROR: exit code 3", "permission DENIED", "plain words",
)


@query
def heuristic_labels(spark, sf_dir):
    o = src.tables(spark, sf_dir).observations
    words = F.element_at(F.array(*map(F.lit, LABELLED)), (F.col("id") % len(LABELLED) + 1).cast("int"))
    o = o.withColumn("content", F.when(F.col("id") % 2 == 0, F.concat(words, F.lit(" "), F.repeat(F.lit("x"), (F.col("id") % 3 * 200).cast("int")), F.lit(" "), words)).otherwise(F.col("content")))
    return o.select("id", classify.locus(F.col("obs_type"), F.col("content"), F.col("file_path")).alias("locus"), classify.novelty(F.col("obs_type"), F.col("content"), F.col("file_path")).alias("novelty"), classify.friction(F.col("obs_type"), F.col("content"), scalar.failed(F.col("metadata"))).alias("friction"))


@query
def event_decay(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    d = scalar.exp_decay((F.lit(now) - F.col("timestamp")) / 86400.0, 7.0)
    return t.observations.groupBy("obs_type").agg(F.round(F.sum(d), 3).alias("heat"), F.round(F.sum(scalar.type_weight(F.col("obs_type"))), 3).alias("weight"))


# --- classification ---

#: A model of two words and two classes, for scoring that SQL can follow.
TINY = {
    "classes": ["think", "act"],
    "word": {"vocabulary": {"the": 0, "and": 1, "of": 2}, "idf": [1.5, 2.0, 1.0], "weights": [-0.5, 0.75, 0.25], "ngram_range": [1, 1], "binary": False, "sublinear_tf": True},
    "char": {"vocabulary": {}, "idf": [], "weights": [], "ngram_range": [3, 5], "binary": False, "sublinear_tf": True},
    "bias": 0.05,
}


@query
def tfidf_score(spark, sf_dir):
    d = src.read(spark, sf_dir, "documents")
    run = classify.classifier(spark, {"phase": TINY})
    return d.select("doc_id", run(F.col("text")).alias("m")).select("doc_id", F.col("m.phase").alias("phase"), F.round("m.phase_confidence", 6).alias("confidence"))


@query
def classifier_backfill(spark, sf_dir):
    o = src.tables(spark, sf_dir).observations
    return classify.label_counts(classify.backfill(o, {"phase": TINY}), "phase")


@query
def classifier_confusion(spark, sf_dir):
    o = src.tables(spark, sf_dir).observations
    return classify.measures(o.select(F.col("novelty").alias("predicted"), F.when(F.col("friction") == "smooth", "routine").otherwise("novel").alias("expected")))


@query
def classifier_trained(spark, sf_dir):
    """A model of document quality, trained on all labelled rows but a fourth, and measured on that."""
    d = src.read(spark, sf_dir, "documents").join(src.read(spark, sf_dir, "labels"), "doc_id").withColumn("label", F.when(F.col("quality") == 1, "good").otherwise("poor"))
    model = training.train_all(d.where("doc_id % 4 <> 0"), "text", "label", ("poor", "good"))
    run = classify.classifier(spark, {"quality": model})
    return classify.measures(d.where("doc_id % 4 = 0").select(F.col("label").alias("expected"), run(F.col("text"))["quality"].alias("predicted")))


@query
def classifier_all_rows(spark, sf_dir):
    """Models of quality and of toxicity, trained on all labelled rows and measured on folds; equal texts share a fold."""
    d = src.read(spark, sf_dir, "documents").join(src.read(spark, sf_dir, "labels"), "doc_id")
    named = ("quality", "toxic")
    rows = d.select("text", *[F.when(F.col(of) == 1, "yes").otherwise("no").alias(of) for of in named])
    models = training.train_each(rows, "text", list(named), ("no", "yes"), folds=5)
    out = [(of, len(model["word"]["vocabulary"]), len(model["char"]["vocabulary"]), round(model["accuracy"], 3)) for of, model in zip(named, models)]
    return spark.createDataFrame(out, "dimension string, word_grams long, char_grams long, accuracy double")


@query
def balanced_labels(spark, sf_dir):
    l = src.read(spark, sf_dir, "labels")  # noqa: E741
    return classify.balanced(l, "toxic").groupBy("toxic").agg(F.count("*").alias("n"))


# --- lifecycle ---


@query
def sweep_survivors(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return lifecycle.sweep(t, as_of=now + 75 * 86400).observations.groupBy("session_id").agg(F.count("*").alias("n"))


@query
def sweep_deleted_by_type(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return lifecycle.swept_by_type(t, as_of=now + 75 * 86400)


@query
def purge_preview(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return lifecycle.purge_matches(t, as_of=now, project=PROJECT, before="2024-01-15", obs_type="command").select("id", "session_id")


@query
def purge_survivors(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    out = lifecycle.purge(t, lifecycle.purge_matches(t, as_of=now, older_than_days=20))
    return out.observations.groupBy("session_id").agg(F.count("*").alias("n"), F.count("prompt_id").alias("linked"))


@query
def orphan_cleanup(spark, sf_dir):
    """Each customer as a session besides; those who never did anything are left alone."""
    t = src.tables(spark, sf_dir)
    more = src.read(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("-w1")).alias("id")).join(t.sessions.select("id"), "id", "left_anti")
    return lifecycle.orphans(replace(t, sessions=t.sessions.select("id").unionByName(more))).select("id")


@query
def delete_project(spark, sf_dir):
    t = src.tables(spark, sf_dir)
    out = lifecycle.delete_sessions(t, t.sessions.where(F.col("project") == PROJECT).select("id"))
    return out.sessions.join(out.observations.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n")), "id").select("id", "n")


def _tasks(spark, sf_dir) -> DataFrame:
    o = src.read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderkey") % 501 == 0, "running").otherwise("pending").alias("status"), F.when(F.col("o_custkey") % 2 == 0, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 86400 * 1000).alias("run_after"), F.lit(None).cast("string").alias("tmux_target"))


@query
def task_eligible(spark, sf_dir):
    return lifecycle.eligible_tasks(_tasks(spark, sf_dir), as_of=900_000_000, most=200).select("id", "created_at")


# --- code history ---


@query
def git_churn(spark, sf_dir):
    return code_history.churn(src.commits(spark, sf_dir))


@query
def commit_order(spark, sf_dir):
    commits, parents, _ = src.repositories(spark, sf_dir)
    return code_history.commit_order(commits, parents)


@query
def first_parent_changes(spark, sf_dir):
    _, parents, trees = src.repositories(spark, sf_dir)
    return code_history.first_parent_changes(trees, parents)


@query
def git_co_change(spark, sf_dir):
    return code_history.co_changes(src.commits(spark, sf_dir), "part7", 20)


@query
def git_summary(spark, sf_dir):
    return code_history.dense_summary(code_history.churn(src.commits(spark, sf_dir)))


@query
def git_file_commits(spark, sf_dir):
    return code_history.file_commits(src.commits(spark, sf_dir), "part7", 20).select("commit", "timestamp", "message")


@query
def blame_lookup(spark, sf_dir):
    """All lines that any hunk of a file has, and the one after each."""
    li = src.read(spark, sf_dir, "lineitem")
    hunks = li.select(F.concat(F.lit("f"), (F.col("l_partkey") % 1000).cast("string")).alias("file"), (F.col("l_orderkey") % 5000).alias("start"), (F.col("l_quantity").cast("long") % 7 + 1).alias("count"), F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("commit"))
    return code_history.blame(hunks, code_history.lines_of(hunks, after=1))


@query
def module_degrees(spark, sf_dir):
    m, u = src.module_edges(spark, sf_dir)
    return code_history.module_roles(m, u).select("module", "in_degree", "out_degree")


@query
def module_roles(spark, sf_dir):
    m, u = src.module_edges(spark, sf_dir)
    return code_history.module_roles(m, u).select("module", "role", "lines_per_item")


@query
def module_rankings(spark, sf_dir):
    m, u = src.module_edges(spark, sf_dir)
    return code_history.rankings(code_history.module_roles(m, u))


@query
def module_files(spark, sf_dir):
    """A TOML file for each module."""
    m, u = src.module_edges(spark, sf_dir)
    m = m.select("module", F.concat(F.lit("src/"), "module", F.lit(".rs")).alias("path"), "lines", F.array(F.concat(F.lit("f"), F.col("items").cast("string"))).alias("functions"), F.when(F.col("items") % 2 == 0, F.array(F.lit("T"), F.lit('U"'))).otherwise(F.array().cast("array<string>")).alias("types"))
    return sinks.module_files(m, u)


@query
def refined_file_history(spark, sf_dir):
    return code_history.refined_file_history(src.tables(spark, sf_dir))


# --- fleet ---


def _pongs(spark, sf_dir) -> DataFrame:
    o = src.read(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("fleet"), (F.col("o_custkey") % 5).cast("string")).alias("fleet"), F.floor(F.col("o_orderkey") / 20).alias("round"), F.concat(F.lit("i"), (F.col("o_orderkey") % 4).cast("string")).alias("instance"), (F.round(F.col("o_totalprice")) / 1e6).alias("rtt"))


@query
def heartbeat_rounds(spark, sf_dir):
    return fleet.heartbeat_rounds(_pongs(spark, sf_dir), "i0")


@query
def rto_fold(spark, sf_dir):
    p = _pongs(spark, sf_dir).where("instance <> 'i0'").groupBy("fleet", "round").agg(F.max("rtt").alias("rtt"))
    return fleet.timeouts(p, "fleet")


@query
def fleet_topk_per_instance(spark, sf_dir):
    o = src.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("i"), (F.col("o_custkey") % 50).cast("string")).alias("instance"), F.round("o_totalprice", 2).alias("rank"))
    return fleet.gather(o, "i0", 3).select("instance", "id", "position")


@query
def ensemble_quality(spark, sf_dir):
    li = src.read(spark, sf_dir, "lineitem")
    v = li.select(F.col("l_orderkey").alias("claim"), (F.col("l_linenumber") + 2).cast("long").alias("n"), F.least(F.col("l_quantity").cast("long") % 9, F.col("l_linenumber") + 2).alias("k"))
    return fleet.ensemble_quality(v)


def _claims(spark, sf_dir) -> DataFrame:
    """Orders as documents, their lines as claims."""
    li = src.read(spark, sf_dir, "lineitem")
    n = F.col("l_orderkey") % 4 + 3
    return li.select(F.col("l_orderkey").alias("document"), n.alias("n"), (F.col("l_partkey") % (n + 1)).alias("k"), (F.col("l_linenumber") % 3 > 0).alias("tagged"), (F.col("l_returnflag") == "R").alias("wrong"))


@query
def document_quality(spark, sf_dir):
    return fleet.document_quality(_claims(spark, sf_dir))


@query
def agreement_tiers(spark, sf_dir):
    """All orders of a day's remainder as one document."""
    return fleet.agreement_tiers(_claims(spark, sf_dir).withColumn("document", F.col("document") % 10))


# --- sinks, streams, dashboards ---


@query
def write_dedup_5min(spark, sf_dir):
    return ranking.deduplicated(src.tables(spark, sf_dir).observations).groupBy("obs_type").agg(F.count("*").alias("kept"))


@query
def session_gaps(spark, sf_dir):
    return ranking.gaps(src.tables(spark, sf_dir).observations)


@query
def event_rate_5min(spark, sf_dir):
    e = src.read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return ingest.rate(e, "ts", "event_type").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query
def value_quantiles(spark, sf_dir):
    return metrics.quantiles(src.read(spark, sf_dir, "events"), "event_type", "value")


@query
def bucket_quantiles(spark, sf_dir):
    """Histograms of each user's durations, merged by kind of event."""
    e = src.read(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 100)
    h = e.groupBy("event_type", "user_id").agg(sinks.buckets_of(F.col("seconds")).alias("buckets"))
    return metrics.merged_quantiles(h, "event_type", "buckets", sinks.BOUNDS)


@query
def counter_rates(spark, sf_dir):
    """Numbers of events as counters that start anew after 997, by kind and hour."""
    e = src.read(spark, sf_dir, "events").select("event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_id") % 997).alias("v"))
    return metrics.increases(e, "event_type", "t", "v", 3600)


@query
def duration_histogram(spark, sf_dir):
    e = src.read(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 100)
    h = sinks.histogram(e, "event_type", "seconds")
    return h.select("event_type", "count", F.round("sum", 2).alias("sum"), F.array_join("buckets", ",").alias("buckets"))


@query
def metric_counters(spark, sf_dir):
    return sinks.counters(src.tables(spark, sf_dir).observations)


@query
def log_records(spark, sf_dir):
    o = src.tables(spark, sf_dir).observations
    return sinks.log_records(o).groupBy("message").agg(F.count("*").alias("n"))


@query
def result_json(spark, sf_dir):
    t, now = loaded(spark, sf_dir)
    return sinks.as_json(ranking.recent_context(t, as_of=now, project=PROJECT, limit=5).select("id", "obs_type", "file_path"))
