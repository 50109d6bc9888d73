"""The named queries in DuckDB's SQL, written from the definitions of the operators, over the same parquet tables."""

from __future__ import annotations

import math

from tracelake.sources.driver_tables import SQL as MODEL

SQL: dict[str, str] = {}


def model(name: str, ctes: str, select: str) -> None:
    """A query over the activity model: more WITH parts, then the rest."""
    SQL[name] = MODEL + (", " + ctes if ctes else "") + "\n" + select


TYPE_WEIGHT = "CASE obs_type WHEN 'file_edit' THEN 1.0::DOUBLE WHEN 'command' THEN 0.67::DOUBLE WHEN 'session_compact' THEN 0.5::DOUBLE WHEN 'mcp_call' THEN 0.33::DOUBLE ELSE 0.17::DOUBLE END"
LN2 = repr(math.log(2))


def decay(age: str, half: str) -> str:
    return f"exp(-{LN2} * ({age}) / {half}::DOUBLE)"


def recent(score: str, limit: int) -> tuple[str, str]:
    return (
        f"o AS (SELECT obs.*, ses.project, round({score}, 6) AS score FROM obs JOIN ses ON ses.id = obs.session_id, now), "
        "k AS (SELECT * FROM o WHERE file_path IS NULL UNION ALL SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id DESC) AS rn FROM o WHERE file_path IS NOT NULL) WHERE rn = 1)",
        f"SELECT id, timestamp, project, obs_type, file_path, substr(content, 1, 120) AS preview, score FROM k ORDER BY score DESC, id DESC LIMIT {limit}",
    )


AGE_DAYS = "(now.t - timestamp)::DOUBLE / 86400"
model("recent_context_project", *recent(f"{decay(AGE_DAYS, '7')} * 0.5::DOUBLE + {TYPE_WEIGHT} * 0.3::DOUBLE + CASE WHEN project = 'p3' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * 0.2::DOUBLE", 30))
model("recent_context_all", *recent(f"{decay(AGE_DAYS, '7')} * 0.6::DOUBLE + {TYPE_WEIGHT} * 0.4::DOUBLE", 100))
model("get_observations", "w AS (SELECT unnest([5, 3, 900, 1, 99999999]) AS id, unnest([0, 1, 2, 3, 4]) AS position)", "SELECT id, session_id, timestamp, obs_type, file_path, content, is_pinned, position::INT AS position FROM obs JOIN w USING (id)")
model(
    "timeline",
    "own AS (SELECT o.id, o.timestamp, o.obs_type, o.file_path, substr(o.content, 1, 120) AS preview FROM obs o WHERE o.session_id = (SELECT session_id FROM obs WHERE id = 500))",
    "SELECT *, -1 AS side FROM (SELECT * FROM own WHERE id < 500 ORDER BY id DESC LIMIT 5) UNION ALL SELECT *, 0 FROM own WHERE id = 500 UNION ALL SELECT *, 1 FROM (SELECT * FROM own WHERE id > 500 ORDER BY id LIMIT 5)",
)
model("session_summaries", "", "SELECT id, started_at, ended_at, intent FROM ses, now WHERE intent IS NOT NULL AND project = 'p3' AND started_at < now.t - 86400 ORDER BY started_at DESC, id DESC LIMIT 10")
model(
    "session_trace",
    "g AS (SELECT prompt_id, string_agg(timestamp || ':' || obs_type, '|' ORDER BY timestamp, id) AS observations FROM obs WHERE session_id = 'c5' GROUP BY prompt_id)",
    "SELECT p.id AS prompt_id, p.timestamp AS prompt_timestamp, p.source, substr(p.content, 1, 120) AS prompt, g.observations FROM prompts p LEFT JOIN g ON g.prompt_id = p.id WHERE p.session_id = 'c5'",
)
model("session_trace_loose", "", "SELECT CAST(NULL AS BIGINT) AS prompt_id, min(timestamp) AS prompt_timestamp, 'system' AS source, string_agg(timestamp || ':' || id || ':' || obs_type, '|' ORDER BY timestamp, id) AS observations FROM obs WHERE session_id = '3-w1' AND prompt_id IS NULL HAVING count(*) > 0")
model(
    "file_history",
    "o AS (SELECT * FROM obs WHERE file_path = '/src/c3/p0.rs' ORDER BY timestamp DESC, id DESC LIMIT 50), g AS (SELECT session_id, max(timestamp) AS last_touch, count(*) AS n_touches, string_agg(timestamp || ':' || obs_type, '|' ORDER BY timestamp DESC, id DESC) AS touches FROM o GROUP BY session_id)",
    "SELECT g.session_id, project, last_touch, n_touches, intent, touches FROM g JOIN ses ON ses.id = g.session_id",
)
model("status_totals", "", "SELECT count(*) AS observations, count_if(is_pinned)::BIGINT AS pinned, count_if(failed)::BIGINT AS failures, (SELECT count(*) FROM ses) AS sessions, (SELECT count(intent) FROM ses) AS summarised, (SELECT id FROM ses ORDER BY started_at DESC, id DESC LIMIT 1) AS last_session, (SELECT count(*) FROM prompts) AS prompts FROM obs")
model("obs_type_top5", "", "SELECT obs_type, count(*) AS n FROM obs GROUP BY obs_type ORDER BY n DESC, obs_type LIMIT 5")
model("session_signature", "n AS (SELECT session_id, obs_type, count(*) AS n FROM obs GROUP BY ALL)", "SELECT session_id, string_agg(obs_type || ':' || n, '|' ORDER BY n DESC, obs_type) AS signature FROM n GROUP BY session_id")
model("latest_prompts", "", "SELECT session_id, max(id) AS prompt_id FROM prompts GROUP BY session_id")
model("prompt_as_of", "", "SELECT o.id, o.session_id, o.timestamp + 4 AS timestamp, (SELECT max(p.id) FROM prompts p WHERE p.session_id = o.session_id AND p.timestamp <= o.timestamp + 4) AS prompt_id FROM obs o WHERE o.prompt_id IS NOT NULL")

POINTS = "pts AS (SELECT session_id, timestamp, id, CASE phase WHEN 'act' THEN 1 ELSE -1 END AS p, CASE scope WHEN 'converge' THEN 1 ELSE -1 END AS s FROM obs WHERE phase IS NOT NULL AND scope IS NOT NULL)"
_Q = {"think_diverge": (-1, -1), "think_converge": (-1, 1), "act_diverge": (1, -1), "act_converge": (1, 1)}
model(
    "stance_quadrants",
    POINTS + ", g AS (SELECT session_id, count(*) AS total, " + ", ".join(f"count_if(p = {p} AND s = {s})::BIGINT AS n_{q}" for q, (p, s) in _Q.items()) + " FROM pts GROUP BY session_id)",
    "SELECT *, " + ", ".join(f"round(n_{q}::DOUBLE / total * 1000) / 10 AS pct_{q}" for q in _Q) + " FROM g",
)
EMA = POINTS + """, num AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM pts),
ema AS (SELECT session_id, rn, n, timestamp, p::DOUBLE AS ep, s::DOUBLE AS es FROM num WHERE rn = 1
  UNION ALL SELECT num.session_id, num.rn, num.n, num.timestamp, num.p * 0.08::DOUBLE + ema.ep * (1 - 0.08::DOUBLE), num.s * 0.08::DOUBLE + ema.es * (1 - 0.08::DOUBLE) FROM ema JOIN num ON num.session_id = ema.session_id AND num.rn = ema.rn + 1)"""
_NAME = lambda p, s: f"(CASE WHEN {p} >= 0 THEN 'act' ELSE 'think' END || '+' || CASE WHEN {s} >= 0 THEN 'converge' ELSE 'diverge' END)"
_DIR = lambda a, b, up, down: f"CASE WHEN abs({a} - {b}) < 0.2::DOUBLE THEN 'stable' WHEN {a} > {b} THEN 'shifting_{up}' ELSE 'shifting_{down}' END"
model(
    "stance_current",
    EMA + ", m AS (SELECT session_id, avg(p) FILTER (rn > n - 5) AS p5, avg(p) FILTER (rn > n - 20) AS p20, avg(s) FILTER (rn > n - 5) AS s5, avg(s) FILTER (rn > n - 20) AS s20 FROM num GROUP BY session_id), "
    f"x AS (SELECT e.session_id, e.n, ep, es, p5, p20, s5, s20, {_DIR('p5', 'p20', 'act', 'think')} AS phase_direction, {_DIR('s5', 's20', 'converge', 'diverge')} AS scope_direction FROM ema e JOIN m USING (session_id) WHERE e.rn = e.n)",
    f"""SELECT session_id, n, round(ep, 6) AS ema_phase, round(es, 6) AS ema_scope, {_NAME('ep', 'es')} AS stance, round(p5, 6) AS phase_5, round(p20, 6) AS phase_20, round(s5, 6) AS scope_5, round(s20, 6) AS scope_20, phase_direction, scope_direction,
    CASE WHEN s5 < 0 AND s20 > 0 THEN 'diverging' WHEN ep < -0.5 THEN 'investigating' WHEN ep > 0.5 AND es > 0.5 AND phase_direction = 'stable' AND scope_direction = 'stable' THEN 'focused'
         WHEN (s5 > 0) <> (s20 > 0) THEN CASE WHEN s5 < 0 THEN 'entering_diverge' ELSE 'entering_converge' END ELSE 'mixed' END AS guidance FROM x""",
)
model(
    "stance_shifts",
    EMA + ", l AS (SELECT *, lag(ep) OVER w AS bp, lag(es) OVER w AS bs FROM ema WINDOW w AS (PARTITION BY session_id ORDER BY rn)), c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rn DESC) AS k FROM l WHERE rn - 1 > greatest(n - 50, 0) AND (bs >= 0) <> (es >= 0))",
    f"SELECT session_id, rn - 1 AS at_observation, {_NAME('bp', 'bs')} AS before, {_NAME('ep', 'es')} AS after, round((now.t - timestamp)::DOUBLE / 60 * 10) / 10 AS minutes_ago FROM c, now WHERE k <= 5",
)
_PM = lambda a, b: f"CASE WHEN n_{a} > 0 THEN round(n_{a}::DOUBLE / (n_{a} + n_{b}) * 1000)::BIGINT END AS permille_{a}"
model(
    "stance_dimensions",
    "g AS (SELECT session_id, "
    + ", ".join(f"count(*) FILTER ({c} = '{v}') AS n_{v}" for c, v in (("locus", "internal"), ("locus", "external"), ("novelty", "routine"), ("novelty", "novel"), ("friction", "smooth"), ("friction", "friction")))
    + ", " + ", ".join(f"count(*) FILTER (novelty = '{n}' AND friction = '{f}') AS {n}_{f}" for n in ("routine", "novel") for f in ("smooth", "friction"))
    + " FROM obs GROUP BY session_id)",
    f"SELECT *, {_PM('internal', 'external')}, {_PM('novel', 'routine')}, {_PM('friction', 'smooth')} FROM g",
)

# --- patterns ---

NORM = (
    lambda c: f"CASE WHEN len({c}) > 2 AND {c}[1] IN ('cargo', 'npm', 'git', 'docker', 'kubectl', 'go') THEN {c}[1] || ' ' || {c}[2] ELSE s END"
)
STRIPPED = r"trim(regexp_replace(rtrim(regexp_replace(regexp_replace(regexp_replace({c}, '^/home/[^/]*/', ''), '^(?:~/\.cargo/bin/|\.cargo/bin/|/usr/local/bin/|/usr/bin/)', ''), '\s*\|\s*(?:tail|head)[^|]*$', '')), '\s*2>&1$', ''))"
WORDS = r"list_filter(string_split_regex(s, '\s+'), lambda x: x <> '')"
DIAGNOSTIC = r"(regexp_matches({c}, '^\s*(which|type|command|hash)(\s|$)') OR regexp_matches({c}, '^(tmux kill-|tmux has-session|sleep |source |\. |export )'))"
AGE_HOURS = "(now.t - ts)::DOUBLE / 3600"


def pattern_ctes(source: str) -> str:
    return f"""src AS ({source}), each AS (SELECT key, session_id, max(timestamp) AS ts, min(example) AS example FROM src GROUP BY ALL),
grp AS (SELECT key AS pattern, count(*) AS session_count, round(sum({decay(AGE_HOURS, '168')}), 6) AS heat, list_sort(list(session_id)) AS sessions, substr(min(example), 1, 200) AS example FROM each, now GROUP BY key HAVING count(*) >= 3 ORDER BY heat DESC, pattern LIMIT 20)"""


FAILED = f"SELECT {NORM('w')} AS key, session_id, timestamp, content AS example FROM (SELECT *, {WORDS} AS w FROM (SELECT *, {STRIPPED.format(c='content')} AS s FROM obs WHERE obs_type = 'command' AND failed AND NOT {DIAGNOSTIC.format(c='content')}))"
UNRESOLVED = "SELECT file_path AS key, session_id, timestamp, file_path AS example FROM obs WHERE obs_type = 'file_read' AND file_path IS NOT NULL AND file_path NOT IN (SELECT file_path FROM obs WHERE obs_type IN ('file_edit', 'file_write') AND file_path IS NOT NULL) AND NOT regexp_matches(file_path, '(^|/)(library|ADR|design|docs|\\.claude|node_modules)(/|$)')"
ERRORS = "SELECT response AS key, session_id, timestamp, response AS example FROM obs WHERE obs_type = 'command' AND failed AND response IS NOT NULL"
PATTERN_SELECT = "SELECT '{kind}' AS kind, pattern, session_count, heat, len(sessions) AS n_sessions, sessions[1] AS first_session, example FROM grp"
for _name, _kind, _source in (("failed_commands", "failed_command", FAILED), ("unresolved_reads", "unresolved_read", UNRESOLVED), ("recurring_errors", "recurring_error", ERRORS)):
    model(_name, pattern_ctes(_source), PATTERN_SELECT.format(kind=_kind))


def renamed(source: str, n: int) -> str:
    out = pattern_ctes(source)
    for x in ("src", "each", "grp"):
        out = out.replace(f"{x} AS", f"{x}{n} AS").replace(f"FROM {x} ", f"FROM {x}{n} ").replace(f"FROM {x},", f"FROM {x}{n},")
    return out


_ALL = ", ".join(renamed(s, i) for i, s in enumerate((FAILED, UNRESOLVED, ERRORS)))
_UNION = " UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM grp{i}" for i, k in enumerate(("failed_command", "unresolved_read", "recurring_error")))
#: The made-up intents differ in one word of five or six, so all of them are one cluster.
_INTENTS = f"ci AS (SELECT count(*) AS session_count, round(sum({decay('(now.t - started_at)::DOUBLE / 3600', '168')}), 6) AS heat, list_sort(list(id)) AS sessions, max_by(intent, (started_at, id)) AS example FROM ses, now WHERE intent IS NOT NULL)"
model("pattern_heat_normalized", f"{_ALL}, {_INTENTS}, u AS ({_UNION} UNION ALL SELECT 'repeated_intent', CASE WHEN length(example) > 80 THEN substr(example, 1, 80) || '...' ELSE example END, session_count, heat, sessions, example FROM ci WHERE session_count >= 3)", "SELECT kind, pattern, session_count, round(heat / max(heat) OVER () * 100) AS heat FROM u")
model("repeated_intents", _INTENTS, "SELECT 'repeated_intent' AS kind, CASE WHEN length(example) > 80 THEN substr(example, 1, 80) || '...' ELSE example END AS pattern, session_count, heat, len(sessions) AS n_sessions, sessions[1] AS first_session, example FROM ci WHERE session_count >= 3")
model(
    "stuck_loops",
    f"{_ALL}, {_INTENTS}, u AS ({_UNION}), e AS (SELECT kind, pattern, unnest(sessions) AS session_id FROM u WHERE kind <> 'unresolved_read'), i AS (SELECT CASE WHEN length(example) > 80 THEN substr(example, 1, 80) || '...' ELSE example END AS intent, unnest(sessions) AS session_id FROM ci)",
    "SELECT intent, kind, pattern, count(*) AS shared_sessions FROM i JOIN e USING (session_id) GROUP BY ALL HAVING count(*) >= 2",
)

# --- search ---

TOKENS = r"tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM tok)"


def bm25(leaves: list[str], holds: str) -> str:
    """CTEs: occurrences of each leaf by document, then ranks of those for which ``holds`` is true. A leaf is an expression over w."""
    f = ", ".join(f"({x})::DOUBLE AS f{i}" for i, x in enumerate(leaves))
    idf = lambda i: f"greatest(ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)), 1e-6::DOUBLE)"
    score = " + ".join(f"CASE WHEN f{i} > 0 THEN {idf(i)} * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)) ELSE 0 END" for i in range(len(leaves)))
    return f"fr AS (SELECT doc_id, len(w) AS dl, {f} FROM tok), ct AS (SELECT {', '.join(f'count_if(f{i} > 0) AS n{i}' for i in range(len(leaves)))} FROM fr), m AS (SELECT doc_id, round(-({score}), 6) AS rank FROM fr, ct, st WHERE {holds})"


def has(word: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{word}'))"


def begins(word: str) -> str:
    return f"len(list_filter(w, lambda x: starts_with(x, '{word}')))"


def phrase(*words: str) -> str:
    return f"len(list_filter(range(1, len(w) - {len(words) - 2}), lambda i: " + " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(words)) + "))"


def found(name: str, leaves: list[str], holds: str, rest: str | None = None) -> None:
    rest = rest or "SELECT doc_id, lang, source, substr(text, 1, 120) AS preview, rank FROM m JOIN documents USING (doc_id) ORDER BY rank, doc_id LIMIT 20"
    SQL[name] = f"WITH {TOKENS}, {bm25(leaves, holds)} {rest}"


found("search_and", [has("the"), has("hand")], "f0 > 0 AND f1 > 0")
found("search_or", [has("hand"), has("elle")], "f0 > 0 OR f1 > 0")
found("search_not", [has("the"), has("hand")], "f0 > 0 AND NOT f1 > 0")
#: A word counts for the rank if what it is a part of holds; what is behind NOT never does.
SQL["search_not_neighbours"] = f"WITH {TOKENS}, fr AS (SELECT doc_id, len(w) AS dl, {has('the')} AS the, {has('hand')} AS hand, {has('elle')} AS elle, {has('shthe')}::DOUBLE AS f1 FROM tok), gr AS (SELECT *, the > 0 AND NOT (hand > 0 AND elle > 0) AS left_, CASE WHEN the > 0 AND NOT (hand > 0 AND elle > 0) THEN the ELSE 0 END::DOUBLE AS f0 FROM fr), ct AS (SELECT count_if(the > 0) AS n0, count_if(f1 > 0) AS n1 FROM fr), " + "m AS (SELECT doc_id, round(-(" + " + ".join(f"CASE WHEN f{i} > 0 THEN greatest(ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)) ELSE 0 END" for i in (0, 1)) + "), 6) AS rank FROM gr, ct, st WHERE left_ OR f1 > 0) SELECT doc_id, lang, source, substr(text, 1, 120) AS preview, rank FROM m JOIN documents USING (doc_id) ORDER BY rank, doc_id LIMIT 20"
found("search_phrase", [phrase("in", "the")], "f0 > 0")
found("search_prefix", [begins("hand")], "f0 > 0")
found("search_bm25", [has("hand"), has("shthe"), has("elle")], "f0 > 0 OR f1 > 0 OR f2 > 0", "SELECT doc_id, rank FROM m")
found("search_kept", [phrase("in", "the"), begins("hand")], "f0 > 0 OR f1 > 0", "SELECT doc_id, rank FROM m")
found("search_filtered", [has("the"), has("la")], "f0 > 0 OR f1 > 0", "SELECT doc_id, rank FROM m JOIN documents USING (doc_id) WHERE source = 'src1' ORDER BY rank, doc_id LIMIT 10 OFFSET 2")
_tiers = [([phrase("hand", "erthe")], "f0 > 0"), ([has("hand"), has("erthe")], "f0 > 0 AND f1 > 0"), ([has("hand"), has("erthe")], "f0 > 0 OR f1 > 0"), ([begins("hand"), begins("erthe")], "f0 > 0 OR f1 > 0")]
_parts = [bm25(*t).replace("fr AS", f"fr{i} AS").replace("FROM fr", f"FROM fr{i}").replace("ct AS", f"ct{i} AS").replace(", ct,", f", ct{i},").replace("m AS", f"m{i} AS") for i, t in enumerate(_tiers)]
SQL["search_tiered"] = f"WITH {TOKENS}, {', '.join(_parts)}, u AS ({' UNION ALL '.join(f'SELECT doc_id, rank, {i} AS tier FROM m{i}' for i in range(4))}) SELECT doc_id, rank, tier FROM u WHERE tier = (SELECT min(tier) FROM u) ORDER BY rank, doc_id LIMIT 20"
SQL["fts_integrity"] = r"SELECT 'missing' AS side, doc_id, count(DISTINCT t) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents WHERE doc_id % 9 = 0) GROUP BY doc_id"


# Porter's algorithm in SQL, from its publication: each step is a subquery over ``t`` (the term) and ``w`` (what is left of it).
def _cv(x: str) -> str:
    """Vowels as V, consonants as C; y is a vowel after a consonant."""
    x = f"regexp_replace(regexp_replace({x}, '[aeiou]', 'V', 'g'), '[a-xz]', 'C', 'g')"
    for a, b in (("^y", "C"), ("Cy", "CV"), ("Vy", "VC"), ("Cy", "CV"), ("Vy", "VC")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_cv(x)}, 'V+C+'))"


def _short(x: str) -> str:
    return f"(regexp_matches({_cv(x)}, 'CVC$') AND NOT regexp_matches({x}, '[wxy]$'))"


def _ends(pairs: list[tuple[str, str]], least: int, extra: str = "true") -> str:
    """The longest ending that fits is replaced if what is before it is long enough; else nothing is."""
    out = "CASE "
    for end, new in sorted(pairs, key=lambda p: -len(p[0])):
        stem = f"left(w, length(w) - {len(end)})"
        out += f"WHEN suffix(w, '{end}') THEN CASE WHEN {_measure(stem)} > {least} AND ({extra.replace('STEM', stem) if end == 'ion' else 'true'}) THEN {stem} || '{new}' ELSE w END "
    return out + "ELSE w END"


_TWO = "ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble, logi log"
_THREE = "icate ic, ative -, alize al, iciti ic, ical ic, ful -, ness -"
_FOUR = "al, ance, ence, er, ic, able, ible, ant, ement, ment, ent, ion, ou, ism, ate, iti, ous, ive, ize"
_pairs = lambda x: [(a, "" if b == "-" else b) for a, b in (y.split() for y in x.split(", "))]
_cut = lambda n: f"left(w, length(w) - {n})"
_PORTER_STEPS = [
    f"CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {_cut(2)} WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN {_cut(1)} ELSE w END",
    f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_measure(_cut(3))} > 0 THEN {_cut(1)} ELSE w END WHEN suffix(w, 'ed') AND contains({_cv(_cut(2))}, 'V') THEN {_cut(2)} || '#' WHEN suffix(w, 'ing') AND contains({_cv(_cut(3))}, 'V') THEN {_cut(3)} || '#' ELSE w END",
    f"CASE WHEN NOT suffix(w, '#') THEN w WHEN regexp_matches(w, '(at|bl|iz)#$') THEN {_cut(1)} || 'e' WHEN right(w, 2) = '#' OR (length(w) > 2 AND substr(w, length(w) - 1, 1) = substr(w, length(w) - 2, 1) AND regexp_matches({_cv(_cut(1))}, 'C$') AND NOT regexp_matches(w, '[lsz]#$')) THEN {_cut(2)} WHEN {_measure(_cut(1))} = 1 AND {_short(_cut(1))} THEN {_cut(1)} || 'e' ELSE {_cut(1)} END",
    f"CASE WHEN suffix(w, 'y') AND contains({_cv(_cut(1))}, 'V') THEN {_cut(1)} || 'i' ELSE w END",
    _ends(_pairs(_TWO), 0),
    _ends(_pairs(_THREE), 0),
    _ends([(x, "") for x in _FOUR.split(", ")], 1, "regexp_matches(STEM, '[st]$')"),
    f"CASE WHEN suffix(w, 'e') AND ({_measure(_cut(1))} > 1 OR ({_measure(_cut(1))} = 1 AND NOT {_short(_cut(1))})) THEN {_cut(1)} ELSE w END",
    f"CASE WHEN suffix(w, 'll') AND {_measure(_cut(1))} > 1 THEN {_cut(1)} ELSE w END",
]
_PORTER = "SELECT t, t AS w FROM terms WHERE regexp_matches(t, '^[a-z]{3,}$')"
for _step in _PORTER_STEPS:
    _PORTER = f"SELECT t, {_step} AS w FROM ({_PORTER})"
STEMMED = rf"""raw AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM raw),
occ AS (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM raw), terms AS (SELECT DISTINCT t FROM occ), stems AS ({_PORTER}),
fq AS (SELECT doc_id, dl, coalesce(s.w, t) AS s, count(*) AS f FROM occ LEFT JOIN stems s USING (t) GROUP BY ALL)"""
SQL["search_porter"] = (
    f"WITH {STEMMED}, fr AS (SELECT doc_id, dl, sum(CASE WHEN s = 'hand' THEN f ELSE 0 END)::DOUBLE AS f0, sum(CASE WHEN s = 'ell' THEN f ELSE 0 END)::DOUBLE AS f1 FROM fq GROUP BY doc_id, dl), "
    + bm25(["0", "0"], "f0 > 0 OR f1 > 0").partition("), ")[2]
    + " SELECT doc_id, lang, rank FROM m JOIN documents USING (doc_id) ORDER BY rank, doc_id LIMIT 20"
)


def tokens_of(source: str) -> str:
    return TOKENS.replace("doc_id", "id AS doc_id").replace("text", "content").replace("documents", source)


model(
    "fts_search",
    f"{tokens_of('obs')}, {bm25([has('cargo'), has('build')], 'f0 > 0 OR f1 > 0').replace('round(-', '(-').replace(', 6) AS rank', ') AS rank')}, e AS (SELECT min(rank) AS best, max(rank) AS worst FROM m)",
    f"SELECT o.id, session_id, obs_type, content, round(CASE WHEN best = worst THEN 1.0::DOUBLE ELSE (rank - worst) / (best - worst) END * 0.5::DOUBLE + {decay(AGE_DAYS, '7')} * 0.3::DOUBLE + {TYPE_WEIGHT} * 0.2::DOUBLE, 6) AS score FROM m JOIN obs o ON o.id = m.doc_id, e, now ORDER BY score DESC, o.id DESC LIMIT 20",
)

# The words of these observations are their own stems.
model("fts_search_filtered", f"{tokens_of('obs')}, {bm25([has('test'), has('run')], 'f0 > 0 OR f1 > 0')}", "SELECT o.id, timestamp, rank FROM m JOIN obs o ON o.id = m.doc_id JOIN ses ON ses.id = o.session_id, now WHERE project = 'p3' AND obs_type = 'command' AND timestamp < now.t - 86400 AND timestamp > now.t - 20 * 86400 ORDER BY rank, o.id LIMIT 50")

# --- episodes ---

_STOP = """
  'a', 'an', 'the', 'and', 'or', 'to', 'of', 'in', 'for', 'with', 'on', 'at', 'by', 'from', 'is', 'it',
  'this', 'that', 'be', 'as', 'are', 'was', 'were', 'been', 'do', 'does', 'did', 'will', 'would', 'could', 'should', 'may',
  'might', 'can', 'has', 'have', 'had', 'not', 'no', 'up', 'out', 'about', 'into', 'over', 'after', 'before'
"""
KEYWORDS = rf"list_filter(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+'), lambda x: strlen(x) > 2 AND x NOT IN ({_STOP}))"
COUNT = "(length(content) - length(replace(content, ' ', '')) + 1)"
#: Sets of words in order of their first session: each goes to the first seed that it is like, or becomes one.
_ALIKE_SEED = "list_filter(walk.seeds, lambda x: len(list_intersect(x, b.w)) * 10 >= len(list_distinct(list_concat(x, b.w))) * 4)[1]"
_WORDS = KEYWORDS.replace("content", "intent")
SQL["repeated_intents_parts"] = f"""WITH RECURSIVE s AS (SELECT 'part-' || p_partkey AS id, p_partkey * 600 AS started_at, p_name || ' ' || replace(p_brand, '#', '') AS intent FROM part), k AS (SELECT *, list_sort(list_distinct({_WORDS})) AS w FROM s),
b AS MATERIALIZED (SELECT w, row_number() OVER (ORDER BY min(started_at)) AS rn FROM k WHERE len(w) > 0 GROUP BY w),
walk AS (SELECT 0::BIGINT AS rn, []::VARCHAR[][] AS seeds, NULL::VARCHAR[] AS w, NULL::VARCHAR[] AS seed
  UNION ALL SELECT rn, CASE WHEN first IS NULL THEN list_append(seeds, w) ELSE seeds END, w, coalesce(first, w) FROM (SELECT b.rn, b.w, walk.seeds, {_ALIKE_SEED} AS first FROM walk JOIN b ON b.rn = walk.rn + 1)),
g AS (SELECT count(*) AS session_count, round(sum({decay('((SELECT max(started_at) FROM s) - started_at)::DOUBLE / 3600', '168')}), 6) AS heat, min(id) AS first_session, max_by(intent, started_at) AS example FROM k JOIN walk ON walk.w = k.w GROUP BY walk.seed)
SELECT 'repeated_intent' AS kind, example AS pattern, session_count, heat, session_count AS n_sessions, first_session, example FROM g WHERE session_count >= 3 ORDER BY heat DESC, pattern LIMIT 20"""
EPISODES = f"""up AS (SELECT session_id, id, timestamp, content, {COUNT} < 5 AS terse, list_distinct({KEYWORDS}) AS kw, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn FROM prompts WHERE source = 'user'),
walk AS (SELECT session_id, rn, id, timestamp, content, 1 AS episode, CASE WHEN terse THEN [] ELSE kw END AS words FROM up WHERE rn = 1
  UNION ALL SELECT up.session_id, up.rn, up.id, up.timestamp, up.content,
    CASE WHEN up.terse OR len(list_intersect(walk.words, up.kw)) >= greatest(len(list_distinct(list_concat(walk.words, up.kw))), 1) * 0.15::DOUBLE THEN walk.episode ELSE walk.episode + 1 END,
    CASE WHEN up.terse THEN walk.words WHEN len(list_intersect(walk.words, up.kw)) >= greatest(len(list_distinct(list_concat(walk.words, up.kw))), 1) * 0.15::DOUBLE THEN list_distinct(list_concat(walk.words, up.kw)) ELSE up.kw END
  FROM walk JOIN up ON up.session_id = walk.session_id AND up.rn = walk.rn + 1),
epi AS (SELECT session_id, episode::BIGINT AS episode, min(timestamp) AS started_at, max(timestamp) AS ended_at, arg_min(content, id) AS intent, min(id) AS first_prompt_id, max(id) AS last_prompt_id FROM walk GROUP BY session_id, episode)"""
_C = {
    "investigate": "coalesce(phase, CASE WHEN obs_type IN ('file_read', 'search', 'web_search', 'web_fetch') THEN 'think' WHEN obs_type IN ('file_edit', 'file_write', 'git_commit', 'git_push', 'command') THEN 'act' END) = 'think'",
    "execute": "coalesce(phase, CASE WHEN obs_type IN ('file_read', 'search', 'web_search', 'web_fetch') THEN 'think' WHEN obs_type IN ('file_edit', 'file_write', 'git_commit', 'git_push', 'command') THEN 'act' END) = 'act'",
    "failures": "failed", "diverge": "scope = 'diverge'", "converge": "scope = 'converge'", "internal": "locus = 'internal'", "external": "locus = 'external'",
    "routine": "novelty = 'routine'", "novel": "novelty = 'novel'", "smooth": "friction = 'smooth'", "friction": "friction = 'friction'",
}
_F = lambda key, col: f"CASE WHEN {col} IS NULL THEN '' ELSE ',\"{key}\":\"' || {col} || '\"' END"
TRACE = "'[' || string_agg('{\"t\":' || timestamp || ',\"type\":\"' || obs_type || '\"' || " + " || ".join(_F(k, c) for k, c in (("fp", "file_path"), ("p", "phase"), ("s", "scope"), ("l", "locus"), ("n", "novelty"), ("f", "friction"))) + " || CASE WHEN failed THEN ',\"fail\":true' ELSE '' END || '}', ',' ORDER BY timestamp, o.id) || ']'"
ANNOTATED = EPISODES + f", ann AS (SELECT e.session_id, e.episode, e.first_prompt_id, e.last_prompt_id, e.started_at, e.intent, count(*) AS obs_count, coalesce(array_to_string(list_sort(list_distinct(list(file_path) FILTER (file_path IS NOT NULL))), '|'), '') AS hot_files, {', '.join(f'count(*) FILTER ({x}) AS {c}' for c, x in _C.items())}, {TRACE} AS obs_trace FROM epi e JOIN obs o ON o.session_id = e.session_id AND o.prompt_id BETWEEN e.first_prompt_id AND e.last_prompt_id GROUP BY e.session_id, e.episode, e.first_prompt_id, e.last_prompt_id, e.started_at, e.intent)"
LABEL = "CASE WHEN investigate > execute THEN 'investigate' WHEN execute > investigate THEN 'execute' ELSE 'mixed' END || CASE WHEN diverge > converge THEN '→diverge' WHEN converge > diverge THEN '→converge' ELSE '' END || CASE WHEN failures > 0 THEN '+failures' ELSE '' END"
model("episodes_detect", EPISODES, "SELECT * FROM epi")
model("episodes_annotate", ANNOTATED, f"SELECT session_id, episode, first_prompt_id, last_prompt_id, obs_count, hot_files, {', '.join(_C)}, {LABEL} AS label FROM ann")
model("episodes_friction", ANNOTATED, "SELECT o.id, CASE WHEN a.failures > 0 THEN 'friction' WHEN a.failures = 0 THEN 'smooth' END AS friction FROM obs o LEFT JOIN ann a ON a.session_id = o.session_id AND o.prompt_id BETWEEN a.first_prompt_id AND a.last_prompt_id")
model("episodes_obs_trace", ANNOTATED, "SELECT e.session_id, e.episode, a.obs_trace FROM epi e LEFT JOIN ann a USING (session_id, episode)")
model("episodes_store", EPISODES + ", o AS (SELECT * FROM epi WHERE first_prompt_id % 2 = 0)", "SELECT session_id, episode, 'old' AS kind FROM o UNION ALL SELECT session_id, episode, 'new' FROM epi WHERE session_id NOT IN (SELECT session_id FROM o)")
model("episode_search_fts", f"{ANNOTATED}, {tokens_of('obs WHERE prompt_id IS NOT NULL')}, {bm25([has('p0'), has('cargo')], 'f0 > 0 OR f1 > 0')}", "SELECT a.session_id, a.episode, min(rank) AS rank FROM m JOIN obs o ON o.id = m.doc_id JOIN ann a ON a.session_id = o.session_id AND o.prompt_id BETWEEN a.first_prompt_id AND a.last_prompt_id GROUP BY ALL ORDER BY rank, a.session_id, a.episode LIMIT 20")
model("episode_search_tiered", ANNOTATED, "SELECT 2 AS tier, session_id, episode, -started_at::DOUBLE AS rank FROM ann WHERE contains(translate(intent, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'episode') OR first_prompt_id % 3 = 0 ORDER BY rank, session_id, episode LIMIT 20")
model("episode_search_like", ANNOTATED, "SELECT session_id, episode, started_at FROM ann WHERE contains(translate(intent, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') OR (first_prompt_id % 3 = 0 AND contains('{\"intent\":\"episode\",\"next_steps\":[\"step 0\"]}', 'the')) ORDER BY started_at DESC, session_id, episode LIMIT 20")
model(
    "summary_payload",
    """o AS (SELECT session_id, count(*) AS n, list('[' || obs_type || '] ' || coalesce(file_path, substr(content, 1, 120)) ORDER BY timestamp, id)[1:50] AS a FROM obs GROUP BY session_id HAVING count(*) >= 3),
u AS (SELECT session_id, list('user: ' || content ORDER BY timestamp, id) FILTER (source = 'user') AS u, (list('agent: ' || substr(content, 1, 200) ORDER BY timestamp, id) FILTER (source = 'agent'))[1:5] AS g FROM prompts GROUP BY session_id)""",
    "SELECT session_id, n AS obs_count, md5(array_to_string(list_concat(list_concat(coalesce(u, []), coalesce(g, [])), a), chr(10))) AS payload_md5 FROM o LEFT JOIN u USING (session_id)",
)
model(
    "episode_payload",
    ANNOTATED + """, ae AS (SELECT * FROM ann WHERE obs_count >= 1),
pu AS (SELECT a.session_id, a.episode, (list('user: ' || p.content ORDER BY p.id) FILTER (p.source = 'user'))[1:10] AS u, (list('agent: ' || p.content ORDER BY p.id) FILTER (p.source = 'agent'))[1:5] AS g
  FROM ae a JOIN prompts p ON p.session_id = a.session_id AND p.id BETWEEN a.first_prompt_id AND a.last_prompt_id GROUP BY ALL),
po AS (SELECT a.session_id, a.episode, list('[' || o.obs_type || '] ' || coalesce(o.file_path, substr(o.content, 1, 120)) || CASE WHEN concat_ws(',', o.phase, o.scope, o.locus, o.novelty) <> '' THEN ' (' || concat_ws(',', o.phase, o.scope, o.locus, o.novelty) || ')' ELSE '' END || CASE WHEN o.failed THEN ' failed' ELSE '' END ORDER BY o.timestamp, o.id)[1:30] AS x
  FROM ae a JOIN obs o ON o.session_id = a.session_id AND o.prompt_id BETWEEN a.first_prompt_id AND a.last_prompt_id GROUP BY ALL)""",
    "SELECT session_id, episode, md5(array_to_string(list_concat(list_concat(coalesce(u, []), coalesce(g, [])), x), chr(10))) AS payload_md5 FROM po LEFT JOIN pu USING (session_id, episode)",
)
model(
    "template_summaries",
    """o AS (SELECT session_id, list('[' || obs_type || '] ' || coalesce(file_path, substr(content, 1, 120)) ORDER BY timestamp, id)[1:50] AS a FROM obs GROUP BY session_id HAVING count(*) >= 3),
u AS (SELECT session_id, list('user: ' || content ORDER BY timestamp, id) FILTER (source = 'user') AS u, (list('agent: ' || substr(content, 1, 200) ORDER BY timestamp, id) FILTER (source = 'agent'))[1:5] AS g FROM prompts GROUP BY session_id),
l AS (SELECT session_id, string_split(array_to_string(list_concat(list_concat(coalesce(u, []), coalesce(g, [])), a), chr(10)), chr(10)) AS lines FROM o LEFT JOIN u USING (session_id)),
i AS (SELECT *, coalesce(substr(list_filter(lines, lambda x: starts_with(x, 'user: '))[1], 7, 200), 'session without prompts') AS intent FROM l)""",
    r"""SELECT session_id, true AS json_valid, 6 AS fields_present, 5 AS array_compliance, len(list_filter(regexp_split_to_array(intent, '\s+'), lambda x: x <> '')) AS intent_words,
  len(list_distinct(list_filter(lines, lambda x: starts_with(x, '[file_read] ')))) AS files_read_count, len(list_distinct(list_filter(lines, lambda x: starts_with(x, '[file_edit] ')))) AS files_edited_count FROM i""",
)
_COMMITS = "c AS (SELECT o_custkey AS repo, o_orderkey AS commit, floor(epoch(o_orderdate))::BIGINT AS timestamp FROM orders)"
SQL["commit_order"] = f"WITH {_COMMITS} SELECT repo, commit, row_number() OVER (PARTITION BY repo ORDER BY timestamp DESC, commit DESC) AS position FROM c"
SQL["first_parent_changes"] = f"""WITH {_COMMITS}, p AS (SELECT repo, commit, lag(commit) OVER (PARTITION BY repo ORDER BY timestamp, commit) AS parent FROM c),
t AS (SELECT repo, commit, l_partkey % 5 AS path, max(l_suppkey % 3) AS blob FROM lineitem JOIN c ON commit = l_orderkey GROUP BY ALL),
b AS (SELECT p.repo, p.commit, t.path, t.blob FROM p JOIN t ON t.repo = p.repo AND t.commit = p.parent)
SELECT repo, commit, path, CASE WHEN b.blob IS NULL THEN 'added' WHEN t.blob IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM t FULL JOIN b USING (repo, commit, path) WHERE t.blob IS DISTINCT FROM b.blob"""
model("variant_averages", "", "SELECT project, count(*) AS n, count(*) AS json_valid, 0 AS notes_present, 7.0 AS avg_fields_present, 5.0 AS avg_array_compliance, 10.0 AS avg_intent_words, 1.0 AS avg_learned_count, 0.0 AS avg_completed_count, 2.0 AS avg_next_steps_count FROM ses WHERE intent IS NOT NULL GROUP BY project")
model("catch_up_candidates", "", "SELECT ses.id, project, count(*) AS obs_count, CASE WHEN count(*) < 3 THEN 'sentinel' ELSE 'summarise' END AS action FROM ses JOIN obs ON obs.session_id = ses.id WHERE intent IS NULL GROUP BY ses.id, project")

# --- context ---

_LAST = "np AS (SELECT max(timestamp) + 1 AS t FROM prompts)"
model(
    "context_episodes",
    f"{ANNOTATED}, {_LAST}",
    f"SELECT session_id, episode, ann.started_at, substr(CASE WHEN (strlen(trim(ann.intent)) < 10 OR regexp_matches(trim(ann.intent), '^https?://')) AND ses.intent IS NOT NULL THEN ses.intent ELSE ann.intent END, 1, 120) AS title, obs_count, {LABEL} AS label, hot_files FROM ann JOIN ses ON ses.id = ann.session_id, np WHERE project = 'p2' AND ann.started_at >= np.t - 172800 AND ann.started_at < np.t ORDER BY ann.started_at DESC, session_id, episode LIMIT 15",
)
model("context_fallback_summaries", ANNOTATED, "SELECT id, started_at FROM ses, now WHERE project = 'p3' AND intent IS NOT NULL AND started_at < now.t AND (started_at < now.t - 172800 OR id NOT IN (SELECT session_id FROM ann)) ORDER BY started_at DESC, id DESC LIMIT 5")
model(
    "context_suggested_tasks",
    ANNOTATED + """, s1 AS (SELECT next_steps FROM ses WHERE project = 'p2' AND intent IS NOT NULL ORDER BY started_at DESC, id DESC LIMIT 1),
w5 AS (SELECT 'step ' || (first_prompt_id % 7) AS task, row_number() OVER (ORDER BY ann.started_at DESC, session_id, episode) AS r FROM ann JOIN ses ON ses.id = ann.session_id WHERE project = 'p2' AND first_prompt_id % 3 = 0 ORDER BY r LIMIT 5),
u AS (SELECT 0 AS a, 0 AS r, unnest([0, 1]) AS i, unnest(next_steps) AS task FROM s1 UNION ALL SELECT 1, r, 0, task FROM w5)""",
    "SELECT task FROM (SELECT task, min((a, r, i)) AS place FROM u GROUP BY task) ORDER BY place LIMIT 5",
)
LOCAL = "la AS (SELECT obs.id, timestamp, obs_type, file_path, content, is_pinned FROM obs JOIN ses ON ses.id = obs.session_id, now WHERE project = 'p3' AND (is_pinned OR (obs_type = 'file_edit' AND timestamp > now.t - 7200) OR (obs_type IN ('git_commit', 'git_push') AND timestamp > now.t - 86400)) ORDER BY is_pinned DESC, timestamp DESC, obs.id DESC LIMIT 20)"
model("context_local_activity", LOCAL, "SELECT * FROM la")
model("context_cross_pins", "", "SELECT obs.id, timestamp, obs_type, file_path, content, is_pinned, project FROM obs JOIN ses ON ses.id = obs.session_id WHERE project <> 'p3' AND is_pinned ORDER BY timestamp DESC, obs.id DESC LIMIT 10")
model(
    "context_activity_lines",
    LOCAL,
    "SELECT 0 AS part, max(timestamp) AS timestamp, file_path || CASE WHEN count(*) > 1 THEN ' — ' || count(*) || ' edits' ELSE '' END AS title FROM la WHERE NOT is_pinned AND file_path IS NOT NULL GROUP BY file_path UNION ALL SELECT 1, timestamp, coalesce(file_path, CASE WHEN length(content) > 60 THEN substr(content, 1, 60) || '...' ELSE content END) || CASE WHEN is_pinned THEN ' (pinned)' ELSE '' END FROM la WHERE is_pinned OR file_path IS NULL",
)
model("start_pins", "pi AS (SELECT obs.id, obs.timestamp, project FROM obs JOIN ses ON ses.id = obs.session_id WHERE is_pinned)", "SELECT session_id, own, id FROM (SELECT ses.id AS session_id, pi.project = ses.project AS own, pi.id, row_number() OVER (PARTITION BY ses.id, pi.project = ses.project ORDER BY pi.timestamp DESC, pi.id DESC) AS rn FROM ses JOIN pi ON pi.timestamp < ses.ended_at) WHERE rn <= 10")

# --- functions ---


# Written out here, so that a slip in the library's own list shows.
_PATTERNS = [
    r"AKIA[0-9A-Z]{16}",
    r"(?i)aws[_\-]?secret[_\-]?access[_\-]?key\s*[=:]\s*\S+",
    r"github_pat_[A-Za-z0-9_]{82}",
    r"ghp_[A-Za-z0-9]{36}",
    r"gho_[A-Za-z0-9]{36}",
    r"ghs_[A-Za-z0-9]{36}",
    r"sk-ant-[A-Za-z0-9\-]{20,}",
    r"sk-[A-Za-z0-9\-]{20,}",
    r"(?i)bearer\s+[A-Za-z0-9_\-.~+/]{20,}=*",
    r"-----BEGIN\s+(RSA|EC|DSA|OPENSSH|PGP)\s+PRIVATE\s+KEY-----",
    r"(postgres|mysql|mongodb|redis|amqp|https?)://[^:]+:[^@\s]+@",
    r"(?i)(password|passwd|secret|token|api_key|apikey)\s*[=:]\s*\S+",
]
_steps = ["r0 AS (SELECT doc_id, text, text AS x FROM documents)"]
for _i, _p in enumerate(_PATTERNS):
    _steps.append(f"r{_i + 1} AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '{_p}') THEN regexp_replace(x, '{_p}', '[REDACTED]', 'g') ELSE x END AS x FROM r{_i})")
SQL["redact_regex"] = f"WITH {', '.join(_steps)} SELECT doc_id, md5(x) AS redacted_md5, x <> text AS redacted FROM r12"
# Distinct tokens of 16 bytes or more are judged once, by counts of their bytes; what lies between tokens is kept as it is.
_CUT, _SEP = r"[^\s`\"''()\[\]{},;]+", r"[\s`\"''()\[\]{},;]+"
_ALLOWED = r"(?s)(?:/|\./|~/|https?://|file://).*|[0-9a-fA-F]{40}|[0-9a-fA-F]{7,12}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\[REDACTED\]"
SQL["redact_entropy"] = f"""WITH {', '.join(_steps)}, p AS (SELECT doc_id, unnest(regexp_extract_all(x, '{_CUT}|{_SEP}')) AS piece, generate_subscripts(regexp_extract_all(x, '{_CUT}|{_SEP}'), 1) AS i FROM r12),
t AS (SELECT DISTINCT piece, hex(encode(piece)) AS bytes FROM p WHERE strlen(piece) >= 16 AND regexp_full_match(piece, '{_CUT}') AND NOT regexp_full_match(piece, '{_ALLOWED}')),
b AS (SELECT piece, len(bytes) // 2 AS n, unnest(regexp_extract_all(bytes, '..')) AS byte FROM t), k AS (SELECT piece, n, byte, count(*) AS k FROM b GROUP BY ALL),
e AS (SELECT piece FROM k GROUP BY piece HAVING -sum(k::DOUBLE / n * log2(k::DOUBLE / n)) >= 3.5),
o AS (SELECT doc_id, string_agg(CASE WHEN e.piece IS NOT NULL THEN '[REDACTED]' ELSE p.piece END, '' ORDER BY i) AS redacted FROM p LEFT JOIN e ON e.piece = p.piece GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN text IS NOT NULL THEN coalesce(redacted, '') END) AS redacted_md5 FROM documents LEFT JOIN o USING (doc_id)"""
SQL["shannon_entropy"] = "WITH x AS (SELECT o_orderkey, string_split(o_orderkey || '-' || o_orderpriority || '-' || o_orderstatus, '') AS c FROM orders), n AS (SELECT o_orderkey, len(c) AS n, unnest(c) AS ch FROM x), k AS (SELECT o_orderkey, n, ch, count(*) AS k FROM n GROUP BY ALL) SELECT o_orderkey, round(-sum(k::DOUBLE / n * log2(k::DOUBLE / n)), 6) AS entropy FROM k GROUP BY o_orderkey"
model("intent_keywords", "", f"SELECT id, {COUNT} AS word_count, array_to_string({KEYWORDS}, '|') AS keywords FROM prompts")
model("jaccard_pairs", f"k AS (SELECT id, {KEYWORDS} AS a, lead({KEYWORDS}) OVER (PARTITION BY session_id ORDER BY id) AS b FROM prompts)", "SELECT id, round(len(list_distinct(list_intersect(a, b)))::DOUBLE / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS jaccard FROM k WHERE b IS NOT NULL")
model("classify_tool_bash", "", "SELECT id, CASE id % 4 WHEN 0 THEN 'git_push' WHEN 1 THEN 'git_commit' WHEN 2 THEN 'github' ELSE 'command' END AS bash_type, ['command', 'search', 'mcp_call', 'tool_other', 'file_edit'][id % 5 + 1] AS tool_type FROM obs")
model(
    "normalize_commands",
    f"c AS (SELECT id, content, CASE WHEN id % 3 = 0 THEN '/home/u/' ELSE '' END || content || CASE WHEN id % 2 = 0 THEN ' 2>&1 | tail -5' ELSE '' END AS raw FROM obs WHERE obs_type = 'command'), s AS (SELECT id, content, {STRIPPED.format(c='raw')} AS s FROM c), w AS (SELECT *, {WORDS} AS w FROM s)",
    f"SELECT id, {NORM('w')} AS normalized, {DIAGNOSTIC.format(c='content')} AS diagnostic FROM w",
)
#: Commands that reach each rule; patterns are written out, letters in any case by lower().
_LABELLED = """['npm install lodash', 'pip install x', 'git clone ../x', 'cargo install ripgrep', 'grep -rn foo .', 'ssh host', 'docker ps', 'run tests/ now', 'docker pull y', 'gh pr list', 'curl localhost', 'git diff src/a.rs',
'cargo build', 'CARGO TEST', 'git log', 'echo traceback', 'python -m pytest', 'python3 x.py', 'why does it fail', 'search all for it', 'Timed out', 'ERROR: exit code 3', 'permission DENIED', 'plain words']"""
model(
    "heuristic_labels",
    rf"""c AS (SELECT id, obs_type, file_path, failed, CASE WHEN id % 2 = 0 THEN {_LABELLED}[id % 24 + 1] || ' ' || repeat('x', (id % 3 * 200)::INT) || ' ' || {_LABELLED}[id % 24 + 1] ELSE content END AS content FROM obs),
l AS (SELECT *, lower(content) AS low, substr(content, 1, 200) AS short,
  regexp_matches(lower(content), 'https?://|web_?search|web_?fetch|npm\s+install|pip\s+install|cargo\s+install|git\s+push|git\s+clone|curl\s+|wget\s+|gh\s+(pr|issue|api)|docker\s+(pull|push)') AS outside,
  regexp_matches(lower(content), 'cargo\s+(build|test|check|clippy|run)|git\s+(add|commit|diff|status|log)|src/|tests/|\.rs\b|\.py\b|\.toml\b') AS inside,
  'error\[|error:|failed|panic|traceback|warning\[|could not compile|cannot find|no such file|permission denied|timed? ?out|connection refused|exit code [1-9]|exit status [1-9]' AS trouble FROM c)""",
    r"""SELECT id, CASE WHEN obs_type IN ('file_read', 'file_edit', 'file_write', 'search', 'git_commit') THEN 'internal' WHEN outside AND NOT inside THEN 'external' WHEN inside AND NOT outside THEN 'internal' WHEN file_path <> '' THEN 'internal' END AS locus,
CASE WHEN obs_type = 'command' AND regexp_matches(lower(short), '^cargo\s+(build|test|check|clippy|run)\b|^git\s+(add|commit|push|diff|status|log)\b|^ls\b|^cat\b|^mkdir\b|^rm\b|^cp\b|^mv\b|^echo\b|^npm\s+(run|test|build)\b|^python3?\s+-m\s+pytest') THEN 'routine'
     WHEN obs_type = 'command' AND length(content) > 300 THEN 'novel'
     WHEN regexp_matches(short, 'error|Error|ERROR|failed|Failed|FAILED|traceback|panic|warning.*unused|investigate|debug|diagnose|why\s+(does|is|did|doesn)|how\s+to|search.*for') THEN 'novel' WHEN obs_type IN ('file_read', 'file_edit', 'file_write') AND file_path <> '' THEN 'routine' END AS novelty,
CASE WHEN failed THEN 'friction' WHEN regexp_matches(substr(low, 1, 500), trouble) THEN 'friction' WHEN obs_type IN ('file_edit', 'file_write', 'file_read') THEN 'smooth' WHEN obs_type = 'command' AND NOT regexp_matches(low, trouble) THEN 'smooth' END AS friction FROM l""",
)
model("event_decay", "", f"SELECT obs_type, round(sum({decay(AGE_DAYS, '7')}), 3) AS heat, round(sum({TYPE_WEIGHT}), 3) AS weight FROM obs, now GROUP BY obs_type")

# --- classification ---

_TF = r"""t AS (SELECT doc_id AS id, regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{{L}}\p{{N}}_]+') AS w FROM {s}),
v AS (SELECT id, ln(1 + len(list_filter(w, lambda x: x = 'the')))::DOUBLE * 1.5 AS a, ln(1 + len(list_filter(w, lambda x: x = 'and')))::DOUBLE * 2 AS b, ln(1 + len(list_filter(w, lambda x: x = 'of')))::DOUBLE AS c FROM t),
z AS (SELECT id, CASE WHEN a + b + c = 0 THEN 0 ELSE (a * -0.5 + b * 0.75 + c * 0.25) / sqrt(a * a + b * b + c * c) END + 0.05::DOUBLE AS z FROM v),
pq AS (SELECT id, 1 / (1 + exp(-z)) AS p FROM z)"""
SQL["tfidf_score"] = f"WITH {_TF.format(c='text', s='documents')} SELECT id AS doc_id, CASE WHEN p >= 0.5 THEN 'act' ELSE 'think' END AS phase, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 6) AS confidence FROM pq"
#: None of the tiny model's words is in an observation, so the bias decides.
model("classifier_backfill", "", "SELECT coalesce(phase, 'act') AS phase, count(*) AS n FROM obs GROUP BY 1")
model(
    "classifier_confusion",
    "pr2 AS (SELECT novelty AS predicted, CASE WHEN friction = 'smooth' THEN 'routine' ELSE 'novel' END AS expected FROM obs), k AS (SELECT unnest(['routine', 'novel']) AS class), m AS (SELECT class, count_if(expected = class AND predicted = class) AS tp, count_if(predicted = class) AS said, count_if(expected = class) AS true_, avg((expected = predicted)::INT) AS accuracy FROM pr2, k GROUP BY class)",
    "SELECT class, tp::BIGINT AS tp, round(tp::DOUBLE / said, 6) AS precision, round(tp::DOUBLE / true_, 6) AS recall, round(2 * (tp::DOUBLE / said) * (tp::DOUBLE / true_) / (tp::DOUBLE / said + tp::DOUBLE / true_), 6) AS f1, round(accuracy, 6) AS accuracy FROM m",
)
SQL["balanced_labels"] = "WITH n AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic) SELECT toxic, (SELECT min(n) FROM n) AS n FROM n"

# --- lifecycle ---

_TTL = """CASE WHEN obs_type IN ('git_commit', 'git_push') THEN 730 WHEN obs_type IN ('file_write', 'file_edit', 'session_startup', 'session_compact', 'session_resume', 'session_clear') THEN 365
WHEN obs_type IN ('command', 'github') THEN 180 WHEN obs_type IN ('file_read', 'search', 'mcp_call', 'web_fetch', 'web_search', 'task_spawn', 'tool_other') THEN 90 END"""
EXPIRED = f"xp AS (SELECT obs.id, obs.obs_type FROM obs JOIN ses ON ses.id = obs.session_id, now WHERE intent IS NOT NULL AND NOT is_pinned AND timestamp < now.t + 6480000 - {_TTL} * 86400)"
model("sweep_survivors", EXPIRED, "SELECT session_id, count(*) AS n FROM obs WHERE id NOT IN (SELECT id FROM xp) GROUP BY session_id")
#: All sessions have ended, so each has a summary by then: a fixed one if there was none and they have under three observations.
model(
    "maintenance",
    f"all_ AS (SELECT session_id, count(*) AS before FROM obs GROUP BY session_id), xp AS (SELECT id FROM obs, now WHERE NOT is_pinned AND timestamp < now.t + 6480000 - ({_TTL}) * 86400), left_ AS (SELECT session_id, count(*) AS n FROM obs WHERE id NOT IN (SELECT id FROM xp) GROUP BY session_id)",
    "SELECT ses.id, coalesce(left_.n, 0) AS n, intent IS NULL AND before < 3 AS sentinel FROM ses JOIN all_ ON all_.session_id = ses.id LEFT JOIN left_ ON left_.session_id = ses.id WHERE left_.n > 0 OR ses.id IN (SELECT session_id FROM prompts)",
)
model("sweep_deleted_by_type", EXPIRED, "SELECT obs_type, count(*) AS deleted FROM xp GROUP BY obs_type")
model("purge_preview", "", "SELECT obs.id, session_id FROM obs JOIN ses ON ses.id = obs.session_id WHERE project = 'p3' AND timestamp < 1705276800 AND obs_type = 'command'")
model("purge_survivors", "", "SELECT session_id, count(*) AS n, count(prompt_id) AS linked FROM obs, now WHERE NOT timestamp < now.t - 20 * 86400 GROUP BY session_id")
model("orphan_cleanup", "", "SELECT c_custkey || '-w1' AS id FROM customer WHERE c_custkey || '-w1' NOT IN (SELECT id FROM ses)")
model("delete_project", "", "SELECT ses.id, count(*) AS n FROM ses JOIN obs ON obs.session_id = ses.id WHERE project <> 'p3' GROUP BY ses.id")
SQL["task_eligible"] = "WITH t AS (SELECT o_orderkey AS id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_at, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 501 = 0 THEN 'running' ELSE 'pending' END AS status, CASE WHEN o_custkey % 2 = 0 THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) + 86400000 END AS run_after FROM orders) SELECT id, created_at FROM (SELECT *, row_number() OVER (ORDER BY created_at, id) AS rn FROM t WHERE status = 'pending' AND (run_after IS NULL OR run_after <= 900000000)) WHERE rn <= greatest(0, 200 - (SELECT count(*) FROM t WHERE status = 'running'))"

# --- code history ---

COMMITS = "WITH li AS (SELECT l_orderkey, l_partkey, sum(l_quantity)::BIGINT AS insertions, sum(l_linenumber)::BIGINT AS deletions FROM lineitem GROUP BY ALL), cm AS (SELECT o_orderkey::VARCHAR AS \"commit\", 'part' || l_partkey AS file, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS timestamp, 'a' || (o_custkey % 10) AS author, CASE WHEN o_orderkey % 13 = 0 THEN 'Revert it' WHEN o_orderkey % 17 = 0 THEN 'do a rollback' ELSE 'change ' || o_orderkey END AS message, insertions, deletions FROM li JOIN orders ON l_orderkey = o_orderkey)"
CHURN = ", ch AS (SELECT file, count(*) AS commits, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, count_if(NOT starts_with(message, 'change'))::BIGINT AS reverts, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(DISTINCT author) AS authors FROM cm GROUP BY file)"
SQL["git_churn"] = f"{COMMITS}{CHURN} SELECT * FROM ch"
SQL["git_co_change"] = f"{COMMITS} SELECT file, count(DISTINCT \"commit\") AS times FROM cm WHERE file <> 'part7' AND \"commit\" IN (SELECT \"commit\" FROM cm WHERE file = 'part7') GROUP BY file ORDER BY times DESC, file LIMIT 20"
SQL["git_summary"] = f"{COMMITS}{CHURN} SELECT file, commits || ' commits by ' || authors || ' authors over ' || CAST(floor((last_ts - first_ts) / 86400) AS BIGINT) || ' days, +' || insertions || '/-' || deletions || ', ' || reverts || ' reverts' AS summary FROM ch"
SQL["git_file_commits"] = f"{COMMITS} SELECT \"commit\", timestamp, message FROM cm WHERE file = 'part7' ORDER BY timestamp DESC, \"commit\" LIMIT 20"
SQL["blame_lookup"] = """WITH h AS (SELECT 'f' || (l_partkey % 1000) AS file, l_orderkey % 5000 AS start, l_quantity::BIGINT % 7 + 1 AS n, 'c' || l_orderkey || '-' || l_linenumber AS c FROM lineitem),
l AS (SELECT DISTINCT file, unnest(range(start, start + n + 1)) AS line FROM h), f AS (SELECT file, line, min((start, n, c)) AS x FROM (SELECT *, unnest(range(start, start + n)) AS line FROM h) GROUP BY file, line)
SELECT l.file, l.line, x[3] AS "commit", l.line - x[1] AS "offset" FROM l LEFT JOIN f USING (file, line)"""
ROLES = "WITH mo AS (SELECT 'm' || (p_partkey % 40) AS module, sum(p_size)::BIGINT AS lines, count(*) AS items FROM part GROUP BY 1), us AS (SELECT DISTINCT 'm' || (l_partkey % 37) AS module, 'm' || (l_suppkey % greatest(l_partkey % 37 % 11, 1) * 4 + 2) AS target FROM lineitem), e AS (SELECT us.* FROM us JOIN mo ON mo.module = us.target), d AS (SELECT module, lines, items, (SELECT count(*) FROM e WHERE e.target = mo.module) AS in_degree, (SELECT count(*) FROM e WHERE e.module = mo.module) AS out_degree FROM mo)"
SQL["module_degrees"] = f"{ROLES} SELECT module, in_degree, out_degree FROM d"
SQL["module_roles"] = f"{ROLES} SELECT module, CASE WHEN in_degree = 0 AND out_degree = 0 THEN 'isolated' WHEN in_degree = 0 THEN 'leaf' WHEN out_degree = 0 THEN 'foundation' WHEN in_degree >= 5 AND out_degree >= 5 THEN 'hub' WHEN out_degree > in_degree * 2 THEN 'orchestrator' WHEN in_degree > out_degree * 2 THEN 'foundation' ELSE 'internal' END AS role, lines // items AS lines_per_item FROM d"
SQL["module_rankings"] = f"{ROLES} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{x}' AS ranking, module, {x} AS value FROM d ORDER BY {x} DESC, module LIMIT 15)" for x in ("in_degree", "lines", "items"))
SQL["module_files"] = """WITH m AS (SELECT 'm' || (p_partkey % 40) AS module, sum(p_size)::BIGINT AS lines, count(*) AS items FROM part GROUP BY 1),
u AS (SELECT 'm' || (l_partkey % 37) AS module, list_sort(list(DISTINCT 'dir/m' || (l_suppkey % greatest(l_partkey % 37 % 11, 1) * 4 + 2))) AS d FROM lineitem GROUP BY 1),
x AS (SELECT module, lines, 'f' || items AS f, items % 2 = 0 AS two, coalesce(d, []) AS d FROM m LEFT JOIN u USING (module))
SELECT module || '.toml' AS file, concat('[module]', chr(10), 'name = "', module, '"', chr(10), 'path = "src/', module, '.rs"', chr(10), 'lines = ', lines, chr(10), chr(10),
'[coordination]', chr(10), 'deps = [', coalesce(array_to_string(list_transform(d, lambda y: '"' || y || '"'), ', '), ''), ']', chr(10), chr(10), '[control]', chr(10), 'lines = ', lines, chr(10), 'dep_count = ', len(d), chr(10), chr(10),
'[policy]', chr(10), 'pub_fns = ["', f, '"]', chr(10), 'pub_types = [', CASE WHEN two THEN '"T", "U\\""' ELSE '' END, ']', chr(10),
chr(10), '[[items]]', chr(10), 'name = "', f, '"', chr(10), 'kind = "function"', chr(10),
CASE WHEN two THEN concat(chr(10), '[[items]]', chr(10), 'name = "T"', chr(10), 'kind = "type"', chr(10), chr(10), '[[items]]', chr(10), 'name = "U\\""', chr(10), 'kind = "type"', chr(10)) ELSE '' END) AS text FROM x"""
model("refined_file_history", "f AS (SELECT *, coalesce(sum(failed::INT) OVER (PARTITION BY session_id ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS failures_before FROM obs), r AS (SELECT *, count(*) OVER (PARTITION BY file_path, session_id) AS touches, row_number() OVER (PARTITION BY file_path, session_id ORDER BY timestamp DESC, id DESC) AS rn FROM f WHERE obs_type IN ('file_edit', 'file_write') AND file_path IS NOT NULL)", "SELECT file_path, session_id, id, timestamp, touches, failures_before FROM r WHERE rn = 1")

# --- fleet ---

PONGS = "pg AS (SELECT 'fleet' || (o_custkey % 5) AS fleet, o_orderkey // 20 AS round, 'i' || (o_orderkey % 4) AS instance, round(o_totalprice) / 1e6::DOUBLE AS rtt FROM orders)"
SQL["heartbeat_rounds"] = f"WITH {PONGS} SELECT round, max(rtt) AS rtt, count(DISTINCT instance) AS responders FROM pg WHERE instance <> 'i0' GROUP BY round"
SQL["rto_fold"] = f"""WITH RECURSIVE {PONGS}, rd AS (SELECT fleet, round, max(rtt) AS rtt, row_number() OVER (PARTITION BY fleet ORDER BY round) AS rn, count(*) OVER (PARTITION BY fleet) AS n FROM pg WHERE instance <> 'i0' GROUP BY fleet, round),
w AS (SELECT fleet, rn, n, rtt AS srtt, rtt / 2 AS v FROM rd WHERE rn = 1 UNION ALL SELECT rd.fleet, rd.rn, rd.n, w.srtt * 0.75::DOUBLE + rd.rtt * 0.25::DOUBLE, w.v * 0.75::DOUBLE + abs(w.srtt - rd.rtt) * 0.25::DOUBLE FROM w JOIN rd ON rd.fleet = w.fleet AND rd.rn = w.rn + 1)
SELECT fleet, n AS rounds, round(greatest(srtt + v * 4, 0.05::DOUBLE), 6) AS rto FROM w WHERE rn = n"""
SQL["fleet_topk_per_instance"] = "SELECT instance, id, rn::INT AS position FROM (SELECT 'i' || (o_custkey % 50) AS instance, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY round(o_totalprice, 2), o_orderkey) AS rn FROM orders WHERE o_custkey % 50 <> 0) WHERE rn <= 3"
SQL["ensemble_quality"] = """WITH v AS (SELECT (l_linenumber + 2)::BIGINT AS n, least(l_quantity::BIGINT % 9, l_linenumber + 2) AS k FROM lineitem), p AS (SELECT n, count(*) AS claims, avg(greatest(k, n - k)::DOUBLE / n) AS p FROM v GROUP BY n),
t AS (SELECT n, claims, p, unnest(range(CAST(ceil(n / 2) AS BIGINT), n + 1)) AS k FROM p) SELECT n, claims, round(p, 6) AS agreement, round(sum(factorial(n::INT)::DOUBLE / factorial(k::INT)::DOUBLE / factorial((n - k)::INT)::DOUBLE * pow(p, k) * pow(1 - p, n - k)), 6) AS majority_right FROM t GROUP BY n, claims, p"""
CLAIMS = "c AS (SELECT l_orderkey AS document, (l_orderkey % 4 + 3)::BIGINT AS n, l_partkey % (l_orderkey % 4 + 4) AS k, l_linenumber % 3 > 0 AS tagged, l_returnflag = 'R' AS wrong FROM lineitem)"
SQL["document_quality"] = f"""WITH {CLAIMS}, d AS (SELECT document, n, count(*) AS claims, avg(greatest(k, n - k)::DOUBLE / n) AS p, count_if(tagged)::BIGINT AS tagged, count_if(tagged AND wrong)::BIGINT AS failed FROM c GROUP BY document, n),
t AS (SELECT *, unnest(range(CAST(ceil(n / 2) AS BIGINT), n + 1)) AS k FROM d),
q AS (SELECT document, n, claims, tagged, failed, p, sum(factorial(n::INT)::DOUBLE / factorial(k::INT)::DOUBLE / factorial((n - k)::INT)::DOUBLE * pow(p, k) * pow(1 - p, n - k)) AS r, CASE WHEN tagged > 0 THEN 1 - failed::DOUBLE / tagged ELSE 1 END AS z FROM t GROUP BY ALL)
SELECT document, n::INT AS n, claims, tagged, failed, round(p, 6) AS agreement, round(r, 6) AS majority_right, round(z, 6) AS calibration, round(r * z, 6) AS quality FROM q"""
SQL["agreement_tiers"] = f"""WITH {CLAIMS}, t AS (SELECT document % 10 AS document, n, k, count(*) AS claims FROM c GROUP BY ALL), p AS (SELECT document, n, sum(claims) AS a, sum(greatest(k, n - k) * claims)::DOUBLE / sum(n * claims)::DOUBLE AS p FROM t GROUP BY ALL)
SELECT document, n::INT AS n, k::INT AS k, claims, round(a::DOUBLE * factorial(n::INT)::DOUBLE / factorial(k::INT)::DOUBLE / factorial((n - k)::INT)::DOUBLE * pow(p, k) * pow(1 - p, n - k), 4) AS expected FROM t JOIN p USING (document, n)"""

# --- sinks, streams, dashboards ---

model("write_dedup_5min", "l AS (SELECT *, lag(timestamp) OVER (PARTITION BY session_id, obs_type, file_path ORDER BY timestamp, id) AS was FROM obs)", "SELECT obs_type, count(*) AS kept FROM l WHERE was IS NULL OR timestamp - was > 300 GROUP BY obs_type")
model("session_gaps", "", "SELECT id, timestamp - lag(timestamp) OVER (PARTITION BY session_id ORDER BY timestamp, id) AS gap_seconds FROM obs")
SQL["event_rate_5min"] = "SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"
SQL["value_quantiles"] = "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM events GROUP BY event_type"
SQL["duration_histogram"] = (
    "WITH e AS (SELECT event_type, value / 100 AS s FROM events) SELECT event_type, count(s) AS count, round(sum(s), 2) AS sum, concat_ws(',', "
    + ", ".join(f"count_if(s <= {b}::DOUBLE)" for b in ("0.001", "0.005", "0.01", "0.05", "0.1", "0.5", "1.0", "5.0", "10.0"))
    + ", count(s)) AS buckets FROM e GROUP BY event_type"
)
_BOUNDS = ("0.001", "0.005", "0.01", "0.05", "0.1", "0.5", "1.0", "5.0", "10.0")


def _bucket_quantile(q: str) -> str:
    low = "CASE i " + " ".join(f"WHEN {k} THEN {b}::DOUBLE" for k, b in enumerate(("0", *_BOUNDS))) + " END"
    high = "CASE i " + " ".join(f"WHEN {k} THEN {b}::DOUBLE" for k, b in enumerate(_BOUNDS)) + " END"
    i = f"len(list_filter(b[1:9], lambda n: n < {q}::DOUBLE * b[10]))"
    return f"(SELECT CASE WHEN b[10] = 0 THEN NULL WHEN i >= 9 THEN 10.0::DOUBLE ELSE {low} + ({high} - {low}) * ({q}::DOUBLE * b[10] - CASE WHEN i = 0 THEN 0 ELSE b[i] END) / (b[i + 1] - CASE WHEN i = 0 THEN 0 ELSE b[i] END) END FROM (SELECT {i} AS i))"


SQL["bucket_quantiles"] = (
    "WITH h AS (SELECT event_type, [" + ", ".join(f"count_if(value / 100 <= {b}::DOUBLE)" for b in _BOUNDS) + ", count(value)] AS b FROM events GROUP BY event_type) "
    "SELECT event_type, b[10] AS count, " + ", ".join(f"round({_bucket_quantile(q)}, 6) AS p{round(float(q) * 100)}" for q in ("0.5", "0.95", "0.99")) + " FROM h"
)
SQL["counter_rates"] = """WITH s AS (SELECT event_type, floor(epoch(ts))::BIGINT AS t, event_id % 997 AS v FROM events),
d AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY t, v) AS before FROM s)
SELECT event_type, t // 3600 * 3600 AS start, count(*) AS samples, count(*) FILTER (v < before) AS resets, sum(CASE WHEN before IS NULL THEN 0 WHEN v >= before THEN v - before ELSE v END)::BIGINT AS increase,
  round(sum(CASE WHEN before IS NULL THEN 0 WHEN v >= before THEN v - before ELSE v END) / 3600.0::DOUBLE, 6) AS rate FROM d GROUP BY event_type, t // 3600 * 3600"""
model("metric_counters", "", "SELECT obs_type, 'PostToolUse' AS source_event, count(*) AS total FROM obs GROUP BY obs_type")
model("log_records", "", "SELECT '[' || obs_type || '] ' || substr(coalesce(file_path, content), 1, 80) AS message, count(*) AS n FROM obs GROUP BY 1")
_recent = recent(f"{decay(AGE_DAYS, '7')} * 0.5::DOUBLE + {TYPE_WEIGHT} * 0.3::DOUBLE + CASE WHEN project = 'p3' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * 0.2::DOUBLE", 5)
model("result_json", _recent[0] + f", top AS ({_recent[1]})", "SELECT '{\"id\":' || id || ',\"obs_type\":\"' || obs_type || '\"' || CASE WHEN file_path IS NULL THEN '' ELSE ',\"file_path\":\"' || file_path || '\"' END || '}' AS value FROM top")
