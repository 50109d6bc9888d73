"""Text kernels that Spark lacks, in plain Python, and their Arrow UDFs: stemming, redaction by entropy, search syntax."""

from __future__ import annotations

import json
import math
import re
import sys
import unicodedata
from collections import Counter
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that searches leave out.
SEARCH_STOPWORDS = frozenset(
    [
        "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "did", "do", "does", "for", "from",
        "had", "has", "have", "in", "is", "it", "its", "may", "might", "not", "of", "on", "or", "shall", "should", "that", "the", "this",
        "to", "was", "were", "what", "which", "who", "will", "with", "would",
    ]
)

PLACEHOLDER = "[REDACTED]"
# Patterns of secrets, in the order in which they are replaced.
SECRETS = (
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
)
#: (threshold in bits, least length in bytes) by sensitivity; None: no entropy stage.
SENSITIVITY = {"strict": (3.5, 16), "normal": (4.0, 20), "relaxed": None}


def entropy_limits(sensitivity: str = "normal", threshold: float | None = None, least: int | None = None, enabled: bool = True) -> tuple[float, int] | None:
    """(threshold, least length): single limits win over the sensitivity; a threshold also over a relaxed one."""
    if not enabled or (SENSITIVITY[sensitivity] is None and threshold is None):
        return None
    own = SENSITIVITY[sensitivity] or SENSITIVITY["normal"]
    return (own[0] if threshold is None else threshold, own[1] if least is None else least)


def redact_patterns(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Only patterns that the input matches are replaced, each in what the ones before left."""

    def replaced(out: Column, p: str) -> Column:
        # A one-element array binds ``out`` to a name: written out in both branches it would double with each pattern.
        return F.get(F.transform(F.array(out), lambda x: F.when(text.rlike(p), F.regexp_replace(x, p, PLACEHOLDER)).otherwise(x)), F.lit(0))

    out, every = text, (*SECRETS, *extra)
    for p in every:
        out = replaced(out, p)
    # Most texts match none: one pass tells.
    return F.when(text.rlike("|".join(f"(?:{p})" for p in every)), out).otherwise(text)


def entropy(token: str) -> float:
    data = token.encode()
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()) if data else 0.0


_ALLOWED = re.compile(r"(?:/|\./|~/|https?://|file://).*|[0-9a-fA-F]{40}|[0-9a-fA-F]{7,12}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\[REDACTED\]", re.S)
_TOKEN = re.compile(r"[^\s`\"'()\[\]{},;]+")


def redact_entropy(text: str | None, threshold: float = 4.0, least: int = 20) -> str | None:
    """Tokens of ``least`` bytes or more and as many bits of entropy a byte as the threshold, unless they look like paths or ids."""

    def one(m: re.Match) -> str:
        t = m[0]
        return PLACEHOLDER if len(t.encode()) >= least and not _ALLOWED.fullmatch(t) and entropy(t) >= threshold else t

    return None if text is None else _TOKEN.sub(one, text)


def entropy_udf(limits: tuple[float, int] | None):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: redact_entropy(x, *limits))

    return run


def redact(text: Column, sensitivity: str = "normal", extra: tuple[str, ...] = (), limits: tuple[float, int] | None | str = "") -> Column:
    """Patterns, then tokens by entropy: by the sensitivity, or by ``limits`` (None: no such stage) if they are given."""
    limits = entropy_limits(sensitivity) if limits == "" else limits
    out = redact_patterns(text, extra)
    return out if limits is None else entropy_udf(limits)(out)


def redact_json(value: str | None, sensitivity: str = "normal", extra: tuple[str, ...] = ()) -> str | None:
    """All string leaves of a JSON text, redacted; a text that isn't JSON is redacted as it stands."""
    patterns = [re.compile(p) for p in (*SECRETS, *extra)]
    limits = entropy_limits(sensitivity)

    def leaf(x: str) -> str:
        for p in [p for p in patterns if p.search(x)]:
            x = p.sub(PLACEHOLDER, x)
        return x if limits is None else redact_entropy(x, *limits)

    def walk(x):
        if isinstance(x, str):
            return leaf(x)
        if isinstance(x, list):
            return [walk(y) for y in x]
        return {k: walk(y) for k, y in x.items()} if isinstance(x, dict) else x

    if value is None:
        return None
    try:
        return json.dumps(walk(json.loads(value)), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return leaf(value)


@F.pandas_udf(T.StringType())
def redact_json_udf(values: pd.Series) -> pd.Series:
    return values.map(redact_json)


#: All marks that combine with the letter before them; runs of characters that may have some.
_MARKS = frozenset(c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.combining(c))
_RUNS = re.compile("[^\x00-\x7f]+")


def fold(text: str) -> str:
    """Lower case without diacritics; ligatures and the like stay."""
    text = text.lower()
    return text if text.isascii() else _RUNS.sub(lambda m: "".join([c for c in m[0] if c not in _MARKS]), unicodedata.normalize("NFD", text))


_VOWELS = "aeiou"


def _is_y_vowel(word: str, i: int) -> bool:
    return word[i] == "y" and i > 0 and not _vowel(word, i - 1)


def _vowel(word: str, i: int) -> bool:
    return word[i] in _VOWELS or _is_y_vowel(word, i)


def _m(stem: str) -> int:
    return len(re.findall("v+c+", "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))))


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowel(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return n > 2 and not _vowel(word, n - 1) and _vowel(word, n - 2) and not _vowel(word, n - 3) and word[-1] not in "wxy"


# The endings of Porter's published algorithm.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """Porter's stemmer (1980), with the two later rules of its author. Words of under three letters stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for step in (_STEP2, _STEP3):
        end = next((e for e in sorted(step, key=len, reverse=True) if w.endswith(e)), None)
        if end and _m(w[: -len(end)]) > 0:
            w = w[: -len(end)] + step[end]
    end = next((e for e in sorted(_STEP4, key=len, reverse=True) if w.endswith(e)), None)
    if end and _m(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_m(w[:-1]) > 1 or (_m(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _m(w[:-1]) > 1:
        w = w[:-1]
    return w


def stems(text: str | None) -> list[str]:
    """Tokens of letters and digits, folded and stemmed."""
    return [porter(t) for t in re.findall(r"[^\W_]+", fold(text or ""))]


#: A worker's stems of words that it has seen, up to a stated number.
_STEMS: dict[str, str] = {}
STEMS = 200_000


def known_stems(text: str | None) -> list[str]:
    """``stems``, each word of which is stemmed once."""
    found = re.findall(r"[^\W_]+", fold(text or ""))
    try:
        return [_STEMS[t] for t in found]
    except KeyError:
        if len(_STEMS) > STEMS:
            _STEMS.clear()
        for t in set(found).difference(_STEMS):
            _STEMS[t] = porter(t)
        return [_STEMS[t] for t in found]


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems_udf(texts: pd.Series) -> pd.Series:
    return texts.map(known_stems)


_QUOTABLE = set("-:./\\(){}[]")
_OPERATORS = ("AND", "OR", "NOT", "NEAR")


def sanitize(query: str) -> str | None:
    """A search text with terms quoted that would otherwise be read as syntax; None if there is nothing to search for."""
    query = query.strip()
    if not query:
        return None
    quoted = lambda w: len(w) > 1 and w[0] == w[-1] == '"'
    if quoted(query):
        return query
    words = query.split()
    operands = any(w not in _OPERATORS for w in words)
    out = [w if quoted(w) or not (set(w) & _QUOTABLE or (w in _OPERATORS and not operands)) else f'"{w}"' for w in words]
    return " ".join(out)


def tiers(query: str) -> list[str]:
    """Ever looser searches for the words of a text: phrase, all, any, any beginning."""
    words = [w for w in query.replace('"', " ").split() if len(w.encode()) >= 2 and w.lower() not in SEARCH_STOPWORDS]
    terms = [f'"{w}"' if set(w) & _QUOTABLE or w in _OPERATORS else w for w in words]
    if not terms:
        return []
    prefix = [t if t.startswith('"') else f"{t}*" for t in terms]
    if len(terms) == 1:
        return [terms[0], prefix[0]]
    return ['"' + " ".join(words) + '"', " AND ".join(terms), " OR ".join(terms), " OR ".join(prefix)]


# Units of time and their seconds.
_UNITS = {
    "s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1,
    "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
    "w": 604800, "wk": 604800, "wks": 604800, "week": 604800, "weeks": 604800,
}


def parse_schedule(text: str, now: int) -> int:
    """When a task is due: now, tonight (the next 21:00), tomorrow (in a day), "[in] N unit" from 1, a Unix time, or an ISO time (UTC)."""
    t = text.strip().lower()
    if t == "now":
        return now
    if t == "tomorrow":
        return now + 86400
    if t == "tonight":
        tonight = now - now % 86400 + 21 * 3600
        return tonight if tonight > now else tonight + 86400
    m = re.fullmatch(r"(?:in\s+)?(\d+)\s*([a-z]+)", t)
    if m and int(m[1]) > 0 and m[2] in _UNITS:
        return now + int(m[1]) * _UNITS[m[2]]
    if t.isdigit() and int(t) > 1_000_000_000:
        return int(t)
    try:
        return int(datetime.fromisoformat(text.strip()).replace(tzinfo=UTC).timestamp())
    except ValueError:
        raise ValueError(f"not a time: {text!r}") from None


def parse_day(text: str) -> int:
    """Seconds at midnight UTC of a date like 2024-02-29; anything else is an error."""
    parts = text.split("-")
    try:
        if len(parts) != 3:
            raise ValueError
        return int(datetime(*map(int, parts), tzinfo=UTC).timestamp())
    except ValueError:
        raise ValueError(f"not a date: {text!r} (YYYY-MM-DD is needed)") from None


def parse_task(text: str) -> dict[str, str | None]:
    """A task file: settings between two ``---`` lines, then the prompt; without the second the whole text is the prompt."""
    out: dict[str, str | None] = {"project": None, "cwd": None, "after": None, "prompt": text.strip()}
    if m := re.match(r"\s*---[ \t]*\n(.*?)\n---[ \t]*(?:\n(.*))?$", text, re.S):
        for line in m[1].splitlines():
            key, _, value = line.partition(":")
            if key.strip() in ("project", "cwd", "after") and value.strip():
                out[key.strip()] = value.strip().strip("\"'")
        out["prompt"] = (m[2] or "").strip()
    return out


def balanced_json(text: str) -> str | None:
    """The first balanced ``{...}`` of a text, braces in strings aside."""
    depth, start, inside, skip = 0, None, False, False
    for i, c in enumerate(text):
        if inside:
            inside, skip = (True, not skip if c == "\\" else False) if c != '"' or skip else (False, False)
        elif c == '"' and depth:
            inside = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None
