"""Scalar functions over text, paths and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- numbers ---------------------------------------------------------------------------------------------------------

def round_half_up(x: Column | str, places: int = 0) -> Column:
    """floor(x * 10^n + 0.5) / 10^n, so that -2.5 becomes -2."""
    scale = float(10 ** places)
    return F.floor(col(x) * scale + 0.5).cast("double") / scale


def round_half_even(x: Column | str, places: int = 0) -> Column:
    return F.bround(col(x).cast("double"), places)


def min_max(x: Column | str, low: float, high: float) -> Column:
    """Clamped to [low, high], then scaled to [0, 1]; 0 where the range is empty."""
    if high <= low:
        return F.lit(0.0)
    return (F.least(F.greatest(col(x).cast("double"), F.lit(low)), F.lit(high)) - low) / (high - low)


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def size_kb(n_bytes: Column | str) -> Column:
    return round_half_up(col(n_bytes) / 1024.0, 2)


# -- strings ---------------------------------------------------------------------------------------------------------

def estimate_tokens(x: Column | str, chars_per_token: float = 3.5) -> Column:
    """Length over characters per token, rounded up; 0 for empty or null."""
    return F.coalesce(F.ceil(F.length(col(x)) / F.lit(chars_per_token)), F.lit(0)).cast("long")


def trim_space(x: Column | str) -> Column:
    """Both ends without any Unicode white space, not just blanks."""
    return F.regexp_replace(col(x), r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def content_key(x: Column | str) -> Column:
    return F.sha2(F.coalesce(col(x), F.lit("")), 256)


def lines(x: Column | str) -> Column:
    """Lines by line feed; trailing empty ones count."""
    return F.split(F.coalesce(col(x), F.lit("")), "\n", -1)


def count_matches(x: Column | str, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(col(x), F.lit("")), F.lit(pattern))


def line_number(x: Column | str, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.length(F.regexp_replace(F.substring(col(x), F.lit(1), offset), r"[^\n]", "")) + 1


def shell_safe(x: Column | str) -> Column:
    """Without characters that a shell or a URL could take for syntax."""
    return F.regexp_replace(col(x), r"[;&|`$(){}<>\\\"'\s]", "")


def diagram_id(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"[^a-zA-Z0-9_]", "_")


def diagram_label(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(x), r'"', "'"), r"[\[\]{}()<>|]", " ")


def mask_value(key: Column | str) -> Column:
    """Values of environment keys never leave a file."""
    return F.when(col(key).isNotNull(), F.lit("***masked***"))


# -- paths -----------------------------------------------------------------------------------------------------------

def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def dirname(path: Column | str) -> Column:
    p = col(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("."))


def extname(path: Column | str) -> Column:
    """Last dot and what follows, empty where the name begins with its only dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def normalise(path: Column | str) -> Column:
    """Folds '.' and '..' segments; a leading '..' that leaves the root stays."""
    parts = F.filter(F.split(col(path), "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(
        (s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(folded, "/")


def package_key(source: Column | str) -> Column:
    """@scope/name, or the first segment; null for relative, absolute and node: sources."""
    s = col(source)
    first = F.split_part(s, F.lit("/"), F.lit(1))
    scoped = F.concat_ws("/", first, F.split_part(s, F.lit("/"), F.lit(2)))
    return F.when(s.rlike(r"^(\.|/|node:)"), None).when(s.startswith("@"), scoped).otherwise(first)


# -- code lines ------------------------------------------------------------------------------------------------------

#: What a comment line begins with, for files and (without the last two) for parsed sources.
COMMENT_PREFIXES = ("//", "#", "--", ";", "%", "<!--")
PARSER_PREFIXES = ("//", "#", "--", ";")


#: What opens a block comment at a line's beginning, and what closes one.
BLOCK_OPENS, BLOCK_CLOSES = ("/*", '"""', "'''"), ("*/", '"""', "'''")


def _any(test, s: Column, marks: tuple[str, ...]) -> Column:
    out = test(s, F.lit(marks[0]))
    for m in marks[1:]:
        out = out | test(s, F.lit(m))
    return out


def code_lines(content: Column | str, prefixes: tuple[str, ...] = COMMENT_PREFIXES) -> Column:
    """Lines that are neither blank nor comment, block comments tracked from line to line, in one pass over the lines."""
    each = F.filter(F.transform(lines(content), trim_space), lambda s: s != "")
    start = F.struct(F.lit(0).alias("loc"), F.lit(False).alias("inside"))

    def step(acc: Column, s: Column) -> Column:
        opens, comment = _any(F.startswith, s, BLOCK_OPENS), _any(F.startswith, s, prefixes)
        code = ~acc["inside"] & ~opens & ~comment
        stays = F.when(acc["inside"], ~_any(F.contains, s, BLOCK_CLOSES)).otherwise(~comment & opens & ~_any(F.endswith, s, BLOCK_CLOSES))
        return F.struct((acc["loc"] + code.cast("int")).alias("loc"), stays.alias("inside"))

    return F.aggregate(each, start, step)["loc"]


# -- classifiers: ordered rules, the first that holds ----------------------------------------------------------------

def first_match(x: Column, rules: list[tuple[str, str]], otherwise: str | None) -> Column:
    """The name of the first rule whose pattern the text matches."""
    out = None
    for name, pattern in rules:
        out = F.when(x.rlike(pattern), name) if out is None else out.when(x.rlike(pattern), name)
    return out.otherwise(F.lit(otherwise))


#: Confidence classes from the lowest score of each.
CONFIDENCE = (("definite", 0.9), ("high", 0.7), ("medium", 0.5), ("low", 0.3))


def confidence_class(score: Column | str) -> Column:
    out = None
    for name, least in CONFIDENCE:
        out = F.when(col(score) >= least, name) if out is None else out.when(col(score) >= least, name)
    return out.otherwise("speculative")


#: Layers by path, in order.
LAYERS = [
    ("entry", r"(?i)^(index|main|app)\."), ("page", r"(?i)pages?/|views?/|screens?/"), ("component", r"(?i)components?/"), ("hook", r"(?i)hooks?/"),
    ("context", r"(?i)context/|providers?/"), ("service", r"(?i)services?/|api/"), ("controller", r"(?i)controllers?/"), ("route", r"(?i)routes?/"),
    ("middleware", r"(?i)middleware/|middlewares?/"), ("model", r"(?i)models?/|schemas?/|entities?/"), ("util", r"(?i)utils?/|helpers?/|lib/"),
    ("config", r"(?i)config/"), ("test", r"(?i)\.(test|spec)\.|__tests__|tests?/"),
]
#: Layers of the architecture summary, in order; other files have none.
SUMMARY_LAYERS = [
    ("component", r"(?i)\.(jsx|tsx)$"), ("hook", r"use[A-Z]|hooks"), ("page", r"(?i)pages?|views?|routes?|screens?"), ("service", r"(?i)services?|api"),
    ("util", r"(?i)utils?|helpers?|lib"), ("config", r"(?i)config"), ("model", r"(?i)models?|schemas?|entities?|types?"), ("middleware", r"(?i)middleware"),
    ("controller", r"(?i)controllers?"), ("test", r"(?i)\.(test|spec)\.|__tests__|tests?"),
]
#: Phases of a step by its lower-cased description, in order, and by its kind.
PHASES = [
    ("request", "route|endpoint", "route"), ("middleware", "middleware|interceptor|filter", None), ("authentication", "auth|login|jwt|token", None),
    ("validation", "valid|schema|parse|sanitize", None), ("controller", "controller", "controller"), ("service", "service", "service"), ("model", "model|schema|entity", "model"),
    ("database", "database|db|query|find|insert|update|delete|mongo|sql", None), ("response", "response|send|return|json", None), ("error", "error|throw|catch", None),
    ("redirect", r"redirect|next\(", None),
]


def layer(path: Column | str) -> Column:
    return first_match(col(path), LAYERS, "other")


def summary_layer(path: Column | str) -> Column:
    return first_match(col(path), SUMMARY_LAYERS, None)


def phase(description: Column | str, kind: Column | str | None = None) -> Column:
    text, out = F.lower(col(description)), None
    for name, pattern, own in PHASES:
        test = text.rlike(pattern)
        if own and kind is not None:
            test = test | F.coalesce(col(kind) == own, F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


#: Modules that count as builtin, by language.
NODE_BUILTINS = ("fs", "path", "os", "http", "https", "net", "dns", "crypto", "stream", "buffer", "events", "util", "url", "querystring", "assert", "child_process",
                 "cluster", "readline", "tls", "zlib", "process", "console", "timers", "string_decoder", "tty", "dgram")
PYTHON_BUILTINS = ("os", "sys", "json", "re", "math", "datetime", "collections", "itertools", "functools", "pathlib", "tempfile", "shutil", "glob", "logging", "unittest",
                   "argparse", "csv", "io", "hashlib", "random", "subprocess", "threading", "asyncio", "typing", "dataclasses", "enum")


def dependency_class(source: Column | str, language: Column | str | None = None) -> Column:
    """local, builtin or external. JavaScript: a relative source is local, else a lower-case or scoped name is a package."""
    s = col(source)
    js = F.when(s.rlike(r"^[./]"), "local").when(s.isin(*NODE_BUILTINS), "builtin").when(s.rlike(r"^[a-z@]"), "external").otherwise("local")
    if language is None:
        return js
    first = F.split_part(s, F.lit("."), F.lit(1))
    py = F.when(s.startswith("."), "local").when(first.isin(*PYTHON_BUILTINS), "builtin").otherwise("external")
    java = F.when(s.rlike(r"^javax?\."), "builtin").otherwise("external")
    lang = col(language)
    return F.when(lang == "Python", py).when(lang == "Java", java).otherwise(js)


# -- chat and retries ------------------------------------------------------------------------------------------------

#: How a follow-up question begins, and the words that point back.
FOLLOW_UP_PREFIXES = ("and", "also", "what about", "how about", "why", "can you", "could you", "tell me more", "elaborate", "go deeper", "explain further", "what else", "show me")
POINTING = r"\b(it|this|that|these|those|they|them)\b"


def is_follow_up(text: Column | str, prior: Column | str) -> Column:
    """Begins like one, points back in under 60 characters, or is under 30 after two or more turns; never first."""
    t = F.lower(trim_space(text))
    begins = F.exists(F.array(*map(F.lit, FOLLOW_UP_PREFIXES)), lambda p: F.startswith(t, p))
    n = F.length(t)
    return F.coalesce((col(prior) > 0) & (begins | (t.rlike(POINTING) & (n < 60)) | ((n < 30) & (col(prior) >= 2))), F.lit(False))


#: The three forms of a file name in an answer.
REFERENCES = (r"file:([^\s`\"]+)", r"`([^`]+\.(?:js|jsx|ts|tsx|py|java|go|rs|cpp|c|h|css|html|json|yaml|yml))`", r"\b(src/[\w/.-]+\.(?:js|jsx|ts|tsx|py|java))\b")


def file_references(text: Column | str) -> Column:
    """Distinct file names in a text, form by form in order of appearance."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(col(text), F.lit(p), F.lit(1)) for p in REFERENCES]))


def retry_delay_ms(attempt: Column | str, base_ms: int = 1000, jitter: Column | None = None) -> Column:
    return F.lit(float(base_ms)) * F.pow(F.lit(2.0), col(attempt) - 1) + (jitter if jitter is not None else F.lit(0.0))


#: What a message says of errors that pass, and of those that stay.
PASSING = r"429|rate limit|timeout|etimedout|econnreset|socket hang up|50[0234]|overloaded"
STAYING = r"\b40[013]\b|invalid api key|unauthori"


def is_retryable(message: Column | str) -> Column:
    """Rate limits, timeouts, dropped connections and server errors; never bad requests or bad keys."""
    m = F.lower(col(message))
    return m.rlike(PASSING) & ~m.rlike(STAYING)
