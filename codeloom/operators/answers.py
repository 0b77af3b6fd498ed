"""From a question to an answer over a store of chunks, and from a model's text to checked JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codeloom.operators import chat, retrieval

_FENCE = re.compile(r"```[a-zA-Z]*\s*(.*?)(?:```|\Z)", re.DOTALL)
_PARTS = re.compile(r'"(?:[^"\\]|\\.)*"|[^"]+')
_QUOTED = re.compile(r"""\"(?:[^"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^"']+|["']""")
CLOSERS = {"{": "}", "[": "]"}


def balanced(text: str) -> str | None:
    """From the first opening bracket to the one that closes it; what a cut text leaves open is closed."""
    start = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
    if start < 0:
        return None
    stack, quoted, k = [], False, start
    while k < len(text):
        c = text[k]
        if quoted:
            if c == "\\":
                k += 1
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in CLOSERS:
            stack.append(CLOSERS[c])
        elif c in "}]":
            if not stack or c != stack.pop():
                return None
            if not stack:
                return text[start:k + 1]
        k += 1
    rest = text[start:].rstrip("\\") + '"' if quoted else text[start:].rstrip().rstrip(",").rstrip()
    return rest + ("null" if rest.endswith(":") else "") + "".join(reversed(stack))


def repaired(text: str) -> str:
    """Turns single quotes into double ones, quotes bare keys and drops commas before a closing bracket, outside of strings."""
    double = lambda x: '"' + x[1:-1].replace("\\'", "'").replace('"', '\\"') + '"'
    text = "".join(double(x) if x[0] == "'" and len(x) > 1 else x for x in (m[0] for m in _QUOTED.finditer(text)))
    parts = [m[0] for m in _PARTS.finditer(text)]
    plain = lambda x: re.sub(r",(\s*[}\]])", r"\1", re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', x))
    return "".join(x if x.startswith('"') else plain(x) for x in parts)


def salvaged(text: str | None) -> str | None:
    """The JSON of a model's text: in the first fence that has any, else among words; cut off, with single quotes, bare keys or commas too many; None where there is none."""
    if text is None:
        return None
    for source in [m[1] for m in _FENCE.finditer(text)] + [text]:
        body = balanced(source)
        for made in (source.strip(), body, repaired(body) if body else None):
            try:
                found = json.loads(made) if made else None
            except ValueError:
                continue
            if isinstance(found, dict | list):
                return json.dumps(found, ensure_ascii=False)
    return None


@F.pandas_udf(StringType())
def _salvage(texts: pd.Series) -> pd.Series:
    return texts.map(salvaged)


def model_json(rows: DataFrame, text: str) -> DataFrame:
    """Adds json (null where the text has none) and was_repaired; texts that are JSON as they stand stay as they are."""
    plain = F.when(F.col(text).rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull(), F.col(text))
    return rows.withColumn("json", F.coalesce(plain, _salvage(text))).withColumn("was_repaired", plain.isNull() & F.col("json").isNotNull())


#: What the types of a schema are called by the engine.
TYPES = {"number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "string": "^STRING", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^(OBJECT|VOID)"}


def schema_errors(text: Column | str, fields: dict[str, str]) -> Column:
    """What JSON lacks of required fields (name to type): 'no JSON', or 'name missing' and 'name not type' in order; a null field is there, as an object."""
    v = F.try_parse_json(text)

    def error(name: str, kind: str) -> Column:
        field = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(field.isNull(), f"{name} missing").when(~F.schema_of_variant(field).rlike(TYPES[kind]), f"{name} not {kind}")

    return F.when(v.isNull(), F.array(F.lit("no JSON"))).otherwise(F.array_compact(F.array(*[error(n, k) for n, k in fields.items()])))


def ask(questions: DataFrame, chunks: DataFrame, history: DataFrame | None = None, k: int = 5, threshold: float = 0.1) -> DataFrame:
    """questions (query_id, question, query_vector) answered from chunks (id, file_path, language, content, vector): query_id, question, prompt within
    its budgets, answer (of the stand-in for a model), sources (ids by rank), suggestions. One path: search, prompt, answer."""
    hits = retrieval.nearest(chunks, questions, k, threshold).join(chunks.select("id", "file_path", "language", "content"), "id")
    first = hits.where("rank = 1").select("query_id", chat.extractive_answer().alias("answer"), chat.suggested_follow_ups().alias("suggestions"))
    sources = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("sources"))
    prompts = chat.rag_prompts(questions, hits, history)
    return questions.select("query_id", "question").join(prompts, "query_id").join(first, "query_id", "left").join(sources, "query_id", "left")
