"""Structure of source files: tables of patterns by language, read over code without its comments, and scopes by brackets.

Every language is a list of (table, kind, pattern). A pattern's named groups are the fields of a row; its line comes from where it begins. One pass
over a file gives all of its rows; the tables are then views on them. Python sources go through the standard library's own parser first.

A match that begins inside a string is none. ``owner`` is the class that a method, field or nested class stands in, the component or function that a hook
or child element stands in; ``implements`` lists a class's interfaces. A file cut anywhere gives the rows of what is there.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import scopes
from codeloom.operators.chunking import split_depth0

ROWS = "table string, kind string, name string, line int, source string, specifiers array<string>, extends string, params array<string>, is_async boolean, exported boolean, detail string, owner string, implements array<string>"
FIELDS = [x.split()[0] for x in ROWS.split(", ")]
#: Files whose rows a task holds together.
TOGETHER = 200

_ID = r"[A-Za-z_$][\w$]*"
JAVASCRIPT = [
    ("symbol", "generator", rf"^[ \t]*(?P<export>export\s+(?:default\s+)?)?(?P<async>async\s+)?function\s*\*\s*(?P<name>{_ID})\s*\((?P<params>[^)]*)\)"),
    ("symbol", "function", rf"^[ \t]*(?P<export>export\s+(?:default\s+)?)?(?P<async>async\s+)?function\s*\*?\s*(?P<name>{_ID})\s*\((?P<params>[^)]*)\)"),
    ("symbol", "arrow_function", rf"^[ \t]*(?P<export>export\s+(?:default\s+)?)?(?:const|let|var)\s+(?P<name>{_ID})\s*=\s*(?P<async>async\s*)?(?:\((?P<params>[^)]*)\)|{_ID})\s*=>"),
    ("symbol", "class", rf"^[ \t]*(?P<export>export\s+(?:default\s+)?)?class\s+(?P<name>{_ID})(?:\s+extends\s+(?P<extends>[\w.$]+))?"),
    ("symbol", "method", rf"^[ \t]+(?P<async>async\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?P<name>{_ID})\s*\((?P<params>[^)]*)\)\s*\{{"),
    ("symbol", "interface", rf"^[ \t]*(?P<export>export\s+)?interface\s+(?P<name>{_ID})(?:\s+extends\s+(?P<extends>[\w.$]+))?"),
    ("symbol", "type", rf"^[ \t]*(?P<export>export\s+)?type\s+(?P<name>{_ID})\s*="),
    ("import", "import", rf"^[ \t]*import\s+(?:type\s+)?(?P<what>[^'\";]*?)\s*from\s*['\"](?P<source>[^'\"]+)['\"]"),
    ("import", "import", r"^[ \t]*import\s*['\"](?P<source>[^'\"]+)['\"]"),
    ("import", "require", rf"(?:(?:const|let|var)\s+(?P<what>\{{[^}}]*\}}|{_ID})\s*=\s*)?\brequire\s*\(\s*['\"](?P<source>[^'\"]+)['\"]\s*\)"),
    ("import", "dynamic", r"\bimport\s*\(\s*['\"](?P<source>[^'\"]+)['\"]\s*\)"),
    ("export", "named", rf"^[ \t]*export\s+(?:async\s+)?(?:function\s*\*?|class|const|let|var|interface|type)\s+(?P<name>{_ID})"),
    ("export", "default", rf"^[ \t]*export\s+default\s+(?:async\s+)?(?:function\s*|class\s+)?(?P<name>{_ID})?"),
    ("export", "commonjs", rf"\bmodule\.exports\s*=\s*(?P<name>{_ID})?"),
    ("hook", "hook", r"\b(?P<name>use[A-Z]\w*)\s*\("),
    ("child", "component", r"<(?P<name>[A-Z][\w.]*)\b"),
]
JAVA = [
    ("symbol", "class", r"^[ \t]*(?P<export>public\s+)?(?:(?:private|protected|abstract|final|static)\s+)*class\s+(?P<name>\w+)(?:\s+extends\s+(?P<extends>\w+))?"),
    ("symbol", "interface", r"^[ \t]*(?P<export>public\s+)?interface\s+(?P<name>\w+)(?:\s+extends\s+(?P<extends>\w+))?"),
    ("symbol", "method", r"^[ \t]*(?P<export>public\s+)?(?:(?:private|protected|static|abstract|final|synchronized)\s+)*(?!return\b|new\b|else\b)[\w<>\[\], ?]+\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:throws\s+[\w, .]+)?\s*\{"),
    ("import", "import", r"^[ \t]*import\s+(?:static\s+)?(?P<source>[\w.*]+)\s*;"),
    ("annotation", "annotation", r"^[ \t]*@(?P<name>\w+)(?:\s*\((?P<detail>[^)\n]*)\))?"),
    ("field", "field", r"^[ \t]+(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\], ?]+?\s+(?P<name>\w+)\s*(?:=[^;]*)?;"),
]
CPP = [
    ("symbol", "class", r"^[ \t]*(?:class|struct)\s+(?P<name>\w+)(?:\s*:\s*(?:public|protected|private)\s+(?P<extends>\w+))?\s*\{"),
    ("symbol", "function", r"^[ \t]*(?:(?:virtual|static|inline|const)\s+)*(?!return\b|else\b)[\w:<>*&]+\s+[*&]?(?:\w+::)?(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:const)?\s*(?:override)?\s*\{"),
    ("import", "include", r"^[ \t]*#include\s+[<\"](?P<source>[^>\"]+)[>\"]"),
]
CSHARP = [
    ("symbol", "class", r"^[ \t]*(?P<export>public\s+)?(?:(?:private|protected|internal|abstract|sealed|static|partial)\s+)*(?:class|struct)\s+(?P<name>\w+)(?:\s*:\s*(?P<extends>\w+))?"),
    ("symbol", "interface", r"^[ \t]*(?P<export>public\s+)?interface\s+(?P<name>\w+)"),
    ("symbol", "method", r"^[ \t]*(?P<export>public\s+)(?:(?:static|virtual|override)\s+)*(?P<async>async\s+)?[\w<>\[\]?]+\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)"),
    ("import", "using", r"^[ \t]*using\s+(?P<source>[\w.]+)\s*;"),
]
GO = [
    ("symbol", "method", r"^func\s+\(\s*\w+\s+\*?(?P<extends>\w+)\s*\)\s*(?P<name>\w+)\s*\((?P<params>[^)]*)\)"),
    ("symbol", "function", r"^func\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)"),
    ("symbol", "class", r"^type\s+(?P<name>\w+)\s+struct\b"),
    ("symbol", "interface", r"^type\s+(?P<name>\w+)\s+interface\b"),
    ("import", "import", r"^(?:import\s+|[ \t]+)(?:\w+\s+)?\"(?P<source>[^\"]+)\"\s*$"),
]
PHP = [
    ("symbol", "class", r"^[ \t]*(?:(?:abstract|final)\s+)*class\s+(?P<name>\w+)(?:\s+extends\s+(?P<extends>[\w\\]+))?"),
    ("symbol", "interface", r"^[ \t]*interface\s+(?P<name>\w+)"),
    ("symbol", "trait", r"^[ \t]*trait\s+(?P<name>\w+)"),
    ("symbol", "method", r"^[ \t]*(?:public|private|protected)\s+(?:static\s+)?function\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)"),
    ("symbol", "function", r"^function\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)"),
    ("import", "use", r"^[ \t]*use\s+(?P<source>[\w\\]+)"),
    ("namespace", "namespace", r"^[ \t]*namespace\s+(?P<name>[\w\\]+)"),
]
PYTHON = [
    ("symbol", "function", r"^[ \t]*(?P<async>async\s+)?def\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)"),
    ("symbol", "class", r"^[ \t]*class\s+(?P<name>\w+)\s*(?:\((?P<extends>[^)]*)\))?\s*:"),
    ("import", "from_import", r"^[ \t]*from\s+(?P<source>\S+)\s+import\s+(?P<what>.+)"),
    ("import", "import", r"^[ \t]*import\s+(?P<source>[\w.]+)"),
]
HTML = [
    ("tag", "tag", r"<(?P<name>[a-zA-Z][\w-]*)"),
    ("import", "asset", r"<(?:script|link|img)\b[^>]*?\b(?:src|href)\s*=\s*[\"'](?P<source>[^\"']+)[\"']"),
]
CSS = [
    ("at_rule", "at_rule", r"^[ \t]*@(?P<name>[\w-]+)[^{;]*"),
    ("selector", "selector", r"^[ \t]*(?P<name>[^@{}\s/][^{}]*?)\s*\{"),
    ("declaration", "declaration", r"(?:^|[{;])[ \t]*(?P<name>[\w-]+)\s*:\s*(?P<detail>[^;{}]+)(?=[;}])"),
]
TABLES = {"javascript": JAVASCRIPT, "typescript": JAVASCRIPT, "python": PYTHON, "java": JAVA, "c++": CPP, "c#": CSHARP, "go": GO, "php": PHP, "html": HTML, "css": CSS}
_COMPILED: dict[str, list] = {}


def patterns(language: str | None) -> list:
    lang = (language or "").lower()
    key = lang if lang in TABLES else next((k for k in ("javascript", "typescript") if k in lang), "c++" if lang in ("c", "c/c++ header") else None)
    if key is None:
        return []
    if key not in _COMPILED:
        _COMPILED[key] = [(t, k, re.compile(p, re.MULTILINE | re.ASCII)) for t, k, p in TABLES[key]]
    return _COMPILED[key]


def family(language: str | None) -> str | None:
    """The lexer of a language; none where text is read as it is."""
    lang = (language or "").lower()
    return lang if lang in scopes.FAMILIES else "javascript" if "javascript" in lang or "typescript" in lang else "c++" if lang in ("c", "c/c++ header") else None


def specifiers(what: str | None) -> list[str]:
    """Names that an import clause binds: default, namespace, named (as they are called in their module)."""
    if not what:
        return []
    out = []
    for part in split_depth0(what.replace("(", "").replace(")", "")):
        inner = part.strip("{} \n")
        out += [x.split(" as ")[0].strip() if part.startswith("{") else x.replace("* as ", "").strip() for x in inner.split(",")] if part.startswith("{") else [part.replace("* as ", "").strip()]
    return [x for x in out if x]


#: Calls that set up a web framework.
FRAMEWORKS = ("Flask", "FastAPI", "Django")


def python_rows(content: str) -> list[tuple]:
    """Rows from Python's own parser; raises SyntaxError where it cannot read the source."""
    tree, out = ast.parse(content), []
    inside = {id(f): c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body}
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            args = [a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]]
            out += [("decorator", "decorator", ast.unparse(d.func if isinstance(d, ast.Call) else d), d.lineno, None, None, None, None, None, None, ", ".join(map(ast.unparse, d.args)) if isinstance(d, ast.Call) else None, inside.get(id(node)), None) for d in node.decorator_list]
            out.append(("symbol", "method" if id(node) in inside else "function", node.name, node.lineno, None, None, inside.get(id(node)), args, isinstance(node, ast.AsyncFunctionDef), not node.name.startswith("_"), None, inside.get(id(node)), None))
        elif isinstance(node, ast.ClassDef):
            out.append(("symbol", "class", node.name, node.lineno, None, None, ", ".join(map(ast.unparse, node.bases)) or None, None, False, not node.name.startswith("_"), None, inside.get(id(node)), None))
            out += [("field", "field", t.id, f.lineno, None, None, node.name, None, None, None, None, node.name, None) for f in node.body for t in (f.targets if isinstance(f, ast.Assign) else [f.target] if isinstance(f, ast.AnnAssign) else []) if isinstance(t, ast.Name)]
        elif isinstance(node, ast.ImportFrom):
            out.append(("import", "from_import", None, node.lineno, "." * node.level + (node.module or ""), [a.name for a in node.names], *[None] * 7))
        elif isinstance(node, ast.Import):
            out += [("import", "import", None, node.lineno, a.name, [a.name], *[None] * 7) for a in node.names]
        elif isinstance(node, ast.Call) and (name := ast.unparse(node.func)) in FRAMEWORKS:
            out.append(("framework", "web_framework", name, node.lineno, *[None] * 9))
    return sorted(out, key=lambda r: r[3])


def parameters(text: str | None, language: str | None) -> list[str] | None:
    """Names of a parameter list; an empty list is None but in languages that put the type first."""
    if text is not None and language in ("Java", "C++", "C#", "C"):
        return [x.split()[-1].lstrip("*&") for x in split_depth0(text)]
    return [re.split(r"[\s:=]", x.strip())[0] for x in split_depth0(text)] if text else None


def owned(rows: list[tuple], code: str, bare: str, kin: str, language: str | None, line_of) -> list[tuple]:
    """Rows (place first) with owner and implements, and the members of classes that the patterns by line did not see."""
    closes = scopes.pairs(bare)
    bodies, classes, named = {}, [], []
    for place, table, kind, name, *_ in rows:
        if table != "symbol" or not name or kin == "python" or kind == "type":
            continue
        body = scopes.extent(bare, place[1] - (bare[place[1] - 1:place[1]] == "{"), closes, arrow=kind == "arrow_function")
        if body:
            bodies[place] = body
            (classes if kind in ("class", "interface", "trait") else named).append((*body, name))
    in_class, in_function = scopes.Owners(classes), scopes.Owners(named)
    out, known = [], {(r[4], r[3]) for r in rows if r[1] in ("symbol", "field")}
    for place, table, kind, name, line, source, spec, extends, *rest in rows:
        owner = implements = None
        if table in ("hook", "child"):
            owner = in_function.of(place[0])
        elif kin == "go" and kind == "method":
            owner = extends
        elif table == "field" or table == "symbol" and kind in ("method", "class", "function" if kin == "c++" else "class"):
            owner = in_class.of(place[0])
        if table == "symbol" and kind in ("class", "interface") and place in bodies:
            head = re.search(r"\bimplements\s+([\w\s,.<>$\\]+)", bare[place[0]:bodies[place][0]])
            implements = split_depth0(head[1]) if head else None
        out.append((place[0], (table, kind, name, line, source, spec, extends, *rest, owner, implements)))
    for start, end, name in classes if kin in scopes.MEMBERS else []:
        inside, methods = scopes.hollow(bare, start, closes), []
        method, field = scopes.MEMBERS[kin]
        for m in method.finditer(inside):
            line, own, at = line_of(start + 1 + m.start("name")), m["name"], start + 1 + m.start("at")
            if (line, own) not in known and own not in NO_METHODS:
                mods = m["mods"].split()
                methods.append((start + 1 + m.start(), ("symbol", "function" if kin == "c++" else "method", own, line, None, None, None, parameters(code[at + 1:closes[at]], language), "async" in mods, "public" in mods, None, name, None)))
                known.add((line, own))
        for m in field.finditer(inside):
            line, own = line_of(start + 1 + m.start("name")), m["name"]
            if (line, own) not in known and own not in NO_METHODS:
                value = re.match(r"[^;\n]*", code[start + 1 + m.end():])[0].strip()[:50] if m["end"] == "=" else None
                methods.append((start + 1 + m.start(), ("field", "field", own, line, None, None, None, None, None, None, value, name, None)))
                known.add((line, own))
        out += methods
    return [r for _, r in sorted(out, key=lambda x: x[0])] if len(out) > len(rows) else [r for _, r in out]


#: Words before a parenthesis or a line's end that name no member.
NO_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "else", "do", "try", "get", "set", "static", "async"}


def parse(content: str | None, language: str | None, path: str = "") -> list[tuple]:
    """Rows of ROWS for one file; a file of a known language without any row gives an error row."""
    if not content:
        return []
    known = patterns(language)
    if language == "Python":
        try:
            return python_rows(content)
        except (SyntaxError, ValueError):
            pass
    kin = family(language)
    code, bare = scopes.layers(content, kin) if kin else (content, content)
    breaks, rows, seen = [m.start() for m in re.finditer("\n", content)], [], set()
    from bisect import bisect_left

    for table, kind, pattern in known:
        for m in pattern.finditer(code):
            g = m.groupdict()
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if bare[start:start + 1] == scopes.HOLE:
                continue
            line = bisect_left(breaks, start) + 1
            name = g.get("name")
            if table == "symbol":
                if (line, name) in seen:
                    continue
                seen.add((line, name))
            params = parameters(g.get("params"), language)
            rows.append(((start, m.end()), table, kind, name, line, g.get("source"), specifiers(g.get("what")) if table == "import" else None, g.get("extends"), params, bool(g.get("async")) if table == "symbol" else None, bool(g.get("export")) if table == "symbol" else None, g.get("detail")))
    rows = owned(rows, code, bare, kin, language, lambda at: bisect_left(breaks, at) + 1) if kin else [(*r[1:], None, None) for r in rows]
    if known in (None, []):
        return []
    exports = {r[2] for r in rows if r[0] == "export" and r[2]}
    listed = {x.strip().split(":")[0].strip() for m in re.finditer(r"(?:module\.exports\s*=|export)\s*\{([^}]*)\}", code) for x in m[1].split(",")}
    jsx = (language or "").endswith("(React)")
    made = []
    for r in rows:
        if r[0] == "symbol":
            r = (*r[:9], bool(r[9] or (r[2] in exports or r[2] in listed) and r[1] != "method"), *r[10:])
            if jsx and r[1] in ("function", "arrow_function") and r[2][:1].isupper():
                made.append((r[0], "component", *r[2:]))
        made.append(r)
    if not any(r[0] in ("symbol", "import", "tag", "selector") for r in made):
        made.append(("error", "warning", None, 1, None, None, None, None, None, None, f"nothing found in a file of {language}", None, None))
    return made


def parsed_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of all files, given back after every ``TOGETHER`` files: a file gives many rows, so a worker holds those of few."""
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            rows = [(p, f, lang, *r) for p, f, lang, s in batch.iloc[at:at + TOGETHER].itertuples(index=False) for r in parse(s, lang, f)]
            yield pd.DataFrame(rows, columns=["project_id", "file_path", "language", *FIELDS]).astype({"line": "int32"})


def parse_files(files: DataFrame) -> DataFrame:
    """files (project_id, file_path, language, content): rows of ROWS with their file. One pass, no shuffle."""
    kind = files.schema["project_id"].dataType.simpleString()
    return files.select("project_id", "file_path", "language", "content").mapInPandas(parsed_batches, f"project_id {kind}, file_path string, language string, {ROWS}")


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.where("table = 'symbol'").select("project_id", "file_path", "language", "name", "kind", "line", "extends", "params", "is_async", "exported", "owner", "implements")


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.where("table = 'import'").select("project_id", F.col("file_path").alias("from_file"), "language", "source", "kind", "specifiers", "line")


def rollup(parsed: DataFrame) -> DataFrame:
    """Per project the distinct hooks, components, tags, selectors, at-rules and namespaces."""
    names = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("name"))))
    table = F.col("table")
    return parsed.groupBy("project_id").agg(names(table == "hook").alias("hooks"), names((table == "symbol") & (F.col("kind") == "component")).alias("components"), names(table == "tag").alias("tags"),
                                            names(table == "selector").alias("selectors"), names(table == "at_rule").alias("at_rules"), names(table == "namespace").alias("namespaces"))


# -- configuration files ---------------------------------------------------------------------------------------------

#: Configuration types by lower-case file name.
CONFIG_NAMES = {
    "package.json": "package.json", "tsconfig.json": "tsconfig.json", "requirements.txt": "requirements.txt", "pom.xml": "pom.xml", "build.gradle": "build.gradle", "build.gradle.kts": "build.gradle",
    "cargo.toml": "Cargo.toml", "go.mod": "go.mod", "gemfile": "Gemfile", "composer.json": "composer.json", "dockerfile": "Dockerfile", "docker-compose.yml": "docker-compose.yml",
    "docker-compose.yaml": "docker-compose.yml", "pyproject.toml": "pyproject.toml", "makefile": "Makefile", ".eslintrc.js": "eslint", ".eslintrc.json": "eslint", ".eslintrc.yml": "eslint",
    ".prettierrc": "prettier", ".prettierrc.json": "prettier", "prettier.config.js": "prettier",
}


def config_type(path: str = "file_path"):
    base = F.lower(X.basename(path))
    known = F.create_map(*[F.lit(x) for kv in CONFIG_NAMES.items() for x in kv])
    return F.when(base.startswith(".env"), ".env").otherwise(F.try_element_at(known, base))


def configs(files: DataFrame) -> DataFrame:
    """project_id, file_path, file_type, dependencies and dev_dependencies (maps), scripts, base_image, keys, parse_error, raw."""
    own = files.withColumn("file_type", config_type()).where("file_type is not null")
    c = F.col("content")
    js = F.from_json(c, "struct<name:string,version:string,dependencies:map<string,string>,devDependencies:map<string,string>,scripts:map<string,string>,require:map<string,string>>", {"mode": "PERMISSIVE"})
    is_json = F.col("file_type").isin("package.json", "composer.json", "tsconfig.json")
    to_map = lambda names: F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n, F.lit(""))))
    all_of = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    listed = (F.when(F.col("file_type") == "requirements.txt", all_of(r"(?m)^[ \t]*([A-Za-z0-9][\w.\-]*)(?=[ \t]*(?:[=<>!~\[;#]|$))"))
              .when(F.col("file_type") == "go.mod", all_of(r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/[\w.\-/]+)\s+v"))
              .when(F.col("file_type") == "Gemfile", all_of(r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"]"))
              .when(F.col("file_type") == "pom.xml", all_of(r"<artifactId>([^<]+)</artifactId>")))
    keys = (F.when(F.col("file_type") == ".env", all_of(r"(?m)^[ \t]*([^#=\s][^=\n]*?)[ \t]*=")).when(F.col("file_type") == "Makefile", all_of(r"(?m)^([\w.\-]+)\s*:(?!=)"))
            .when(F.col("file_type") == "docker-compose.yml", all_of(r"(?m)^  ([\w\-]+):\s*$")))
    return own.withColumn("j_", F.when(is_json, js)).select(
        "project_id", "file_path", "file_type", F.when(is_json, F.coalesce("j_.dependencies", "j_.require")).otherwise(F.when(listed.isNotNull(), to_map(listed))).alias("dependencies"), F.col("j_.devDependencies").alias("dev_dependencies"),
        F.col("j_.scripts").alias("scripts"), F.when(F.col("file_type") == "Dockerfile", F.regexp_extract(c, r"(?mi)^FROM\s+(\S+)", 1)).alias("base_image"), keys.alias("keys"),
        F.when(is_json & F.try_parse_json(c).isNull(), "invalid JSON").alias("parse_error"), c.alias("raw"))
