"""Queries over nested source files made of the documents table: a file's text stands unchanged in its comments and as a string of its code.

Every document is one file; its id chooses one of eight variants with classes in classes, braces and definitions in strings and comments, or an end
missing. What the walkers must find follows from the variant, which the oracle lists; {k} is the id, {said} the document's text as a string literal.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import parsers
from codeloom.plans.registry import query
from codeloom.plans.synthetic import PROJECT, filled_sql, values
from codeloom.sources.repositories import described

#: variant: path, first characters of a comment line, code.
VARIANTS: dict[int, tuple[str, str, str]] = {
    0: ("web/Box{k}.jsx", "// ", """import React, { useState } from 'react';
const said = "{said}";
/* class Ghost{k} { haunt() { return "}"; }
   export function spook() {} */
export class Box{k} extends Base{k} {
  size = 1;
  static kinds = ['{', '}'];
  #hidden;
  open(a, b) { if (a) { return `}{${b}`; } }
  async shut() { return "class Fake { no() {} }"; }
}
export default function Panel{k}() {
  const [n, setN] = useState("}");
  useEffect(() => { setN(1); }, []);
  return <Row{k} a={n}><Cell{k} /></Row{k}>;
}
const Tiny{k} = () => <Dot{k} />;
"""),
    1: ("java/Outer{k}.java", "// ", """package a;
/* public class Ghost{k} { void haunt() { } } */
public class Outer{k} extends Base{k} implements Runnable, Map<K, V> {
    private String said = "{said}";
    public void run{k}(int a) { if (a > 0) { go("}"); } }
    static class Inner{k} implements Shape {
        private int depth = 2;
        void deep(int x, String y) { char c = '{'; }
    }
    public int last() { return 1; }
}
"""),
    2: ("cpp/box{k}.cpp", "// ", """#include <vector>
// class Ghost { void haunt() {} };
class Box{k} : public Base{k} {
public:
  int size;
  const char* said = "{said}";
  int area(int w) const { return w; }
  virtual void open() = 0;
  struct Part{k} {
    int weight;
  };
};
int main{k}(int argc) { return 0; }
"""),
    3: ("py/store{k}.py", "# ", """from flask import Flask
app = Flask(__name__)
SAID = "{said}"
TEXT = '''
class Ghost: pass
def haunt(): pass
'''
class Outer{k}(Base{k}):
    size = 1
    class Inner{k}:
        depth: int = 2
        async def deep(self, x):
            return "def no(): {"
    def shut(self):
        return app
"""),
    4: ("web/cut{k}.js", "// ", """const said = "{said}";
export class Cut{k} {
  size = 1;
  open(a) {
    if (a) { return [(
"""),
    5: ("cs/L{k}.cs", "// ", """using System;
public class L{k} : Base{k} {
    // public class Ghost { public int Haunt() { return 1; } }
    public string Said() { return "{said}"; }
    public class Part{k} {
        public async Task<int> Deep(int x) { return '}'; }
    }
}
"""),
    6: ("go/g{k}.go", "// ", """package main
var said = "{said}"
var raw = `
type Ghost struct {
func haunt() {
`
type Server{k} struct {
	port int
}
func (s *Server{k}) Run(port int) {
	call("}")
}
func main{k}() {
}
"""),
    7: ("php/p{k}.php", "// ", """<?php
# class Ghost { public function haunt() {} }
class Page{k} extends Base{k} implements Shape, Row {
    public function said($x) { return "{said}"; }
}
function helper{k}($y) {
    return '}';
}
"""),
}
#: variant, table, kind, name, line, owner, interfaces, extends, parameters.
FOUND = [
    (0, "symbol", "class", "Box{k}", 5, None, None, "Base{k}", None), (0, "field", "field", "size", 6, "Box{k}", None, None, None), (0, "field", "field", "kinds", 7, "Box{k}", None, None, None), (0, "field", "field", "#hidden", 8, "Box{k}", None, None, None),
    (0, "symbol", "method", "open", 9, "Box{k}", None, None, "a,b"), (0, "symbol", "method", "shut", 10, "Box{k}", None, None, None), (0, "symbol", "component", "Panel{k}", 12, None, None, None, None), (0, "symbol", "function", "Panel{k}", 12, None, None, None, None),
    (0, "hook", "hook", "useState", 13, "Panel{k}", None, None, None), (0, "hook", "hook", "useEffect", 14, "Panel{k}", None, None, None), (0, "child", "component", "Row{k}", 15, "Panel{k}", None, None, None), (0, "child", "component", "Cell{k}", 15, "Panel{k}", None, None, None),
    (0, "symbol", "component", "Tiny{k}", 17, None, None, None, None), (0, "symbol", "arrow_function", "Tiny{k}", 17, None, None, None, None), (0, "child", "component", "Dot{k}", 17, "Tiny{k}", None, None, None),
    (1, "symbol", "class", "Outer{k}", 3, None, "Runnable;Map<K, V>", "Base{k}", None), (1, "field", "field", "said", 4, "Outer{k}", None, None, None), (1, "symbol", "method", "run{k}", 5, "Outer{k}", None, None, "a"),
    (1, "symbol", "class", "Inner{k}", 6, "Outer{k}", "Shape", None, None), (1, "field", "field", "depth", 7, "Inner{k}", None, None, None), (1, "symbol", "method", "deep", 8, "Inner{k}", None, None, "x,y"), (1, "symbol", "method", "last", 10, "Outer{k}", None, None, None),
    (2, "symbol", "class", "Box{k}", 3, None, None, "Base{k}", None), (2, "field", "field", "size", 5, "Box{k}", None, None, None), (2, "field", "field", "said", 6, "Box{k}", None, None, None), (2, "symbol", "function", "area", 7, "Box{k}", None, None, "w"),
    (2, "symbol", "function", "open", 8, "Box{k}", None, None, None), (2, "symbol", "class", "Part{k}", 9, "Box{k}", None, None, None), (2, "field", "field", "weight", 10, "Part{k}", None, None, None), (2, "symbol", "function", "main{k}", 13, None, None, None, "argc"),
    (3, "framework", "web_framework", "Flask", 2, None, None, None, None), (3, "symbol", "class", "Outer{k}", 8, None, None, "Base{k}", None), (3, "field", "field", "size", 9, "Outer{k}", None, "Outer{k}", None), (3, "symbol", "class", "Inner{k}", 10, "Outer{k}", None, None, None),
    (3, "field", "field", "depth", 11, "Inner{k}", None, "Inner{k}", None), (3, "symbol", "method", "deep", 12, "Inner{k}", None, "Inner{k}", "self,x"), (3, "symbol", "method", "shut", 14, "Outer{k}", None, "Outer{k}", "self"),
    (4, "symbol", "class", "Cut{k}", 2, None, None, None, None), (4, "field", "field", "size", 3, "Cut{k}", None, None, None), (4, "symbol", "method", "open", 4, "Cut{k}", None, None, "a"),
    (5, "symbol", "class", "L{k}", 2, None, None, "Base{k}", None), (5, "symbol", "method", "Said", 4, "L{k}", None, None, None), (5, "symbol", "class", "Part{k}", 5, "L{k}", None, None, None), (5, "symbol", "method", "Deep", 6, "Part{k}", None, None, "x"),
    (6, "symbol", "class", "Server{k}", 7, None, None, None, None), (6, "symbol", "method", "Run", 10, "Server{k}", None, "Server{k}", "port"), (6, "symbol", "function", "main{k}", 13, None, None, None, None),
    (7, "symbol", "class", "Page{k}", 3, None, "Shape;Row", "Base{k}", None), (7, "symbol", "method", "said", 4, "Page{k}", None, None, "$x"), (7, "symbol", "function", "helper{k}", 6, None, None, None, "$y"),
]
_COLUMNS = "tbl, kind, name, line, owner, interfaces, extends, params"


def nested_files(spark, sf_dir):
    """One file a document: its variant's code, with the text as a string, then the text in comments."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("text")).where("k is not null")
    pick = lambda at: F.element_at(F.create_map(*[x for c, v in VARIANTS.items() for x in (F.lit(c).cast("long"), F.lit(v[at]))]), F.pmod("k", F.lit(len(VARIANTS))))
    said = F.col("text")
    for sign, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\0", "\\x00")):
        said = F.replace(said, F.lit(sign), F.lit(escaped))
    number = F.col("k").cast("string")
    content = F.concat(F.replace(F.replace(pick(2), F.lit("{k}"), number), F.lit("{said}"), said), pick(1), F.replace(F.translate("text", "\0\r\f", "   "), F.lit("\n"), F.concat(F.lit("\n"), pick(1))), F.lit("\n"))
    files = docs.select(F.concat(F.lit("n"), F.floor(F.col("k") / PROJECT).cast("string")).alias("project_id"), F.replace(pick(0), F.lit("{k}"), number).alias("file_path"), content.alias("content"))
    return described(files.withColumn("n_bytes", F.octet_length("content").cast("long")))


_FILLED = ", ".join(f"{filled_sql(x)} as {x}" if x in ("name", "owner", "extends") else x for x in _COLUMNS.split(", "))


@query("nested_scopes", f"""select project_id, replace(path, '{{k}}', cast(k as varchar)) as file_path, {_FILLED.replace("tbl", 'tbl as "table"', 1)}
 from (select doc_id as k, doc_id % {len(VARIANTS)} as c, 'n' || (doc_id // {PROJECT}) as project_id from documents where doc_id is not null)
 join {values([(c, v[0]) for c, v in VARIANTS.items()], 'c, path', 'p')} using (c) join {values(FOUND, 'c, ' + _COLUMNS, 'v')} using (c)""")
def nested_scopes(spark, sf_dir):
    """Definitions, members, hooks and children of nested, commented, quoted and cut files, with what they belong to."""
    parsed = parsers.parse_files(nested_files(spark, sf_dir)).where("table in ('symbol', 'field', 'hook', 'child', 'framework')")
    return parsed.select("project_id", "file_path", "table", "kind", "name", "line", "owner", F.array_join("implements", ";").alias("interfaces"), "extends", F.nullif(F.array_join("params", ","), F.lit("")).alias("params"))
