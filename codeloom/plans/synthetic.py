"""Source files made of the documents table: every document is one file of a project of 48, with its whole text in comments.

The tables at hand hold no source code, so a file's code is a template chosen by the document's id and filled with ids; what operators must find
in it follows from the id alone, which the oracles state in SQL. Placeholders: {k} the id, {n} the next, {b} the one before, {u} and {d} the
nearest of the same kind below and above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.repositories import described

#: Files of a project, and kinds of files: a document's kind is its id modulo KINDS.
PROJECT, KINDS = 48, 16
#: Signs that code is made of; a text's are blanked, so that comments stay comments.
SIGNS = "<>(){}[]\"'`;@#=$&|/\\*-_!?%:+~^\r\0"

#: kind (the last two in three variants): path, language, first characters of a comment line, code.
TEMPLATES: dict[int, tuple[str, str, str, str]] = {
    0: ("src/routes/r{k}.js", "JavaScript", "// ", """import express from 'express';
import { s{n} } from '../services/s{n}';
const router = express.Router();
router.get('/items/{k}', list{k});
router.post('/items/{k}', list{k});
router.use('/base{k}', list{k});
export const list{k} = async (req, res) => {
  res.json(await s{n}(req));
};
"""),
    1: ("src/services/s{k}.js", "JavaScript", "// ", """import { M{n} } from '../models/m{n}';
import { gone } from './missing{k}';
const fs = require('fs');
export async function s{k}(data) {
  try {
    return M{n}.find({}).sort({ a: 1 });
  } catch (err) {
    throw new Error(err.message);
  }
}
function hidden{k}(a, b) {
  return process.env.KEY_{k};
}
"""),
    2: ("src/models/m{k}.js", "JavaScript", "// ", """import mongoose from 'mongoose';
const schema{k} = new mongoose.Schema({
  name: { type: String, required: true },
  owner: { type: mongoose.Schema.Types.ObjectId, ref: 'M{u}' },
  parts: [{ type: mongoose.Schema.Types.ObjectId, ref: 'm{d}' }],
});
export const M{k} = mongoose.model('M{k}', schema{k});
"""),
    3: ("src/cycle/a{k}.js", "JavaScript", "// ", """import { b{n} } from './b{n}';
export const a{k} = () => b{n}();
"""),
    4: ("src/cycle/b{k}.js", "JavaScript", "// ", """import { a{b} } from './a{b}';
import { b{k} as self } from './b{k}';
export const b{k} = () => a{b}() || self;
"""),
    5: ("client/C{k}.jsx", "JavaScript (React)", "// ", """import React, { useState, useEffect } from 'react';
export default function C{k}() {
  const [n, setN] = useState(0);
  useEffect(() => setN(1), []);
  return <Panel{k} value={n} />;
}
"""),
    6: ("svc/api{k}.py", "Python", "# ", """import os
from flask import Flask, jsonify
app = Flask(__name__)
class Store{k}(dict):
    def put(self, key, value):
        self[key] = value
@app.route('/things/{k}', methods=['GET', 'POST'])
def things{k}():
    return jsonify([])
@app.get('/ping{k}')
async def ping{k}(a):
    return os.getpid()
"""),
    7: ("svc/A{k}.java", "Java", "// ", """package demo;
import java.util.List;
import org.springframework.web.bind.annotation.RestController;
@RequestMapping("/api{k}")
public class A{k} extends Base{k} {
    @GetMapping("/books")
    public List<String> books(String author) {
        return List.of();
    }
}
"""),
    8: ("lib{k}.cpp", "C++", "// ", """#include <vector>
#include "lib{k}.hpp"
class Shape{k} : public Base{k} {
};
int area{k}(int w, int h) {
  return w * h;
}
"""),
    9: ("L{k}.cs", "C#", "// ", """using System.Linq;
public class L{k} : Base{k} {
    public async Task<int> Count{k}(int[] xs) {
        return xs.Length;
    }
}
"""),
    10: ("pkg/g{k}.go", "Go", "// ", """package main
import (
	"fmt"
)
type Server{k} struct{}
func (s *Server{k}) Run{k}(port int) {
	fmt.Println(port)
}
func main{k}() {
	fmt.Println(1)
}
"""),
    11: ("x{k}.php", "PHP", "// ", """<?php
use Demo;
class Page{k} extends Base{k} {
    public function show{k}($id) {
        return $id;
    }
}
function helper{k}($x) {
    return $x;
}
"""),
    12: ("style{k}.css", "CSS", "// ", """@media print {
  body { color: black; }
}
.card{k}, .tile {
  margin: 0;
}
/*
"""),
    13: ("page{k}.html", "HTML", "<!-- ", """<!doctype html>
<html><head><link href="style{b}.css"><script src="app{k}.js"></script></head>
<body><img src="a{k}.png"><p>hi</p></body></html>
"""),
    140: ("c{k}/package.json", "JSON", "", """{"name": "n{k}", "scripts": {"dev": "vite"}, "dependencies": {"express": "^4.0.0", "mongoose": "^8.0.0", "react": "^18.0.0", "react-dom": "^18.0.0", "jsonwebtoken": "^9.0.0"}, "devDependencies": {"vite": "^5.0.0"}, "description": \""""),
    141: ("c{k}/requirements.txt", "Unknown", "# ", """flask==3.0.0
pandas>=2
"""),
    142: ("c{k}/Dockerfile", "Dockerfile", "# ", """FROM node:20
WORKDIR /app
"""),
    150: ("e{k}/.env", "Environment", "# ", """PORT_{k}=3000
SECRET=abc
"""),
    151: ("src/middleware/auth{k}.js", "JavaScript", "// ", """import jwt from 'jsonwebtoken';
mongoose.connect('mongodb://localhost/shelf');
const client = new MongoClient(url);
const app = express();
app.listen(3000);
export function authenticate(req, res, next) {
  req.user = jwt.verify(req.token, process.env.SECRET);
  next();
}
export const sign{k} = (user) => jwt.sign(user, process.env.SECRET, { expiresIn: '15m' });
"""),
    152: ("e{k}/docker-compose.yml", "YAML", "# ", """services:
  web:
    image: node
  db:
    image: postgres:16
"""),
}
#: The first route file of a project is its entry.
ENTRY = "src/routes/index.js"


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a folder as a file table: project_id, file_path, content, n_bytes and what ``described`` adds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("text")).where("k is not null")
    r, group = F.col("k") % KINDS, F.floor(F.col("k") / KINDS) % 3
    kind = F.when(r < 14, r).otherwise(r * 10 + group)

    def pick(at: int):
        return F.element_at(F.create_map(*[x for c, t in TEMPLATES.items() for x in (F.lit(c).cast("long"), F.lit(t[at]))]), kind)

    def filled(x):
        for name, shift in (("k", 0), ("n", 1), ("b", -1), ("u", -KINDS), ("d", KINDS)):
            x = F.replace(x, F.lit(f"{{{name}}}"), (F.col("k") + shift).cast("string"))
        return x

    said = F.translate("text", SIGNS, " " * len(SIGNS))
    lines = F.concat(pick(2), F.replace(said, F.lit("\n"), F.concat(F.lit("\n"), pick(2))))
    closed = F.when(kind == 12, F.concat(lines, F.lit("\n*/"))).when(kind == 13, F.concat(F.replace(lines, F.lit("\n"), F.lit(" -->\n")), F.lit(" -->"))).when(kind == 140, F.concat(F.translate(said, "\n\t", "  "), F.lit('"}'))).otherwise(lines)
    path = F.when((r == 0) & (group == 0), ENTRY).otherwise(filled(pick(0)))
    made = docs.select(F.concat(F.lit("p"), F.floor(F.col("k") / PROJECT).cast("string")).alias("project_id"), path.alias("file_path"), F.concat(filled(pick(3)), closed).alias("content"))
    return described(made.withColumn("n_bytes", F.octet_length("content").cast("long")))


# -- the same in SQL, for oracles ------------------------------------------------------------------------------------

def literal(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str, name: str = "v") -> str:
    return f"(values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) {name}({columns})"


def filled_sql(x: str, k: str = "k") -> str:
    for name, shift in (("k", 0), ("n", 1), ("b", -1), ("u", -KINDS), ("d", KINDS)):
        x = f"replace({x}, '{{{name}}}', cast({k} + {shift} as varchar))"
    return x


_PATHS = [(c, t[0], t[1], len(t[3].split("\n")) - 1) for c, t in TEMPLATES.items()]
#: d: k, c (kind), project_id, file_path, language, code_lines (lines of the template), text_lines, text of every document.
D = f"""d as (
  select k, c, project_id, case when c = 0 and (k // {KINDS}) % 3 = 0 then '{ENTRY}' else {filled_sql('path')} end as file_path, language, n_lines, text
  from (select doc_id as k, coalesce(text, '') as text, 'p' || (doc_id // {PROJECT}) as project_id,
               case when doc_id % {KINDS} < 14 then doc_id % {KINDS} else (doc_id % {KINDS}) * 10 + (doc_id // {KINDS}) % 3 end as c from documents where doc_id is not null)
  join {values(_PATHS, 'c, path, language, n_lines', 't')} using (c))"""


def spec_sql(rows: list[tuple], columns: str, out: str, filled: tuple[str, ...] = (), where: str = "", name: str = "v") -> str:
    """Rows of every document by its kind: rows begin with the kind; ``filled`` columns have placeholders."""
    names = [x.strip() for x in columns.split(",")]
    own = ", ".join(f"{filled_sql(x)} as {x}" if x in filled else x for x in names)
    return f"select {out} from (select k, c, project_id, file_path, language, {own} from d join {values(rows, 'c, ' + columns, name)} using (c)) {where}"
