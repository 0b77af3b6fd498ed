"""A small repository of our own that shows every structure the operators read. Two projects: the whole, and a fragment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.repositories import described, ignored_path, is_binary_name

FILES = {
    "package.json": '{"name": "shelf", "version": "1.0.0", "scripts": {"dev": "vite"}, "dependencies": {"express": "^4.19.0", "mongoose": "^8.0.0", "react": "^18.0.0", "react-dom": "^18.0.0", "jsonwebtoken": "^9.0.0", "bcryptjs": "^2.4.0"}, "devDependencies": {"vite": "^5.0.0"}}\n',
    "requirements.txt": "# service\nflask==3.0.0\npandas>=2\npytest\n",
    "Dockerfile": "FROM node:20\nWORKDIR /app\nCOPY . .\nCMD [\"node\", \"src/app.js\"]\n",
    "docker-compose.yml": "services:\n  web:\n    build: .\n  mongo:\n    image: mongo:7\n",
    "go.mod": "module example.org/shelf\n\ngo 1.22\n\nrequire github.com/gorilla/mux v1.8.1\n",
    "Gemfile": "source 'https://rubygems.org'\ngem 'rake'\n",
    "Makefile": "all: build\n\nbuild:\n\techo built\n",
    ".env": "# secrets\nPORT=3000\nJWT_SECRET=abc\n",
    ".github/workflows/ci.yml": "on: push\njobs:\n  test:\n    runs-on: ubuntu-latest\n",
    "src/app.js": "import express from 'express';\nimport { router } from './routes/user.routes';\nconst { connect } = require('mongoose');\n\nconst app = express();\napp.use(express.json());\napp.use('/users', router);\napp.get('/health', (req, res) => res.json({ ok: true }));\n\nexport async function start(port) {\n  try {\n    await connect(process.env.MONGO_URL);\n    app.listen(port);\n  } catch (err) {\n    throw new Error(err.message);\n  }\n}\n",
    "src/routes/user.routes.js": "import { Router } from 'express';\nimport { list, create } from '../controllers/user.controller';\nimport { authenticate } from '../middleware/auth';\n\nexport const router = Router();\nrouter.get('/', list);\nrouter.post('/', authenticate, create);\nrouter.delete('/:id', authenticate, list);\n",
    "src/controllers/user.controller.js": "import { findUsers, addUser } from '../services/user.service';\n\nexport const list = async (req, res) => {\n  const users = await findUsers();\n  res.json(users);\n};\n\nexport async function create(req, res, next) {\n  try {\n    res.status(201).json(await addUser(req.body));\n  } catch (err) {\n    next(err);\n  }\n}\n",
    "src/services/user.service.js": "import User from '../models/User';\nimport bcrypt from 'bcryptjs';\n\nexport async function findUsers() {\n  return User.find({}).sort({ name: 1 }).limit(10);\n}\n\nexport async function addUser(data) {\n  const hash = await bcrypt.hash(data.password, 12);\n  return User.create({ ...data, hash });\n}\n",
    "src/models/User.js": "import mongoose from 'mongoose';\n\nconst postSchema = new mongoose.Schema({\n  title: { type: String, required: true },\n  author: { type: mongoose.Schema.Types.ObjectId, ref: 'User' },\n});\n\nconst userSchema = new mongoose.Schema({\n  name: { type: String, required: true },\n  email: { type: String, unique: true },\n  posts: [{ type: mongoose.Schema.Types.ObjectId, ref: 'Post' }],\n}, { timestamps: true });\n\nexport const Post = mongoose.model('Post', postSchema);\nexport default mongoose.model('User', userSchema);\n",
    "src/middleware/auth.js": "import jwt from 'jsonwebtoken';\n\n/* checks\n   the token */\nexport function authenticate(req, res, next) {\n  const token = req.headers.authorization;\n  req.user = jwt.verify(token, process.env.JWT_SECRET);\n  next();\n}\n\nexport const sign = (user) => jwt.sign(user, process.env.JWT_SECRET, { expiresIn: '15m' });\n",
    "src/cycle/a.js": "import { b } from './b';\nexport const a = () => b();\n",
    "src/cycle/b.js": "import { c } from './c';\nexport const b = () => c();\n",
    "src/cycle/c.js": "import { a } from './a';\nimport { c as self } from './c';\nexport const c = () => a() || self;\n",
    "src/dup.js": "export const dup = 1;\n",
    "src/dup/index.js": "import { use } from '../x';\n\nexport function other() {\n  return use();\n}\n",
    "src/x.js": "import { dup } from './dup';\nimport { gone } from './missing';\nimport fs from 'fs';\nimport lodash from 'lodash/fp';\nimport thing from '@scope/pkg/x';\nexport const use = () => dup + lodash(thing);\n",
    "client/App.jsx": "import React, { useState, useEffect } from 'react';\nimport { useThing } from './hooks/useThing';\n\nexport default function App() {\n  const [n, setN] = useState(0);\n  useEffect(() => setN(useThing()), []);\n  return <Panel value={n} />;\n}\n",
    "client/hooks/useThing.js": "export function useThing() {\n  return 42;\n}\n",
    "svc/api.py": "import os\nfrom flask import Flask, jsonify\n\napp = Flask(__name__)\n\n\nclass Store(dict):\n    def put(self, key, value):\n        self[key] = value\n\n\n@app.route('/items', methods=['GET', 'POST'])\ndef items():\n    return jsonify([])\n\n\n@app.get('/ping')\nasync def ping():\n    return os.getpid()\n",
    "Api.java": "package demo;\n\nimport java.util.List;\nimport org.springframework.web.bind.annotation.*;\n\n@RequestMapping(\"/api\")\npublic class Api extends Base {\n    @GetMapping(\"/books\")\n    public List<String> books(String author) {\n        return List.of();\n    }\n}\n",
    "lib.cpp": "#include <vector>\n#include \"lib.hpp\"\n\nclass Shape : public Base {\n};\n\nint area(int w, int h) {\n  return w * h;\n}\n",
    "Lib.cs": "using System.Linq;\n\npublic class Lib : Base {\n    public async Task<int> Count(int[] xs) {\n        return xs.Length;\n    }\n}\n",
    "main.go": "package main\n\nimport (\n\t\"fmt\"\n)\n\ntype Server struct{}\n\nfunc (s *Server) Run(port int) {\n\tfmt.Println(port)\n}\n\nfunc main() {\n\t(&Server{}).Run(80)\n}\n",
    "x.php": "<?php\nnamespace Demo;\n\nuse Demo\\Base;\n\nclass Page extends Base {\n    public function show($id) {\n        return $id;\n    }\n}\n\nfunction helper($x) {\n    return $x;\n}\n",
    "index.html": "<!doctype html>\n<html><head><link href=\"style.css\"><script src=\"app.js\"></script></head>\n<body><img src=\"a.png\"><p>hi</p></body></html>\n",
    "style.css": "@media print {\n  body { color: black; }\n}\n.card, .tile {\n  margin: 0;\n  padding: 1px;\n}\n",
    "node_modules/x/i.js": "module.exports = 1;\n",
    "a.min.js": "var a=1;\n",
    "logo.png": "not really\n",
    "nul.txt": "a\0b",
}
FRAGMENT = {"package.json": '{"name": "tiny", "dependencies": {"express": "4"}}\n', "netlify.toml": "[build]\n", "src/one.ts": "export type Id = string;\nexport const one = (x: Id) => x;\n"}


def sample_files(spark: SparkSession) -> DataFrame:
    """The sample as a file table, ignored and binary files left out as the sources do."""
    rows = [(p, f, s, len(s.encode())) for p, files in (("shelf", FILES), ("tiny", FRAGMENT)) for f, s in files.items()]
    raw = spark.createDataFrame(rows, "project_id string, file_path string, content string, n_bytes long")
    return described(raw.where(~ignored_path("file_path") & ~is_binary_name("file_path") & (F.instr("content", "\0") == 0)))
