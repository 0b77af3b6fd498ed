"""Technology rules and stacks. A table is a parameter of detection; these are the defaults."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """A technology: signals are (type, value, weight, configuration file of a dependency, whether its name is meant whole)."""

    name: str
    category: str
    signals: tuple
    parent: str | None = None
    excludes: str | None = None


def sig(kind: str, weight: float, *values: str) -> tuple:
    """Signals of one type and weight."""
    return tuple((kind, v, weight, None, True) for v in values)


# Rules in the order of their evaluation, with their signals in order.
RULES = (
    Rule("React", "frontend", (
        ("dep", "react", 1.0, "package.json", True),
        ("dep", "react-dom", 0.9, "package.json", True),
        ("import", "from 'react'", 0.85, None, True),
        ("import", 'from "react"', 0.85, None, True),
        ("extension", ".jsx", 0.4, None, True),
        ("extension", ".tsx", 0.4, None, True),
        ("pattern", "useState", 0.5, None, True),
        ("pattern", "useEffect", 0.5, None, True),
    )),
    Rule("Next.js", "frontend", (
        ("dep", "next", 1.0, "package.json", True),
        ("file", "next.config.js", 0.85, None, True),
        ("file", "next.config.ts", 0.85, None, True),
        ("file", "next.config.mjs", 0.85, None, True),
        ("dir", "pages", 0.7, None, True),
        ("dir", "app", 0.7, None, True),
        ("pattern", "getServerSideProps", 0.6, None, True),
        ("pattern", "getStaticProps", 0.6, None, True),
    ), parent="React"),
    Rule("Vue.js", "frontend", (
        ("dep", "vue", 1.0, "package.json", True),
        ("extension", ".vue", 0.85, None, True),
        ("pattern", "createApp(", 0.7, None, True),
        ("pattern", "new Vue({", 0.7, None, True),
    )),
    Rule("Angular", "frontend", (
        ("dep", "@angular/core", 1.0, "package.json", True),
        ("file", "angular.json", 0.9, None, True),
        ("pattern", "@Component", 0.8, None, True),
        ("extension", ".component.ts", 0.5, None, True),
    )),
    Rule("TypeScript", "language", (
        ("dep", "typescript", 1.0, "package.json", True),
        ("file", "tsconfig.json", 0.85, None, True),
        ("extension", ".ts", 0.6, None, True),
        ("extension", ".tsx", 0.5, None, True),
    )),
    Rule("Tailwind CSS", "frontend", (
        ("dep", "tailwindcss", 1.0, "package.json", True),
        ("file", "tailwind.config.js", 0.9, None, True),
        ("file", "tailwind.config.ts", 0.9, None, True),
        ("pattern", "@tailwind", 0.6, None, True),
        ("pattern", "@apply ", 0.5, None, True),
    )),
    Rule("Svelte", "frontend", (
        ("dep", "svelte", 1.0, "package.json", True),
        ("extension", ".svelte", 0.9, None, True),
    )),
    Rule("Redux", "frontend", (
        ("dep", "redux", 0.9, "package.json", True),
        ("dep", "react-redux", 1.0, "package.json", True),
        ("dep", "@reduxjs/toolkit", 0.95, "package.json", True),
        ("import", "createSlice", 0.7, None, True),
        ("dir", "store", 0.45, None, True),
        ("dir", "redux", 0.45, None, True),
    ), parent="React"),
    Rule("React Router", "frontend", (
        ("dep", "react-router-dom", 1.0, "package.json", True),
        ("import", "BrowserRouter", 0.65, None, True),
        ("import", "createBrowserRouter", 0.65, None, True),
    ), parent="React"),
    Rule("Axios", "frontend", (
        ("dep", "axios", 1.0, "package.json", True),
        ("import", "from 'axios'", 0.8, None, True),
        ("import", 'from "axios"', 0.8, None, True),
    )),
    Rule("Vite", "build", (
        ("dep", "vite", 1.0, "package.json", True),
        ("file", "vite.config.js", 0.9, None, True),
        ("file", "vite.config.ts", 0.9, None, True),
    ), excludes="Webpack"),
    Rule("Webpack", "build", (
        ("dep", "webpack", 1.0, "package.json", True),
        ("file", "webpack.config.js", 0.9, None, True),
        ("file", "webpack.config.ts", 0.9, None, True),
    )),
    Rule("Node.js", "backend", (
        ("file", "package.json", 0.85, None, True),
        ("pattern", "require('fs')", 0.5, None, True),
        ("pattern", "require('path')", 0.4, None, True),
        ("pattern", "from 'node:", 0.4, None, True),
        ("pattern", "process.exit", 0.3, None, True),
    )),
    Rule("Express.js", "backend", (
        ("dep", "express", 1.0, "package.json", True),
        ("pattern", "require('express')", 0.85, None, True),
        ("pattern", "express()", 0.8, None, True),
        ("pattern", "app.listen(", 0.6, None, True),
        ("pattern", "app.get(", 0.5, None, True),
        ("pattern", "app.post(", 0.5, None, True),
        ("pattern", "app.use(", 0.45, None, True),
    ), parent="Node.js"),
    Rule("Fastify", "backend", (
        ("dep", "fastify", 1.0, "package.json", True),
        ("pattern", "require('fastify')", 0.8, None, True),
        ("pattern", "fastify({", 0.7, None, True),
    )),
    Rule("NestJS", "backend", (
        ("dep", "@nestjs/core", 1.0, "package.json", True),
        ("file", "nest-cli.json", 0.8, None, True),
        ("pattern", "@Module", 0.75, None, True),
        ("pattern", "@Controller", 0.7, None, True),
    )),
    Rule("Django", "backend", (
        ("dep", "django", 1.0, "requirements.txt", True),
        ("file", "manage.py", 0.9, None, True),
        ("pattern", "DJANGO_SETTINGS_MODULE", 0.7, None, True),
        ("pattern", "django.setup", 0.65, None, True),
    )),
    Rule("Flask", "backend", (
        ("dep", "flask", 1.0, "requirements.txt", True),
        ("pattern", "from flask import", 0.85, None, True),
        ("pattern", "Flask(__name__)", 0.8, None, True),
    )),
    Rule("FastAPI", "backend", (
        ("dep", "fastapi", 1.0, "requirements.txt", True),
        ("pattern", "from fastapi import", 0.85, None, True),
        ("pattern", "FastAPI()", 0.8, None, True),
    )),
    Rule("Spring Boot", "backend", (
        ("dep", "spring-boot-starter", 1.0, "pom.xml", False),
        ("pattern", "@SpringBootApplication", 0.85, None, True),
        ("file", "application.properties", 0.6, None, True),
        ("file", "application.yml", 0.6, None, True),
    )),
    Rule("Go", "language", (
        ("file", "go.mod", 0.95, None, True),
        ("extension", ".go", 0.8, None, True),
        ("pattern", "package main", 0.5, None, True),
    )),
    Rule("Python", "language", (
        ("extension", ".py", 0.8, None, True),
        ("file", "requirements.txt", 0.6, None, True),
        ("file", "pyproject.toml", 0.6, None, True),
    )),
    Rule("Java", "language", (
        ("extension", ".java", 0.8, None, True),
        ("file", "pom.xml", 0.7, None, True),
        ("file", "build.gradle", 0.7, None, True),
    )),
    Rule("GraphQL", "backend", (
        ("dep", "graphql", 0.9, "package.json", True),
        ("dep", "apollo-server", 0.95, "package.json", True),
        ("extension", ".graphql", 0.85, None, True),
        ("pattern", "typeDefs", 0.5, None, True),
        ("pattern", "resolvers", 0.45, None, True),
    )),
    Rule("REST API", "backend", (
        ("pattern", "app.get(", 0.5, None, True),
        ("pattern", "app.post(", 0.5, None, True),
        ("pattern", "router.get(", 0.5, None, True),
        ("pattern", "router.post(", 0.5, None, True),
        ("pattern", ".json({", 0.4, None, True),
        ("pattern", "res.status(", 0.4, None, True),
        ("dir", "routes", 0.35, None, True),
        ("url", "/api/", 0.35, None, True),
    )),
    Rule("MongoDB", "database", (
        ("dep", "mongoose", 1.0, "package.json", True),
        ("dep", "mongodb", 0.95, "package.json", True),
        ("pattern", "mongoose.connect(", 0.8, None, True),
        ("pattern", "MongoClient(", 0.7, None, True),
        ("pattern", "mongodb://", 0.65, None, True),
        ("pattern", "mongodb+srv://", 0.65, None, True),
        ("docker", "mongo", 0.55, None, True),
    )),
    Rule("Mongoose", "database", (
        ("dep", "mongoose", 1.0, "package.json", True),
        ("pattern", "new mongoose.Schema", 0.8, None, True),
        ("pattern", "mongoose.model(", 0.75, None, True),
        ("dir", "models", 0.4, None, True),
    ), parent="MongoDB"),
    Rule("PostgreSQL", "database", (
        ("dep", "pg", 1.0, "package.json", True),
        ("dep", "postgres", 0.9, "package.json", True),
        ("dep", "pg-promise", 0.9, "package.json", True),
        ("dep", "psycopg2", 1.0, "requirements.txt", True),
        ("pattern", "postgres://", 0.6, None, True),
        ("pattern", "postgresql://", 0.6, None, True),
        ("docker", "postgres", 0.65, None, True),
    )),
    Rule("MySQL", "database", (
        ("dep", "mysql2", 1.0, "package.json", True),
        ("dep", "mysql", 0.9, "package.json", True),
        ("pattern", "mysql://", 0.6, None, True),
        ("docker", "mysql", 0.65, None, True),
    )),
    Rule("SQLite", "database", (
        ("dep", "sqlite3", 0.9, "requirements.txt", True),
        ("dep", "better-sqlite3", 1.0, "package.json", True),
        ("extension", ".sqlite", 0.7, None, True),
        ("extension", ".db", 0.4, None, True),
        ("pattern", "sqlite:", 0.5, None, True),
    )),
    Rule("Redis", "database", (
        ("dep", "redis", 0.9, "package.json", True),
        ("dep", "ioredis", 1.0, "package.json", True),
        ("dep", "redis", 0.9, "requirements.txt", True),
        ("pattern", "redis://", 0.55, None, True),
        ("docker", "redis", 0.55, None, True),
    )),
    Rule("Prisma", "database", (
        ("dep", "prisma", 1.0, "package.json", True),
        ("dep", "@prisma/client", 0.95, "package.json", True),
        ("file", "schema.prisma", 0.95, None, True),
    )),
    Rule("Firebase", "database", (
        ("dep", "firebase", 0.9, "package.json", True),
        ("dep", "firebase-admin", 0.9, "package.json", True),
        ("file", "firebase.json", 0.85, None, True),
    )),
    Rule("JWT", "authentication", (
        ("dep", "jsonwebtoken", 1.0, "package.json", True),
        ("dep", "PyJWT", 0.9, "requirements.txt", True),
        ("pattern", "jwt.sign(", 0.8, None, True),
        ("pattern", "jwt.verify(", 0.8, None, True),
        ("pattern", "JWT_SECRET", 0.5, None, True),
        ("pattern", "ACCESS_TOKEN", 0.45, None, True),
    )),
    Rule("Passport.js", "authentication", (
        ("dep", "passport", 1.0, "package.json", True),
        ("pattern", "require('passport')", 0.8, None, True),
        ("pattern", "passport.use(", 0.7, None, True),
        ("pattern", "passport.authenticate(", 0.7, None, True),
    ), parent="Node.js"),
    Rule("OAuth 2.0", "authentication", (
        ("dep", "passport-google-oauth20", 0.9, "package.json", True),
        ("dep", "passport-github2", 0.9, "package.json", True),
        ("pattern", "GOOGLE_CLIENT_ID", 0.6, None, True),
        ("pattern", "GITHUB_CLIENT_ID", 0.6, None, True),
        ("pattern", "/auth/google", 0.55, None, True),
        ("pattern", "/auth/github", 0.55, None, True),
    )),
    Rule("bcrypt", "authentication", (
        ("dep", "bcrypt", 0.9, "package.json", True),
        ("dep", "bcryptjs", 0.9, "package.json", True),
        ("pattern", "bcrypt.hash(", 0.7, None, True),
        ("pattern", "bcrypt.compare(", 0.65, None, True),
    )),
    Rule("NextAuth", "authentication", (
        ("dep", "next-auth", 1.0, "package.json", True),
        ("pattern", "NextAuth(", 0.7, None, True),
        ("pattern", "[...nextauth]", 0.75, None, True),
    )),
    Rule("Auth0", "authentication", (
        ("dep", "@auth0/auth0-react", 0.95, "package.json", True),
        ("pattern", "useAuth0(", 0.65, None, True),
    )),
    Rule("Docker", "deployment", (
        ("file", "Dockerfile", 0.95, None, True),
        ("file", "docker-compose.yml", 0.9, None, True),
        ("file", "docker-compose.yaml", 0.9, None, True),
        ("file", ".dockerignore", 0.7, None, True),
    )),
    Rule("Kubernetes", "deployment", (
        ("dir", "k8s", 0.7, None, True),
        ("dir", "kubernetes", 0.7, None, True),
        ("pattern", "kind: Deployment", 0.8, None, True),
        ("pattern", "kind: Service", 0.7, None, True),
        ("file", "Chart.yaml", 0.8, None, True),
    )),
    Rule("GitHub Actions", "deployment", (
        ("dir", ".github/workflows", 0.95, None, True),
    )),
    Rule("GitLab CI", "deployment", (
        ("file", ".gitlab-ci.yml", 0.95, None, True),
    )),
    Rule("Vercel", "deployment", (
        ("file", "vercel.json", 0.9, None, True),
        ("dep", "vercel", 0.8, "package.json", True),
    )),
    Rule("Netlify", "deployment", (
        ("file", "netlify.toml", 0.9, None, True),
    )),
    Rule("Heroku", "deployment", (
        ("file", "Procfile", 0.9, None, True),
    )),
    Rule("NGINX", "deployment", (
        ("file", "nginx.conf", 0.9, None, True),
        ("pattern", "FROM nginx", 0.6, None, True),
        ("dir", "nginx", 0.5, None, True),
    )),
    Rule("PM2", "deployment", (
        ("dep", "pm2", 0.85, "package.json", True),
        ("file", "ecosystem.config.js", 0.8, None, True),
    )),
    Rule("AWS", "cloud", (
        ("dep", "aws-sdk", 0.85, "package.json", True),
        ("dep", "@aws-sdk/", 0.85, "package.json", False),
        ("pattern", "AWS_ACCESS_KEY", 0.5, None, True),
        ("pattern", "AWS_SECRET", 0.5, None, True),
    )),
    Rule("AWS Lambda", "cloud", (
        ("file", "serverless.yml", 0.7, None, True),
        ("pattern", "exports.handler", 0.55, None, True),
    ), parent="AWS"),
    Rule("AWS S3", "cloud", (
        ("dep", "@aws-sdk/client-s3", 0.95, "package.json", True),
        ("pattern", "S3Client(", 0.6, None, True),
        ("pattern", ".upload(", 0.4, None, True),
    ), parent="AWS"),
    Rule("GCP", "cloud", (
        ("dep", "@google-cloud/", 0.9, "package.json", False),
        ("file", "app.yaml", 0.75, None, True),
    )),
    Rule("Supabase", "cloud", (
        ("dep", "@supabase/supabase-js", 0.95, "package.json", True),
        ("pattern", "supabase.from(", 0.6, None, True),
    )),
    Rule("Cloudflare", "cloud", (
        ("file", "wrangler.toml", 0.9, None, True),
        ("dep", "wrangler", 0.85, "package.json", True),
    )),
    Rule("Jest", "testing", (
        ("dep", "jest", 1.0, "package.json", True),
        ("file", "jest.config.js", 0.85, None, True),
        ("file", "jest.config.ts", 0.85, None, True),
        ("file", "jest.config.json", 0.85, None, True),
        ("extension", ".test.js", 0.65, None, True),
        ("extension", ".test.ts", 0.65, None, True),
        ("extension", ".test.jsx", 0.6, None, True),
        ("extension", ".test.tsx", 0.6, None, True),
        ("extension", ".spec.js", 0.65, None, True),
        ("extension", ".spec.ts", 0.65, None, True),
        ("dir", "__tests__", 0.5, None, True),
    )),
    Rule("Vitest", "testing", (
        ("dep", "vitest", 1.0, "package.json", True),
        ("file", "vitest.config.ts", 0.85, None, True),
        ("file", "vitest.config.js", 0.85, None, True),
        ("import", "from 'vitest'", 0.6, None, True),
        ("import", 'from "vitest"', 0.6, None, True),
    )),
    Rule("Mocha", "testing", (
        ("dep", "mocha", 1.0, "package.json", True),
        ("file", ".mocharc.js", 0.7, None, True),
        ("file", ".mocharc.json", 0.7, None, True),
    )),
    Rule("Pytest", "testing", (
        ("dep", "pytest", 1.0, "requirements.txt", True),
        ("file", "pytest.ini", 0.7, None, True),
        ("file", "conftest.py", 0.6, None, True),
        ("extension", "test_", 0.6, None, True),
        ("extension", "_test.py", 0.6, None, True),
    )),
    Rule("Cypress", "testing", (
        ("dep", "cypress", 1.0, "package.json", True),
        ("file", "cypress.config.js", 0.85, None, True),
        ("file", "cypress.config.ts", 0.85, None, True),
        ("dir", "cypress", 0.7, None, True),
    )),
    Rule("Playwright", "testing", (
        ("dep", "@playwright/test", 1.0, "package.json", True),
        ("file", "playwright.config.ts", 0.85, None, True),
        ("file", "playwright.config.js", 0.85, None, True),
    )),
    Rule("ESLint", "testing", (
        ("dep", "eslint", 0.95, "package.json", True),
        ("file", ".eslintrc.js", 0.8, None, True),
        ("file", ".eslintrc.json", 0.8, None, True),
        ("file", "eslint.config.js", 0.8, None, True),
        ("file", "eslint.config.mjs", 0.8, None, True),
    )),
    Rule("Prettier", "testing", (
        ("dep", "prettier", 0.9, "package.json", True),
        ("file", ".prettierrc", 0.75, None, True),
        ("file", ".prettierrc.json", 0.75, None, True),
        ("file", "prettier.config.js", 0.75, None, True),
    )),
)


class Stack(NamedTuple):
    name: str
    required: tuple
    bonus: float
    at_least: int | None = None


# Stacks in the order of their evaluation.
STACKS = (
    Stack("MERN Stack", ("MongoDB", "Express.js", "React", "Node.js"), 0.1), Stack("MEAN Stack", ("MongoDB", "Express.js", "Angular", "Node.js"), 0.1),
    Stack("MEVN Stack", ("MongoDB", "Express.js", "Vue.js", "Node.js"), 0.1), Stack("PERN Stack", ("PostgreSQL", "Express.js", "React", "Node.js"), 0.1),
    Stack("JAMstack", ("JavaScript", "REST API"), 0.05), Stack("T3 Stack", ("TypeScript", "Next.js", "Prisma", "Tailwind CSS"), 0.15, 3),
    Stack("Django Stack", ("Django", "PostgreSQL"), 0.1), Stack("Spring Boot Stack", ("Spring Boot",), 0.1),
)
# Categories in the order in which names are listed.
CATEGORIES = ("language", "frontend", "backend", "database", "authentication", "deployment", "cloud", "testing", "build")
