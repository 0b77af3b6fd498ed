"""Question banks, learning resources and concept indexes: small relations joined with what was detected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Question categories in order, the number below which fallbacks are added, characters that make a question's key.
CATEGORIES = ("architecture", "tech-stack", "code-deep-dive", "design-pattern", "problem-solving", "behavioral", "concept-based")
LEAST, KEY = 12, 40

#: Our own question bank: (category, difficulty, question, concepts).
QUESTIONS = (
    ("architecture", "beginner", "Which layers does this code base have, and how do they call each other?", "layers,coupling"),
    ("architecture", "advanced", "Which part would have to change first for ten times the traffic, and why?", "scalability,caching"),
    ("tech-stack", "beginner", "What does each main dependency do, and what would replace it?", "dependencies"),
    ("tech-stack", "intermediate", "How are builds made, and which steps differ between development and production?", "build,deployment"),
    ("code-deep-dive", "intermediate", "Follow one request from its route to the stored data and back.", "control flow,persistence"),
    ("code-deep-dive", "advanced", "Which module has the most incoming edges, and what follows from that?", "graphs,coupling"),
    ("design-pattern", "intermediate", "Where is a boundary kept by an interface rather than by a convention?", "interfaces"),
    ("design-pattern", "advanced", "Which duplicated logic should become one abstraction, and which should not?", "duplication"),
    ("problem-solving", "intermediate", "An endpoint became slow since yesterday: what do you look at, in which order?", "profiling,logs"),
    ("problem-solving", "advanced", "Two writers race for one record: how do you find out, and how do you stop it?", "concurrency"),
    ("behavioral", "beginner", "Tell of a review in which you changed your mind.", "communication"),
    ("behavioral", "intermediate", "How do you hand over a module that only you know?", "documentation"),
    ("concept-based", "beginner", "What does idempotent mean, and which of these endpoints are?", "idempotence,http"),
    ("concept-based", "intermediate", "When does an index slow a database down?", "indexes"),
)
TECH_QUESTIONS = (
    ("React", "intermediate", "What makes a component render again, and how do you see it?", "rendering"), ("Express", "intermediate", "In which order do middleware functions run, and how does an error leave the chain?", "middleware"),
    ("MongoDB", "intermediate", "When is embedding better than referencing?", "documents"), ("Mongoose", "beginner", "What does populate cost?", "queries"), ("Passport", "intermediate", "Where does a strategy's verified user go?", "sessions"),
    ("JWT", "advanced", "How is a stolen token made useless before it expires?", "tokens"), ("bcrypt", "beginner", "What does the cost factor change?", "hashing"), ("Tailwind", "beginner", "How do unused classes leave the build?", "styles"),
    ("Vite", "beginner", "Why does the development server not bundle?", "modules"), ("Axios", "beginner", "Where do you refresh an expired token?", "interceptors"), ("Zod", "intermediate", "How do schema and static type stay one?", "validation"),
    ("Docker", "intermediate", "Why does the order of instructions change build times?", "layers"), ("GitHub Actions", "intermediate", "How do jobs share files?", "ci"),
)
FALLBACK = (("code-deep-dive", "beginner", "Which file would you read first, and why?", "reading"), ("architecture", "beginner", "Draw the folders as boxes: which arrows are missing?", "structure"), ("tech-stack", "beginner", "Which version is the oldest, and what blocks its upgrade?", "upgrades"))
#: Names under which a technology selects its questions; a name is always its own alias.
ALIASES = {"React": ("React Router", "react-router-dom", "react-router"), "Express": ("express.js",), "MongoDB": (), "Mongoose": (), "Passport": ("Passport.js", "passport-google-oauth20", "passport-github2"), "JWT": ("jsonwebtoken",),
           "bcrypt": ("bcryptjs",), "Tailwind": ("Tailwind CSS", "tailwindcss"), "Vite": (), "Axios": (), "Zod": (), "Docker": (), "GitHub Actions": ()}


#: Our own catalogue: name, category, where its documentation begins, concepts to learn.
CATALOGUE = (
    ("JavaScript", "language", "https://developer.mozilla.org/docs/Web/JavaScript", "closures,promises,modules"), ("TypeScript", "language", "https://www.typescriptlang.org/docs/", "types,generics,inference"),
    ("Python", "language", "https://docs.python.org/3/", "iterators,generators,modules"), ("Java", "language", "https://dev.java/learn/", "classes,generics,streams"), ("Go", "language", "https://go.dev/doc/", "goroutines,channels,interfaces"),
    ("React", "frontend", "https://react.dev/learn", "components,state,effects"), ("Next.js", "frontend", "https://nextjs.org/docs", "routing,rendering,data fetching"), ("Vue.js", "frontend", "https://vuejs.org/guide/", "components,reactivity"),
    ("Angular", "frontend", "https://angular.dev/overview", "components,dependency injection"), ("Svelte", "frontend", "https://svelte.dev/docs", "components,reactivity"), ("Redux", "frontend", "https://redux.js.org/introduction/getting-started", "state,reducers"),
    ("React Router", "frontend", "https://reactrouter.com/home", "routing"), ("Axios", "frontend", "https://axios-http.com/docs/intro", "http,interceptors"), ("Tailwind CSS", "frontend", "https://tailwindcss.com/docs", "styles,responsive design"),
    ("Vite", "build", "https://vite.dev/guide/", "modules,bundling"), ("Webpack", "build", "https://webpack.js.org/concepts/", "bundling,loaders"),
    ("Node.js", "backend", "https://nodejs.org/docs/latest/api/", "event loop,streams,modules"), ("Express.js", "backend", "https://expressjs.com/", "routing,middleware,http"), ("Fastify", "backend", "https://fastify.dev/docs/latest/", "routing,schemas"),
    ("NestJS", "backend", "https://docs.nestjs.com/", "modules,dependency injection"), ("Django", "backend", "https://docs.djangoproject.com/", "models,views,middleware"), ("Flask", "backend", "https://flask.palletsprojects.com/", "routing,contexts"),
    ("FastAPI", "backend", "https://fastapi.tiangolo.com/", "routing,types,dependency injection"), ("Spring Boot", "backend", "https://docs.spring.io/spring-boot/", "dependency injection,configuration"), ("GraphQL", "backend", "https://graphql.org/learn/", "schemas,queries"),
    ("REST API", "backend", "https://developer.mozilla.org/docs/Glossary/REST", "http,idempotence"), ("MongoDB", "database", "https://www.mongodb.com/docs/", "documents,indexes,aggregation"), ("Mongoose", "database", "https://mongoosejs.com/docs/", "schemas,documents,queries"),
    ("PostgreSQL", "database", "https://www.postgresql.org/docs/", "indexes,transactions,queries"), ("MySQL", "database", "https://dev.mysql.com/doc/", "indexes,transactions"), ("SQLite", "database", "https://www.sqlite.org/docs.html", "transactions,queries"),
    ("Redis", "database", "https://redis.io/docs/", "caching,data structures"), ("Prisma", "database", "https://www.prisma.io/docs", "schemas,migrations"), ("JWT", "authentication", "https://datatracker.ietf.org/doc/html/rfc7519", "tokens,signatures"),
    ("Passport.js", "authentication", "https://www.passportjs.org/docs/", "sessions,strategies"), ("Docker", "deployment", "https://docs.docker.com/", "images,layers,containers"), ("GitHub Actions", "deployment", "https://docs.github.com/actions", "ci,workflows"),
    ("Kubernetes", "deployment", "https://kubernetes.io/docs/", "containers,scheduling"), ("NGINX", "deployment", "https://nginx.org/en/docs/", "proxies,caching"), ("Jest", "testing", "https://jestjs.io/docs/getting-started", "tests,mocks"),
    ("Vitest", "testing", "https://vitest.dev/guide/", "tests,mocks"), ("Pytest", "testing", "https://docs.pytest.org/", "tests,fixtures"), ("ESLint", "testing", "https://eslint.org/docs/latest/", "static analysis"),
)
#: Other names under which resources are known.
RESOURCE_ALIASES = {
    "React": ("react.js", "reactjs"), "Vue.js": ("vue", "vuejs"), "Next.js": ("next", "nextjs"), "Node.js": ("node", "nodejs"), "Express.js": ("express", "expressjs"), "MongoDB": ("mongo",), "PostgreSQL": ("postgres", "pg"), "JavaScript": ("js", "es6"),
    "TypeScript": ("ts",), "Python": ("py",), "Go": ("golang",), "Tailwind CSS": ("tailwind", "tailwindcss"), "JWT": ("jsonwebtoken", "json web token"), "Passport.js": ("passport",), "Kubernetes": ("k8s",), "Spring Boot": ("spring",), "REST API": ("rest",),
}


def catalogue_rows(spark, rows=CATALOGUE) -> DataFrame:
    return spark.createDataFrame([(n, c, u, k.split(",")) for n, c, u, k in rows], "name string, category string, url string, concepts array<string>")


def resource_alias_rows(spark, aliases=RESOURCE_ALIASES) -> DataFrame:
    return spark.createDataFrame([(a, n) for n, others in aliases.items() for a in others], "alias string, name string")


def shuffled(questions: DataFrame, key: str = "project_id", seed: int = 42) -> DataFrame:
    """questions with place, their order in a pool that is mixed by a seed: by a hash of seed and question, the same at every run."""
    mixed = F.xxhash64(F.lit(seed), F.col("question"))
    return questions.withColumn("place", F.row_number().over(Window.partitionBy(key, "category").orderBy(mixed, "question")))


def question_rows(spark, questions=QUESTIONS, tech=TECH_QUESTIONS, fallback=FALLBACK) -> DataFrame:
    rows = [(c, d, q, k.split(","), None, CATEGORIES.index(c), i, False) for i, (c, d, q, k) in enumerate(questions)]
    rows += [("tech-stack", d, q, k.split(","), t, len(CATEGORIES), i, False) for i, (t, d, q, k) in enumerate(tech)]
    rows += [(c, d, q, k.split(","), None, len(CATEGORIES) + 1, i, True) for i, (c, d, q, k) in enumerate(fallback)]
    return spark.createDataFrame(rows, "category string, difficulty string, question string, key_concepts array<string>, technology string, part int, ord int, fallback boolean")


def alias_rows(spark, aliases=ALIASES) -> DataFrame:
    return spark.createDataFrame([(a.lower(), n) for n, others in aliases.items() for a in {n, *others}], "alias string, technology string")


def generate_questions(detected: DataFrame, bank: DataFrame | None = None, aliases: DataFrame | None = None, key: str = "project_id", least: int = LEAST) -> DataFrame:
    """detected (key, name): questions of every project, the first of each beginning; fallbacks only below ``least`` questions."""
    spark = detected.sparkSession
    bank, aliases = bank if bank is not None else question_rows(spark), aliases if aliases is not None else alias_rows(spark)
    projects = detected.select(key).distinct()
    mine = detected.select(key, F.lower("name").alias("alias")).join(F.broadcast(aliases), "alias").select(key, "technology").distinct()
    general = projects.join(F.broadcast(bank.where("technology is null")).withColumn("one_", F.lit(1)), F.lit(1) == F.col("one_")).drop("one_")
    special = mine.join(F.broadcast(bank.where("technology is not null")), "technology").select(*general.columns)
    w = Window.partitionBy(key, F.lower(F.substring("question", 1, KEY))).orderBy("part", "ord")
    once = general.unionByName(special).withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")
    n = F.count_if(~F.col("fallback")).over(Window.partitionBy(key))
    return once.withColumn("n_", n).where(~F.col("fallback") | (F.col("n_") < least)).drop("n_")


def question_stats(questions: DataFrame) -> DataFrame:
    """Counts by category and by difficulty from one pass: the other column is null."""
    return questions.groupingSets([["category"], ["difficulty"]], "category", "difficulty").agg(F.count("*").alias("n")).select("category", "difficulty", "n")


def canonical(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """rows with the name behind an alias, whatever its case, and whether it is known."""
    known = F.broadcast(aliases.select(F.lower("alias").alias("a_"), F.col("name").alias("k_")))
    return rows.withColumn("a_", F.lower(column)).join(known, "a_", "left").withColumn("name", F.coalesce("k_", column)).withColumn("known", F.col("k_").isNotNull()).drop("a_", "k_")


def concept_index(resources: DataFrame) -> DataFrame:
    """resources (technology, concepts): concept, technologies (sorted), n."""
    return resources.select("technology", F.explode("concepts").alias("concept")).groupBy("concept").agg(F.array_sort(F.collect_set("technology")).alias("technologies")).withColumn("n", F.size("technologies").cast("long"))


def top_concepts(index: DataFrame, n: int = 20) -> DataFrame:
    return index.orderBy(F.desc("n"), "concept").limit(n)


def learning_resources(detected: DataFrame, catalogue: DataFrame, aliases: DataFrame, scraped: DataFrame | None = None, key: str = "project_id") -> DataFrame:
    """detected (key, name) with their resource of the catalogue (name, category, url, concepts), under its canonical name, and what a page scan found."""
    own = canonical(detected.dropDuplicates([key, "name"]).withColumnRenamed("name", "said"), "said", aliases)
    out = own.join(F.broadcast(catalogue.withColumnRenamed("name", "c_").withColumn("l_", F.lower("c_"))), F.lower("name") == F.col("l_"), "left").drop("l_").withColumn("name", F.coalesce("c_", "name")).drop("c_")
    out = out.dropDuplicates([key, "name"])
    return out if scraped is None else out.join(scraped.withColumnRenamed("technology", "name"), "name", "left")


def not_collected(detected: DataFrame, collected: DataFrame, key: str = "project_id") -> DataFrame:
    """Names of a project that are not among the collected, whatever the case."""
    have = collected.select(key, F.lower("name").alias("l_")).distinct()
    return detected.withColumn("l_", F.lower("name")).join(have, [key, "l_"], "left_anti").drop("l_")
