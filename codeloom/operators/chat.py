"""Sessions, history, follow-ups, token budgets and answer caches over message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.prefixes import prefix_sums

#: Messages of history, messages of a session, sessions of a project, earlier user turns in a rewritten question.
HISTORY, MESSAGES, SESSIONS, TURNS = 10, 50, 20, 3
#: Tokens of a context and of chunks in it, shares of history and chunks, characters of a chunk.
CONTEXT, CHUNKS, HISTORY_SHARE, CHUNK_SHARE, BODY = 5_000, 3_500, 0.15, 0.60, 1_200


def last_n(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key; their order is the caller's."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= n).drop("rn_")


def session_messages(sessions: DataFrame, messages: DataFrame, keys: list[str], order: str, n: int = HISTORY) -> DataFrame:
    """The last n messages of every session that is there, with the columns of both."""
    return sessions.join(last_n(messages, keys, order, n), keys)


def follow_ups(messages: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", history: int = HISTORY, turns: int = TURNS) -> DataFrame:
    """User messages with prior (messages before, at most ``history``), is_follow_up and the query to search with: a follow-up gets the
    last user turns of its history appended."""
    w = Window.partitionBy(session).orderBy(order)
    seen = w.rowsBetween(-history, -1)
    earlier = F.collect_list(F.when(F.col(role) == "user", F.col(text))).over(seen)
    out = messages.withColumn("prior", F.count("*").over(seen)).withColumn("e_", earlier).where(F.col(role) == "user")
    out = out.withColumn("is_follow_up", X.is_follow_up(text, "prior"))
    recent = F.slice(F.col("e_"), F.greatest(F.size("e_") - turns + 1, F.lit(1)), turns)
    return out.withColumn("query", F.when(F.col("is_follow_up"), F.concat(F.col(text), F.lit("\nPrevious: "), F.array_join(recent, " "))).otherwise(F.col(text))).drop("e_")


def history_budget(messages: DataFrame, session: str, order: str, role: str = "role", text: str = "text", last: int = 4, budget: int = int(CONTEXT * HISTORY_SHARE), cumulative: bool = False) -> DataFrame:
    """The last messages of a session, formatted, up to the first that exceeds the budget: alone, or together with those before it."""
    recent = last_n(messages, [session], order, last)
    line = F.concat(F.when(F.col(role) == "user", "User: ").otherwise("Assistant: "), F.coalesce(text, F.lit("")))
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sized = recent.withColumn("line", line).withColumn("tokens", X.estimate_tokens("line"))
    used = F.sum("tokens").over(w) if cumulative else F.max("tokens").over(w)
    return sized.withColumn("used_", used).where(F.col("used_") <= budget).drop("used_")


def pack_chunks(chunks: DataFrame, key: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Chunks in order while they fit; the first that does not comes truncated to the tokens left, all later ones are dropped.

    What stands in front of a chunk decides alone, and its sum is made of blocks of a key, so a key of any size is spread over tasks.
    """
    total = prefix_sums(chunks, key, order, {"before_": F.col(tokens)}).where(F.col("before_") <= budget).withColumn("running", F.col("before_") + F.col(tokens))
    over = F.col("running") > budget
    return total.withColumn("truncated", over).withColumn("tokens_used", F.when(over, F.lit(budget) - F.col("before_")).otherwise(F.col(tokens))).drop("before_")


def token_stream(tokens: DataFrame, keys: list[str], order: str, token: str, between: str = "") -> DataFrame:
    """Every token of a stream with so_far, the text up to it. Text that is sent again with every token grows with the square of a stream's
    length, as in the protocol; streams are answers of bounded length."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("so_far", F.array_join(F.collect_list(token).over(w), between))


def rag_prompts(questions: DataFrame, hits: DataFrame, history: DataFrame | None = None, system: str = "You answer questions about a code base.", context: int = CONTEXT) -> DataFrame:
    """questions (query_id, question); hits (query_id, rank, file_path, language, content, score); history (query_id, line_no, line): query_id,
    prompt, chunk_tokens, history_tokens, with history and chunks within their budgets."""
    q = questions.select("query_id", "question")
    if history is not None:
        text = history.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("h_"))
        q = q.join(text, "query_id", "left")
    else:
        q = q.withColumn("h_", F.lit(None).cast("string"))
    q = q.withColumn("history_text", F.when(F.col("h_").isNotNull(), F.concat(F.lit("## Previous\n"), "h_"))).drop("h_")
    q = q.withColumn("history_tokens", X.estimate_tokens("history_text"))
    room = F.lit(context) - X.estimate_tokens(F.lit(system)) - X.estimate_tokens("question") - F.col("history_tokens")
    q = q.withColumn("budget_", F.least(F.lit(CHUNKS), F.floor(room * CHUNK_SHARE)).cast("long"))
    head = F.concat(F.lit("\n### "), F.coalesce("file_path", F.lit("unknown")), F.when(F.col("score").isNotNull(), F.concat(F.lit(" ("), F.floor(F.col("score") * 100 + 0.5).cast("string"), F.lit("%)"))).otherwise(""))
    body = F.substring(F.coalesce("content", F.lit("")), 1, BODY)
    block = lambda b, lang: F.concat(head, F.lit("\n```"), lang, F.lit("\n"), b, F.lit("\n```"))
    c = hits.join(q.select("query_id", "budget_"), "query_id").withColumn("block_", block(body, F.coalesce("language", F.lit("")))).withColumn("t_", X.estimate_tokens("block_"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("run_", F.sum("t_").over(w)).withColumn("over_", F.count_if(F.col("run_") > F.col("budget_")).over(w)).where("over_ = 0 or (over_ = 1 and run_ > budget_)")
    left = F.greatest(F.floor((F.col("budget_") - F.col("run_") + F.col("t_")) * 3.5), F.lit(0)).cast("int")
    c = c.withColumn("text_", F.when(F.col("run_") > F.col("budget_"), block(F.substring(body, F.lit(1), left), F.lit(""))).otherwise(F.col("block_")))
    chunks = c.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text_"))), lambda s: s["text_"]), "\n").alias("c_"), F.sum(F.when(F.col("run_") <= F.col("budget_"), F.col("t_")).otherwise(0)).alias("chunk_tokens"))
    out = q.join(chunks, "query_id", "left")
    parts = F.array(F.lit(system), F.col("history_text"), F.when(F.col("c_").isNotNull(), F.concat(F.lit("## Retrieved Code\n"), "c_")), F.concat(F.lit("\n\n## Question\n"), "question"))
    return out.select("query_id", F.array_join(parts, "\n").alias("prompt"), F.coalesce("chunk_tokens", F.lit(0)).alias("chunk_tokens"), "history_tokens")


def json_prompt(prompt: str, shape: str):
    return F.concat(F.col(prompt), F.lit("\n\nAnswer with JSON only, of this shape:\n"), F.lit(shape))


def session_to_use(sessions: DataFrame, owner: list[str], updated: str = "updated_at", count: str = "message_count", most: int = MESSAGES) -> DataFrame:
    """The latest session of each owner, and whether a new one is needed because it is full."""
    return last_n(sessions, owner, updated, 1).withColumn("needs_new", F.col(count) >= most)


def evicted(sessions: DataFrame, owner: list[str], updated: str = "updated_at", most: int = SESSIONS) -> DataFrame:
    """Sessions beyond the latest ``most`` of each owner."""
    w = Window.partitionBy(*owner).orderBy(F.desc(updated))
    return sessions.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") > most).drop("rn_")


def cache_lookup(questions: DataFrame, cache: DataFrame, now) -> DataFrame:
    """questions with the cached answer of their key that has not expired, and from_cache."""
    live = cache.where(F.col("expires_at") > now).groupBy("cache_key").agg(F.max_by("answer", "expires_at").alias("answer"))
    keyed = questions.withColumn("cache_key", F.concat(F.lit("chat_"), F.sha2(F.col("question"), 256)))
    return keyed.join(live, "cache_key", "left").withColumn("from_cache", F.col("answer").isNotNull())


def extractive_answer(content: str = "content", words: int = 40):
    """Stand-in for a model: the beginning of the best chunk."""
    return F.array_join(F.slice(F.split(F.coalesce(content, F.lit("")), r"\s+"), 1, words), " ")


def suggested_follow_ups(topic: str = "file_path"):
    return F.slice(F.array(F.concat(F.lit("How is "), F.col(topic), F.lit(" used?")), F.concat(F.lit("What does "), F.col(topic), F.lit(" depend on?")), F.concat(F.lit("How is "), F.col(topic), F.lit(" tested?"))), 1, 3)
