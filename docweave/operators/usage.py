"""Usage ledger, feedback, traces, sessions: rollups, lists and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# fixed values: fields that are added up when two usage rows share a key
SUM_FIELDS = ["calls", "errors", "input_tokens", "output_tokens", "total_latency_ms", "priced_calls", "unpriced_calls", "estimated_cost"]
USAGE_KEY = ["usage_date", "provider_id", "model_id", "task", "cost_currency"]


def _named(col: str) -> Column:
    return F.when(F.coalesce(F.col(col), F.lit("")) == "", "unknown").otherwise(F.col(col))


def usage_measures(calls: DataFrame) -> DataFrame:
    """One measure row per call. A failed call counts calls, errors and latency only.

    ``calls``: ts, provider_id, model_id, task, currency, latency_ms, success,
    input_tokens, output_tokens, in_price, out_price (per 1000), error. A null or
    negative price means not priced.
    """
    price = lambda c: F.when(F.col(c) >= 0, F.col(c))
    ok = F.coalesce("success", F.lit(False))
    priced = ok & (price("in_price").isNotNull() | price("out_price").isNotNull())
    tokens = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    cost = (tokens("input_tokens") * F.coalesce(price("in_price"), F.lit(0.0))
            + tokens("output_tokens") * F.coalesce(price("out_price"), F.lit(0.0))) / 1000.0
    one = lambda cond: cond.cast("long")
    money = F.substring(F.upper(F.when(F.coalesce("currency", F.lit("")) == "", "USD").otherwise(F.col("currency"))), 1, 8)
    return calls.select(
        F.to_date("ts").alias("usage_date"), _named("provider_id").alias("provider_id"), _named("model_id").alias("model_id"),
        _named("task").alias("task"), money.alias("cost_currency"), F.col("ts"),
        F.lit(1).cast("long").alias("calls"), one(~ok).alias("errors"),
        F.when(ok, tokens("input_tokens")).otherwise(0).alias("input_tokens"),
        F.when(ok, tokens("output_tokens")).otherwise(0).alias("output_tokens"),
        F.greatest(F.coalesce("latency_ms", F.lit(0.0)), F.lit(0.0)).alias("total_latency_ms"),
        one(priced).alias("priced_calls"), one(ok & ~priced).alias("unpriced_calls"),
        F.when(priced, cost).otherwise(0.0).alias("estimated_cost"),
        F.when(~ok, F.substring(F.coalesce("error", F.lit("")), 1, 500)).alias("last_error"))


def usage_daily(measures: DataFrame) -> DataFrame:
    """Measures summed per day and key; the last non-empty error stays."""
    failed = F.when(F.coalesce("last_error", F.lit("")) != "", F.col("ts"))
    return measures.groupBy(*USAGE_KEY).agg(*[F.sum(c).alias(c) for c in SUM_FIELDS],
                                            F.coalesce(F.max_by("last_error", failed), F.lit("")).alias("last_error"))


def usage_totals(daily: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Totals per provider, model, task and currency over the last ``days`` days with today."""
    start = F.date_sub(today, max(1, days) - 1)
    return daily.filter(F.col("usage_date") >= start).groupBy(*USAGE_KEY[1:]).agg(*[F.sum(c).alias(c) for c in SUM_FIELDS])


def merge_usage(*parts: DataFrame) -> DataFrame:
    """Several usage frames as one: sums, mean latency to 1 digit, cost to 6; currencies apart."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    agg = rows.groupBy(*USAGE_KEY[1:]).agg(*[F.sum(c).alias(c) for c in SUM_FIELDS])
    return agg.withColumn("avg_latency_ms", F.round(F.col("total_latency_ms") / F.greatest("calls", F.lit(1)), 1)).withColumn(
        "estimated_cost", F.round("estimated_cost", 6)).drop("total_latency_ms")


def merge_versions(rows: DataFrame, version: str) -> DataFrame:
    """Daily rows of several versions summed per key; a non-empty error of a later version replaces an earlier one."""
    said = F.when(F.coalesce("last_error", F.lit("")) != "", F.col(version))
    return rows.groupBy(*USAGE_KEY).agg(*[F.sum(c).alias(c) for c in SUM_FIELDS], F.coalesce(F.max_by("last_error", said), F.lit("")).alias("last_error"))


def upsert_usage(stored: DataFrame, deltas: DataFrame) -> DataFrame:
    """Stored rows with deltas added; a non-empty newer error replaces the old one."""
    return merge_versions(stored.withColumn("_new", F.lit(0)).unionByName(deltas.withColumn("_new", F.lit(1))), "_new")


def feedback_stats(feedback: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, positive (>= 4), negative (<= 2) and mean rating to 2 digits."""
    r = F.col("rating")
    return feedback.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(r >= 4).alias("positive"), F.count_if(r <= 2).alias("negative"),
        F.coalesce(F.round(F.avg(r), 2), F.lit(0.0)).alias("average"))


def strategy_feedback_stats(feedback: DataFrame, executions: DataFrame, owner: Column | None = None) -> DataFrame:
    """Count, mean, positive (> 0) and negative (< 0) of feedback on executions of an owner."""
    scope = executions if owner is None else executions.filter(owner)
    rows = feedback.join(scope.select("execution_id"), "execution_id")
    v = F.col("value")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.round(F.avg(v), 6), F.lit(0.0)).alias("average"),
                    F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"))


def badcase_stats(cases: DataFrame) -> DataFrame:
    """Cases per category (null is ``unknown``) and mean severity to 2 digits."""
    return cases.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg("severity"), 2).alias("mean_severity"))


def execution_stats(executions: DataFrame) -> DataFrame:
    """Per day and in all (null day): executions, those that used the base, mean confidence."""
    return executions.rollup(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("used_kb").alias("kb_used"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def executions_with_feedback(executions: DataFrame, feedback: DataFrame, limit: int) -> DataFrame:
    """Newest joined rows up to ``limit``, then feedback gathered per execution.

    The limit counts joined rows, so the last execution may come without some of its feedback.
    """
    joined = executions.join(feedback.select("execution_id", "feedback_id", "value"), "execution_id", "left")
    newest = joined.orderBy(F.col("created_at").desc(), F.col("execution_id").desc(), "feedback_id", "value").limit(limit)
    item = F.struct("feedback_id", "value")
    return newest.groupBy("execution_id", "created_at").agg(F.array_sort(F.collect_list(F.when(F.col("feedback_id").isNotNull(), item))).alias("feedback"))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, cap: int = 200) -> DataFrame:
    """One page in a total order; ``order`` must end with a unique column."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, cap)))


def with_total(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, cap: int = 200) -> DataFrame:
    return page(rows, order, limit, offset, cap).withColumn("total", rows.agg(F.count(F.lit(1))).scalar())


def trace_summary(traces: DataFrame, question_chars: int = 120) -> DataFrame:
    return traces.select("trace_id", "user_id", "created_at", F.substring("question", 1, question_chars).alias("question"),
                         F.coalesce(F.size("stages"), F.lit(0)).alias("stage_count"),
                         F.coalesce(F.col("fallback_triggered").cast("boolean"), F.lit(False)).alias("fallback_triggered"), "total_latency_ms")


def own_traces(traces: DataFrame, user: str, default_user: str = "default") -> DataFrame:
    """Traces of a user; the default user also owns those without one."""
    mine = F.col("user_id") == user
    return traces.filter(mine | F.col("user_id").isNull() if user == default_user else mine)


def trace_stages(traces: DataFrame) -> DataFrame:
    """One row per stage with its nested timings as a map."""
    return traces.select("trace_id", F.posexplode("stages").alias("step", "s")).select(
        "trace_id", "step", "s.name", "s.status", "s.latency_ms", F.from_json("s.detail", "map<string,double>").alias("timings"))


def tool_steps(traces: DataFrame) -> DataFrame:
    """One row per tool call of a run, in order."""
    return traces.select("trace_id", F.posexplode("tool_calls").alias("step", "call")).select(
        "trace_id", "step", F.get_json_object("call", "$.name").alias("tool"), F.get_json_object("call", "$.arguments").alias("arguments"))


def question_inventory(traces: DataFrame) -> DataFrame:
    return traces.groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.max("primary_mode").alias("mode"))


def session_filter(owner: Column, keyword: str | None = None, texts: list[str] | None = None, kb_id: str | None = None,
                   date_from: str | None = None, date_to: str | None = None, keyword_cap: int = 100) -> Column:
    """AND of the session list conditions. The keyword is a plain case-insensitive substring
    of any text column; dates are whole days on updated_at, the last one included."""
    cond = owner
    word = (keyword or "").strip()[:keyword_cap]
    if word:
        hit = F.lit(False)
        for c in texts or ["title"]:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(word.lower()))
        cond = cond & hit
    if kb_id:
        cond = cond & F.array_contains("kb_ids", kb_id)
    if date_from:
        cond = cond & (F.col("updated_at") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        cond = cond & (F.col("updated_at") < F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp"))
    return cond


def document_status_filter(status: str | None) -> Column:
    """``active`` means published; ``inactive`` means draft or archived."""
    if not status:
        return F.lit(True)
    if status == "active":
        return F.col("status") == "published"
    if status == "inactive":
        return F.col("status").isin("draft", "archived")
    return F.col("status") == status


def audit_filter(user: str | None = None, action: str | None = None, resource_type: str | None = None,
                 resource_id: str | None = None, start: str | None = None, end: str | None = None) -> Column:
    cond = F.lit(True)
    for name, value in (("user_id", user), ("action", action), ("resource_type", resource_type), ("resource_id", resource_id)):
        if value is not None:
            cond = cond & (F.col(name) == value)
    if start:
        cond = cond & (F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end:
        cond = cond & (F.col("created_at") <= F.lit(end).cast("timestamp"))
    return cond


#: Most rows of a page (fixed value).
PAGE_LIMIT = 200


def owner_pages(rows: DataFrame, owner: str, newest: str, key: str, where: dict[str, object] | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """The page of rows ``skip`` + 1 to ``skip`` + ``limit`` of every owner at once, newest first, with its ``place`` from 1; ties go to the smaller key.

    ``where`` names columns that must have a value; None sets no condition. A list of one owner is this with the owner among
    the conditions. Only the leading rows of an owner leave the task that reads them. Rows without an owner are nobody's.
    """
    if skip < 0 or not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"skip must not be negative, and limit lie between 1 and {PAGE_LIMIT}")
    kept = rows.filter(F.col(owner).isNotNull())
    for name, value in (where or {}).items():
        if value is not None:
            kept = kept.filter(F.col(name) == F.lit(value))
    order = W.partitionBy(owner).orderBy(F.col(newest).desc_nulls_last(), key)
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= skip + limit).filter(F.col("place") > skip)


def recent_questions(sessions: DataFrame, messages: DataFrame, sessions_kept: int = 10, questions: int = 10) -> DataFrame:
    """User messages of the newest sessions, in session and message order, first ten."""
    newest = sessions.orderBy(F.col("updated_at").desc(), F.col("session_id").desc()).limit(sessions_kept)
    rows = messages.filter(F.col("role") == "user").join(F.broadcast(newest.select("session_id", "updated_at")), "session_id")
    return rows.orderBy(F.col("updated_at").desc(), F.col("session_id").desc(), "turn").limit(questions).select("session_id", "turn", "text")


def last_turns(messages: DataFrame, turns: int) -> DataFrame:
    """The last n messages of every session; the cut runs before the shuffle."""
    w = W.partitionBy("session_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= turns)


# fixed values: speaker names in prompts and exports
ROLE_NAMES = {"user": "用户", "assistant": "助手", "system": "系统"}


def role_name(role: Column) -> Column:
    out = role
    for key, name in ROLE_NAMES.items():
        out = F.when(role == key, name).otherwise(out)
    return out


def history_text(messages: DataFrame, turns: int) -> DataFrame:
    """One text per session: its last n messages, oldest first."""
    line = F.concat(role_name(F.col("role")), F.lit(": "), F.col("text"))
    return last_turns(messages, turns).groupBy("session_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def session_markdown(sessions: DataFrame, messages: DataFrame, preview_chars: int = 200) -> DataFrame:
    """(session_id, block, text): the export as ordered blocks, a header and one per message.

    A session of any length stays spread over tasks; a writer partitions by session and
    sorts by block. ``messages``: session_id, turn, role, text, stamp, sources[].
    """
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    title = F.trim(F.coalesce("title", F.lit("")))
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit("—"))
    head = sessions.join(counts, "session_id", "left").select(
        "session_id", F.lit(-1).cast("long").alias("block"),
        F.concat(F.lit("# "), F.when(title == "", "未命名对话").otherwise(title), F.lit("\n\n- 会话 ID："), F.col("session_id").cast("string"),
                 F.lit("\n- 创建时间："), stamp("created_at"), F.lit("\n- 最近活动："), stamp("updated_at"),
                 F.lit("\n- 消息数："), F.coalesce("n", F.lit(0)).cast("string"), F.lit("\n\n---\n"),
                 F.when(F.coalesce("n", F.lit(0)) == 0, "\n_该会话还没有消息。_\n").otherwise("")).alias("text"))
    folded = F.transform(F.col("sources"), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
    cut = F.transform(F.filter(folded, lambda s: s != ""), lambda s: F.when(
        F.length(s) > preview_chars, F.concat(F.substring(s, 1, preview_chars - 1), F.lit("…"))).otherwise(s))
    listed = F.array_join(F.transform(cut, lambda s, i: F.concat(F.lit("> "), (i + 1).cast("string"), F.lit(". "), s)), "\n")
    refs = F.when(F.coalesce(F.size(cut), F.lit(0)) > 0, F.concat(F.lit("> 参考来源\n"), listed, F.lit("\n\n"))).otherwise("")
    body = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r"))
    block = messages.select("session_id", F.col("turn").cast("long").alias("block"), F.concat(
        F.lit("**"), role_name(F.col("role")), F.lit("**（"), stamp("stamp"), F.lit("）\n\n"),
        F.when(body == "", "_（空消息）_").otherwise(body), F.lit("\n\n"), refs, F.lit("---\n")).alias("text"))
    return head.unionByName(block)


def export_file_name(title: Column, session_id: Column, most: int = 60) -> Column:
    """Title without path and control characters, or ``session-`` and the start of the id."""
    safe = F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|\x00-\x1F]', "")
    safe = F.btrim(F.substring(F.trim(F.regexp_replace(safe, r"\s+", " ")), 1, most), F.lit(" ."))
    return F.concat(F.when(safe == "", F.concat(F.lit("session-"), F.substring(session_id.cast("string"), 1, 8))).otherwise(safe), F.lit(".md"))
