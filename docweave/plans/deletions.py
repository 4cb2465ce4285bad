"""Deletions of bases, accounts, sessions and experiments with all that refers to them, over whole tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from docweave.operators.cascade import Reference, cascade
from docweave.plans.catalog import query


class Source(NamedTuple):
    """A table of the graph as a selection of a given one; the expressions mean the same in Spark and DuckDB."""

    table: str
    columns: tuple[str, ...]
    key: tuple[str, ...] = ("id",)
    where: str = "true"


def ref(child: str, column: str, parent: str, rule: str = "row", to: str = "id") -> Reference:
    return Reference(child, tuple(column.split()), parent, tuple(to.split()), rule)


LINE = ("l_orderkey AS document_id", "l_linenumber AS number", "l_partkey AS part", "l_suppkey AS supplier")
LINE_KEY = ("document_id", "number", "part", "supplier")

#: What goes with a base: documents, their chunks and objects, wiki pages, answers that cite documents, cached answers.
BASES = {
    "bases": Source("nation", ("n_nationkey AS id", "n_regionkey AS region")),
    "documents": Source("customer", ("c_custkey AS id", "c_nationkey AS base_id")),
    "wiki_pages": Source("supplier", ("s_suppkey AS id", "s_nationkey AS base_id")),
    "objects": Source("orders", ("o_orderkey AS id", "o_custkey AS document_id")),
    "chunks": Source("lineitem", ("l_orderkey AS object_id", "l_linenumber AS number", "l_partkey AS part", "l_suppkey AS supplier"), ("object_id", "number", "part", "supplier")),
    "answers": Source("events", ("event_id AS id", "array(user_id + 1, event_id % 97 + 1, event_id % 89 + 1) AS document_ids"), where="event_type = 'view'"),
    "cached_answers": Source("part", ("p_partkey AS id", "array(p_partkey % 31, p_size) AS base_ids")),
}
BASE_LINKS = [ref("documents", "base_id", "bases"), ref("wiki_pages", "base_id", "bases"), ref("objects", "document_id", "documents"), ref("chunks", "object_id", "objects"),
              ref("answers", "document_ids", "documents", "every"), ref("cached_answers", "base_ids", "bases", "any")]

#: What goes with an account.
ACCOUNTS = {
    "users": Source("customer", ("c_custkey AS id", "c_mktsegment AS segment")),
    "api_keys": Source("customer", ("c_custkey * 10 AS id", "c_custkey AS user_id"), where="c_acctbal > 0"),
    "bases": Source("supplier", ("s_suppkey AS id", "s_suppkey * 3 AS owner_id")),
    "documents": Source("orders", ("o_orderkey AS id", "o_custkey AS owner_id")),
    "chunks": Source("lineitem", LINE, LINE_KEY),
    "wiki_pages": Source("part", ("p_partkey AS id", "p_partkey % 211 AS owner_id", "p_size AS base_id")),
    "cached_answers": Source("part", ("p_partkey AS id", "array(p_partkey % 101, p_size) AS base_ids")),
    "sessions": Source("conversations", ("conv_id AS id", "conv_id % 150 AS user_id"), where="turn = 0"),
    "memories": Source("conversations", ("conv_id AS session_id", "turn AS turn"), ("session_id", "turn"), "role = 'assistant'"),
    "feedbacks": Source("events", ("event_id AS id", "user_id AS owner_id"), where="event_type = 'click'"),
    "traces": Source("events", ("event_id AS id", "user_id AS user_id"), where="event_type = 'view'"),
    "badcases": Source("events", ("event_id AS id", "user_id AS user_id"), where="event_type = 'error'"),
    "executions": Source("events", ("event_id AS id", "user_id AS user_id"), where="event_id % 2 = 0"),
    "strategy_feedbacks": Source("events", ("event_id AS id", "event_id - 1 AS execution_id"), where="event_id % 2 = 1"),
    "experiments": Source("nation", ("n_nationkey AS id", "n_nationkey * 5 + 3 AS owner_id")),
}
ACCOUNT_LINKS = [ref("api_keys", "user_id", "users"), ref("bases", "owner_id", "users"), ref("documents", "owner_id", "users"), ref("chunks", "document_id", "documents"),
                 ref("wiki_pages", "owner_id", "users"), ref("wiki_pages", "base_id", "bases"), ref("cached_answers", "base_ids", "bases", "any"), ref("sessions", "user_id", "users"),
                 ref("memories", "session_id", "sessions"), ref("feedbacks", "owner_id", "users"), ref("traces", "user_id", "users"), ref("badcases", "user_id", "users"),
                 ref("executions", "user_id", "users"), ref("strategy_feedbacks", "execution_id", "executions"), ref("experiments", "owner_id", "users")]

#: A user may delete own sessions only, with own feedback on any session asked for; memories go with the sessions that do.
SESSIONS = {
    "requests": Source("conversations", ("conv_id AS session_id", "conv_id * 7 % 5 AS user_id"), ("session_id", "user_id"), "turn = 0 and conv_id % 4 = 1"),
    "sessions": Source("conversations", ("conv_id AS id", "conv_id % 5 AS user_id"), where="turn = 0"),
    "feedbacks": Source("events", ("event_id AS id", "event_id % 401 AS session_id", "user_id % 5 AS owner_id"), where="event_type = 'click'"),
    "memories": Source("conversations", ("conv_id AS session_id", "turn AS turn"), ("session_id", "turn")),
}
SESSION_LINKS = [ref("sessions", "id user_id", "requests", to="session_id user_id"), ref("feedbacks", "session_id owner_id", "requests", to="session_id user_id"), ref("memories", "session_id", "sessions")]

#: Experiments of their owners, with variants, allocations, metrics and results.
EXPERIMENTS = {
    "requests": Source("supplier", ("s_suppkey * 4 AS experiment_id", "s_suppkey % 25 AS owner_id"), ("experiment_id", "owner_id")),
    "experiments": Source("customer", ("c_custkey AS id", "c_custkey % 50 AS owner_id")),
    "variants": Source("orders", ("o_orderkey AS id", "o_custkey AS experiment_id")),
    "allocations": Source("orders", ("o_orderkey AS variant_id", "o_custkey AS user_id"), ("variant_id", "user_id")),
    "metrics": Source("lineitem", ("l_orderkey AS variant_id", "l_linenumber AS number", "l_partkey AS part", "l_suppkey AS supplier"), ("variant_id", "number", "part", "supplier")),
    "results": Source("events", ("event_id AS id", "user_id AS experiment_id")),
}
EXPERIMENT_LINKS = [ref("experiments", "id owner_id", "requests", to="experiment_id owner_id"), ref("variants", "experiment_id", "experiments"), ref("allocations", "variant_id", "variants"),
                    ref("metrics", "variant_id", "variants"), ref("results", "experiment_id", "experiments")]


def counts(t, sources: dict[str, Source], links: list[Reference], start: str, where: str) -> DataFrame:
    tables = {n: getattr(t, s.table).filter(s.where).selectExpr(*s.columns) for n, s in sources.items()}
    roots = {start: tables[start].filter(where).select(*sources[start].key)}
    return cascade(tables, {n: s.key for n, s in sources.items()}, links, roots).counts


def twin(sources: dict[str, Source], links: list[Reference], start: str, where: str) -> str:
    """The same counts with a subquery for every reference; ``sources`` name parents before children."""
    parts, out = [], []
    for n, s in sources.items():
        columns = ", ".join(s.columns).replace("array(", "list_value(")
        parts.append(f"t_{n} AS (SELECT {columns} FROM {s.table} WHERE {s.where})")
        tests, lists = [where if n == start else "false"], []
        for r in (r for r in links if r.child == n):
            to, own = ", ".join(r.parent_columns), ", ".join(r.columns)
            if r.rule == "row":
                tests.append(f"({own}) IN (SELECT {'(' + to + ')' if len(r.parent_columns) > 1 else to} FROM g_{r.parent})")
            else:
                held = f"(SELECT list({to}) FROM g_{r.parent})"
                tests.append(f"list_has_any({own}, {held})" if r.rule == "any" else f"list_has_all({held}, {own})")
                if r.rule == "every":
                    lists.append(f"list_has_any({own}, {held})")
        parts.append(f"g_{n} AS (SELECT * FROM t_{n} WHERE {' OR '.join(tests)})")
        key = ", ".join(s.key)
        rest = f"FROM t_{n} WHERE ({key}) NOT IN (SELECT {'(' + key + ')' if len(s.key) > 1 else key} FROM g_{n})"
        changed = f"(SELECT count(*) {rest} AND ({' OR '.join(lists)}))" if lists else "0::BIGINT"
        out.append(f"""SELECT '{n}' AS "table", (SELECT count(*) FROM g_{n}) AS deleted, {changed} AS rewritten, (SELECT count(*) {rest}) AS "left" """)
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


@query("base_cascade", twin(BASES, BASE_LINKS, "bases", "region = 2"))
def base_cascade(t) -> DataFrame:
    """Rows that go, change and stay in every table when the bases of one region are deleted."""
    return counts(t, BASES, BASE_LINKS, "bases", "region = 2")


@query("account_cascade", twin(ACCOUNTS, ACCOUNT_LINKS, "users", "segment = 'BUILDING'"))
def account_cascade(t) -> DataFrame:
    """Rows that go and stay in the tables of all accounts when those of one segment are closed."""
    return counts(t, ACCOUNTS, ACCOUNT_LINKS, "users", "segment = 'BUILDING'")


@query("session_cascade", twin(SESSIONS, SESSION_LINKS, "requests", "true"))
def session_cascade(t) -> DataFrame:
    """Rows that go and stay when users ask for sessions to be deleted, some of them not their own."""
    return counts(t, SESSIONS, SESSION_LINKS, "requests", "true")


@query("experiment_cascade", twin(EXPERIMENTS, EXPERIMENT_LINKS, "requests", "true"))
def experiment_cascade(t) -> DataFrame:
    """Rows that go and stay when owners ask for experiments to be deleted."""
    return counts(t, EXPERIMENTS, EXPERIMENT_LINKS, "requests", "true")
