"""All queries of the engine itself, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
PLANS = ("search", "joins", "windows", "aggregates", "texts", "evaluation", "construction", "stateful", "retrieval", "answers", "records", "times", "intents", "navigation", "judging", "memory", "generator", "entities", "runs")
#: DuckDB counts what holds in 128 bits and takes literals as decimals; these columns are cast to the types that Spark gives.
_AS_LONG = {
    "rate_report": ("failures",), "dataset_summary": ("en", "de", "fr", "es", "short"), "write_gate": ("informative",), "failure_decomposition": ("failed", "retrieval", "utilisation"),
    "backfill_sessions": ("backfilled",), "pricing": ("unpriced",), "current_state": ("revisions",), "reliable_time": ("reliable",), "hard_time_filter": ("between_days", "before_days", "after_days"),
    "interval_variants": ("short_gaps", "long_gaps"), "dialogue_tokens": ("valid", "short"),
}
_AS_DOUBLE = {"partial_credit": ("credit",), "ranking_scores": ("score", "hints"), "affects_topic": ("confidence",), "judge_coercion": ("accuracy",)}


def _typed(name: str, sql: str) -> str:
    casts = [f"CAST({c} AS {t}) AS {c}" for names, t in ((_AS_LONG, "BIGINT"), (_AS_DOUBLE, "DOUBLE")) for c in names.get(name, ())]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for name in PLANS:
        import_module(f"mnemospark.plans.{name}")


def entry(spark: SparkSession) -> DataFrame:
    return queries()["hybrid_search"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: _typed(name, sql) for name, sql in _SQL.items()}
