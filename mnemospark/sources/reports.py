"""Small tables as Markdown, and logs of calls to models as JSON lines."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from mnemospark.functions.lazy import pd

#: Names of the kinds of conflict in tables, and what the tables show of each.
NAMES = {"dynamic_conflict": "Dynamic", "static_conflict": "Static", "conditional_conflict": "Conditional"}
LAYOUTS = {
    3: (("aa", "AA↑"), ("seh", "SEH@{k}↑")),
    5: (("aa", "AA↑"), ("ch", None)),
    6: (("seh", "SEH@{k}↑"), ("srs", "SRS↑")),
}
HANDLING = {"dynamic_conflict": "UOCS↑", "static_conflict": "CRS↑"}
MEANS = {3: ("aa",), 5: ("aa",), 6: ("seh", "srs")}
CALL = "timestamp double, module string, provider string, model string, request string, response string, prompt_tokens long, completion_tokens long, duration_ms double, success boolean, error string"


def figure(value: float | None) -> str:
    return "–" if value is None else f"{value:.4f}"


def markdown(header: list[str], rows: list[list[str]]) -> str:
    """A Markdown table; cells keep to one line and their bars are escaped."""
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])


def metric_table(metrics: DataFrame, number: int, k: int, method: str) -> str:
    """Table 3, 5 or 6 of what operators.evaluation.metrics gives (three rows a k); a mean is over kinds that have a value."""
    by = {r["conflict_type"]: r for r in metrics.where(metrics["k"] == k).collect()}
    header, row = ["Method"], [method]
    for kind, name in NAMES.items():
        for column, label in LAYOUTS[number]:
            label = HANDLING.get(kind) if label is None else label.format(k=k)
            if label:
                header.append(f"{name} {label}")
                row.append(figure(by[kind][column] if kind in by else None))
    for column in MEANS[number]:
        some = [by[kind][column] for kind in NAMES if kind in by and by[kind][column] is not None]
        header.append("Average " + dict(LAYOUTS[number])[column].format(k=k))
        row.append(figure(sum(some) / len(some) if some else None))
    return markdown(header, [row])


def by_k_table(metrics: DataFrame, method: str) -> str:
    """One row for each k and kind with questions, accuracy, support and rank score."""
    rows = sorted(metrics.collect(), key=lambda r: (r["k"], list(NAMES).index(r["conflict_type"])))
    return markdown(["Method", "K", "Kind", "Questions", "AA↑", "SEH↑", "SRS↑"], [[method, r["k"], NAMES[r["conflict_type"]], r["n"], *(figure(r[c]) for c in ("aa", "seh", "srs"))] for r in rows])


def write_text(spark, path: str, text: str) -> None:
    """A text file on any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def recorded(df: DataFrame, request: str, call: Callable[[str], tuple[str, int, int]], module: str, provider: str, model: str) -> DataFrame:
    """A row of CALL for each row of df: what call(request) gave (a text and its tokens in and out) or how it failed, and
    how long it took. Append them to a log with sources.jsonl.write_lines(..., append=True)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for asked in b[request]:
                at, begun = time.time(), time.perf_counter()
                try:
                    said, n_in, n_out = call(asked)
                    result = (json.dumps({"content": said}), n_in, n_out, True, None)
                except Exception as e:  # a model's function may raise anything; the log says what
                    result = (None, None, None, False, f"{type(e).__name__}: {e}")
                out.append((at, module, provider, model, asked, *result[:3], (time.perf_counter() - begun) * 1000, *result[3:]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CALL.split(", ")]).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    return df.select(request).mapInPandas(run, CALL)
