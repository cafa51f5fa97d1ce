"""Golden manifests of lineage: expected keys, and their precision and recall; text forms of graphs and scores."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from ..operators.telemetry import scores
from .lineage import keys_of

FAMILIES = ("deterministic", "inferredHigh", "inferredAmbiguous", "inferredSemantic", "callBound", "db2")


def _key(family: str, row: dict) -> str:
    if family == "deterministic":
        return "|".join([row["fieldName"], ",".join(sorted(row["copybooks"])), ",".join(sorted(row["programs"])), row.get("linkage", "deterministic")])
    if family.startswith("inferred"):
        return f"{row['fieldName']}|{','.join(sorted(row['copybooks']))}"
    if family == "callBound":
        return "|".join([row["caller"], row["callee"], str(row["position"]), row["callerField"], row["calleeField"], row.get("confidence", "deterministic")])
    pairs = sorted(f"{p['column']}:{p['writerHostVar']}:{p['readerHostVar']}" for p in row.get("columnPairs", []))
    return f"{row['table']}|{row['writer']}|{row['reader']}|{','.join(pairs)}"


def expected_keys(manifest: dict) -> list[tuple[str, str]]:
    """(family, key) of a manifest; a family that is absent is not graded, repeated keys are an error."""
    unknown = set(manifest) - {*FAMILIES, "version", "description"}
    if unknown:
        raise ValueError(f"unknown keys in the manifest: {sorted(unknown)}")
    keys = [(f, _key(f, r)) for f in FAMILIES for r in manifest.get(f) or []]
    if twice := [k for k, n in Counter(keys).items() if n > 1]:
        raise ValueError(f"repeated keys in the manifest: {twice[:3]}")
    return keys


def evaluate(spark: SparkSession, facts: DataFrame, manifest: dict) -> DataFrame:
    """Scores of the graded families of a manifest against the lineage of `facts`."""
    graded = [f for f in FAMILIES if f in manifest]
    expected = spark.createDataFrame(expected_keys(manifest), "family string, key string")
    actual = keys_of(facts)
    return scores(expected, actual.where(actual["family"].isin(graded) if graded else "false"))


def report(rows: list) -> str:
    """Scores as a Markdown table; `rows` come from `evaluate`, one per family."""
    lines = ["| family | tp | fp | fn | precision | recall | f1 |", "|---|---|---|---|---|---|---|"]
    lines += [f"| {r['family']} | {r['tp']} | {r['fp']} | {r['fn']} | {r['precision']:.1%} | {r['recall']:.1%} | {r['f1']:.1%} |" for r in rows]
    return "\n".join(lines)


def mermaid(edges: list[tuple[str, str, str]]) -> str:
    """A small collected graph as a Mermaid flow chart."""
    number = {n: f"n{i}" for i, n in enumerate(sorted({x for s, d, _ in edges for x in (s, d)}))}
    nodes = [f'  {v}["{k}"]' for k, v in number.items()]
    return "\n".join(["flowchart LR", *nodes, *[f"  {number[s]} -->|{k}| {number[d]}" for s, d, k in sorted(edges)]])


def dot(edges: list[tuple[str, str, str]]) -> str:
    """The same as a DOT graph."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "\n".join(["digraph lineage {", *[f"  {quote(s)} -> {quote(d)} [label={quote(k)}];" for s, d, k in sorted(edges)], "}"])
