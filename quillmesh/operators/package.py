"""Package manifests and conformance: validation of the manifest, inventory of a workspace, issues by policy."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import iso_micros
from .pages import broken_links, is_system

DAY = 86_400_000_000
#: Fields of a manifest (fixed values): field -> (kind, required, further test). A kind is text, date, version, flag, true, days, level or map.
FIELDS = {
    "": {
        "format": ("text", True), "format_version": ("version", True), "name": ("name", True), "version": ("text", True), "license": ("text", True), "owner": ("text", True),
        "created_at": ("date", True), "description": ("any text", False), "generator": ("map", False), "source_policy": ("map", True), "wiki_policy": ("map", True), "evidence_policy": ("map", True), "metadata": ("free map", False),
    },
    "generator": {"name": ("text", True), "version": ("text", True)},
    "source_policy": {"raw_immutable": ("true", True), "require_sha256": ("true", True), "require_meta_sidecars": ("flag", False)},
    "wiki_policy": {"require_sources_for_grounded_pages": ("flag", True), "allow_synthesis_pages": ("flag", True), "stale_after_days": ("days", False)},
    "evidence_policy": {"allow_unsupported_pages": ("level", True), "require_abstain_signal": ("flag", True)},
}
LEVELS = ("allow", "warn", "reject")
SEVERITY = {"allow": "info", "warn": "warning", "reject": "error"}
NAME, DATE, FORMAT_VERSION = r"[a-zA-Z0-9][a-zA-Z0-9._-]*", r"\d{4}-\d{2}-\d{2}(?:T.*)?", "0.1"


def _fault(kind: str, value: object) -> str | None:
    """What is wrong with a value of a kind, if anything."""
    text = isinstance(value, str) and value.strip() != ""
    if kind == "any text":
        return None if isinstance(value, str) else "must be text"
    if kind == "text":
        return None if text else "must be text that is not blank"
    if kind == "name":
        return "must be text that is not blank" if not text else None if re.fullmatch(NAME, value) else "must begin with a letter or digit and hold only letters, digits, dots, underscores and hyphens"
    if kind == "date":
        if isinstance(value, (datetime.date, datetime.datetime)):
            return None
        return "must be a date" if not text else None if re.fullmatch(DATE, value, re.S) else "must begin with year-month-day"
    if kind == "version":
        known = isinstance(value, str) and value == FORMAT_VERSION or isinstance(value, float) and value == float(FORMAT_VERSION)
        return None if known else f"must be {FORMAT_VERSION}"
    if kind in ("flag", "true"):
        return "must be true or false" if not isinstance(value, bool) else "must be true" if kind == "true" and not value else None
    if kind == "days":
        whole = isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
        return None if whole and value > 0 else "must be a whole number above zero"
    if kind == "level":
        return "must be text that is not blank" if not text else None if value in LEVELS else f"must be one of {', '.join(LEVELS)}"
    return None if isinstance(value, dict) else "must be a mapping"


def manifest_issues(manifest: object, format_name: str | None = None) -> list[tuple[str, str, str]]:
    """(severity, field, message) for a manifest that was read from a file; None means that there is none.

    `format_name` is the format that the caller takes; without it any name will do. Fields of
    no meaning are errors, but `metadata` may hold anything. Fields in a faulty mapping are not looked at.
    """
    if manifest is None:
        return [("error", "", "manifest is missing")]
    if not isinstance(manifest, dict):
        return [("error", "", "manifest is no mapping")]
    out: list[tuple[str, str, str]] = []

    def look(fields: dict, held: dict, within: str) -> None:
        out.extend(("error", f"{within}{k}", "unknown field") for k in held if k not in fields)
        for field, (kind, required) in fields.items():
            if field not in held:
                if required:
                    out.append(("error", f"{within}{field}", "is missing"))
            elif fault := _fault(kind, held[field]):
                out.append(("error", f"{within}{field}", fault))
            elif kind == "map":
                look(FIELDS[field], held[field], f"{field}.")

    look(FIELDS[""], manifest, "")
    named = manifest.get("format")
    if format_name is not None and isinstance(named, str) and named.strip() and named != format_name:
        out.append(("error", "format", f"must be {format_name}"))
    return out


def inventory(pages: DataFrame, raws: DataFrame, now: int, stale_days: int = 90) -> DataFrame:
    """One row: pages, system pages, sourced, synthesis, unsupported and stale pages, raw documents, broken links."""
    mark = lambda k: F.coalesce(F.try_element_at("frontmatter", F.lit(k)) == "true", F.lit(False))
    own = ~is_system(F.col("path"))
    sourced = F.size(F.coalesce("sources", F.array().cast("array<string>"))) > 0
    synthesis = mark("synthesis") | F.coalesce(F.col("type") == "synthesis", F.lit(False))
    counts = pages.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(~own).alias("system_pages"), F.count_if(own & sourced).alias("sourced"), F.count_if(own & synthesis).alias("synthesis"),
        F.count_if(own & ~sourced & ~synthesis).alias("unsupported"), F.count_if(own & stale(now, stale_days)).alias("stale"),
    )
    return counts.join(raws.agg(F.count(F.lit(1)).alias("raws"), F.count_if(F.col("sha256").isNull()).alias("raws_without_hash"))).join(broken_links(pages).agg(F.count(F.lit(1)).alias("broken_links")))  # one row each


def stale(now: int, days: int):  # noqa: ANN201
    """Whether a page's `updated` lies more than `days` back; pages without a readable time are not stale."""
    return F.coalesce(F.lit(now) - iso_micros(F.col("updated")) > days * DAY, F.lit(False))


def conformance(counts: DataFrame, policies: dict) -> DataFrame:
    """(severity, kind, n) of what the inventory finds, as severe as the policies of the manifest say; zero counts give no row."""
    unsupported = SEVERITY.get((policies.get("evidence_policy") or {}).get("allow_unsupported_pages", "warn"), "warning")
    hashed = "error" if (policies.get("source_policy") or {}).get("require_sha256", True) else "warning"
    checks = [("unsupported", unsupported), ("broken_links", "warning"), ("raws_without_hash", hashed), ("stale", "info")]
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"), F.col(k).cast("long").alias("n")) for k, s in checks])
    return counts.select(F.explode(rows).alias("x")).select("x.*").where("n > 0")
