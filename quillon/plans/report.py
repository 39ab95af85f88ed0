"""The data side of a report: catalog, drift, table choice, join, profile, insights, visuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.operators import quality
from quillon.operators.catalog import catalog_of, rank_tables_for
from quillon.operators.drift import detect_drift
from quillon.operators.insights import insights
from quillon.operators.measures import Measure
from quillon.operators.modeling import suggest_fields
from quillon.operators.natural_join import natural_join
from quillon.operators.profile import profile
from quillon.operators.visuals import suggest_visuals, table_visual, visual_bundle
from quillon.session import stored


def _visual_data(joined: DataFrame, fields: list) -> DataFrame:
    """The page's aggregates where there are measures, else one table of all columns."""
    have = set(joined.columns)
    specs = [Measure(f.column, f.suggestion) for f in fields if f.role == "measure" and f.column in have]
    if not specs:
        return table_visual(joined, [], joined.columns, None)
    pick = {kind: next((f.column for f in fields if f.suggestion == kind and f.column in have), None)
            for kind in ("time", "category", "geography")}
    return visual_bundle(joined, specs, pick["time"], pick["category"], pick["geography"])


def build_report(spark: SparkSession, sources: dict[str, DataFrame], requirements: str,
                 snapshot_path: str | None = None, source_name: str = "source",
                 approx: bool = False, tables: int = 5) -> dict[str, DataFrame]:
    """Frames of a report over the ``tables`` tables that fit the requirements best.

    ``catalog, tables, joined, dataset, columns, issues, score, advice, insights, fields,
    visuals, visual_data`` and, with a snapshot path, ``drift``. Table choice reads the
    catalog only. The join and its profile are written to the shared folder at once; all other
    work on the data waits for the caller to write a frame.
    """
    catalog = catalog_of(spark, sources)
    out = {"catalog": catalog}
    if snapshot_path:
        _, out["drift"] = detect_drift(spark, snapshot_path, source_name, catalog)
    out["tables"] = rank_tables_for(spark, catalog, requirements, tables)
    # at most so many table names
    chosen = [r.table for r in out["tables"].orderBy("rank").collect()] or list(sources)[:1]
    joined, _ = natural_join({t: sources[t] for t in chosen})
    # the join and the profile are read by nearly all that follows
    out["joined"] = joined = stored(joined, "joined")
    out["dataset"], columns = profile(joined, approx)
    out["columns"] = stored(columns, "columns")
    issues = quality.union_issues(quality.quality_issues(out["columns"]), quality.empty_issue(out["columns"]))
    out["issues"] = issues
    out["score"] = quality.quality_score(out["columns"], issues)
    out["advice"] = quality.recommendations(out["score"], issues)
    out["insights"] = insights(joined)
    chosen_catalog = catalog_of(spark, {t: sources[t] for t in chosen})
    out["fields"] = suggest_fields(chosen_catalog)
    out["visuals"] = suggest_visuals(out["fields"])
    # one row per column of the chosen tables
    out["visual_data"] = _visual_data(joined, out["fields"].collect())
    return out
