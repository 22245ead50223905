"""Exploratory-analysis bundle and feature job as composed Spark jobs.

The validated hourly table is written once and every analysis reads it
(the reference re-scans its frame for each of eight analyses).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame

from pvspark.operators import eligibility as EL
from pvspark.operators import features as FE
from pvspark.operators import profile as P
from pvspark.operators import quality as Q
from pvspark.operators import splits as SP
from pvspark.operators.config import AnalysisThresholds, FeatureConfig, SplitProportions
from pvspark.session import cut_lineage
from pvspark.sources import io


@dataclass
class AnalysisBundle:
    tables: dict[str, DataFrame]
    split_plan: SP.SplitPlan


def run_analysis(hourly: DataFrame, thresholds: AnalysisThresholds = AnalysisThresholds(),
                 proportions: SplitProportions = SplitProportions(), output_dir: str | None = None) -> AnalysisBundle:
    """Profile, statistics, temporal summaries, correlations, quality flags,
    readiness and the chronological split plan of one validated table."""
    df = cut_lineage(hourly)
    plan = SP.plan_chronological_splits(df, proportions)
    labelled = SP.label_chronological(df, plan)
    flags = Q.quality_flags(df, thresholds)
    tables = {
        "profile": P.dataset_profile(df),
        "missing_values": P.missing_value_counts(df),
        "site_coverage": P.site_coverage(df),
        "target_summary": P.target_summary(df),
        "weather_summary": P.weather_summary(df),
        "hourly_profile": P.hourly_profile(df),
        "daily_energy": P.daily_energy(df),
        "monthly_energy": P.monthly_energy(df),
        "weekday_profile": P.weekday_profile(df),
        "hourly_ghi_generation": P.hourly_ghi_generation(df),
        "gaps": Q.gaps(df),
        "correlations": P.correlations(df),
        "correlation_matrix": P.correlation_matrix(df),
        "quality_flags": flags,
        "quality_flag_counts": Q.flag_counts(flags),
        "readiness": P.readiness(df, thresholds),
        "split_summary": SP.split_summary(labelled),
        "split_site_counts": SP.split_site_counts(labelled),
    }
    if output_dir:
        for name, t in tables.items():
            io.write_json_report(t, os.path.join(output_dir, name))
        io.write_splits(labelled, os.path.join(output_dir, "splits"))
    return AnalysisBundle(tables, plan)


def run_feature_job(hourly: DataFrame, sites: DataFrame, cfg: FeatureConfig = FeatureConfig(), *,
                    periods=None, split_plan=None, only_eligible: bool = False,
                    output_dir: str | None = None, write_split_outputs: bool = False) -> dict[str, DataFrame]:
    """F14 + A15-A18 + S12/S13 sinks: features, manifest, quality, eligibility."""
    res = FE.build_features(hourly, sites, cfg, periods=periods, split_plan=split_plan, only_eligible=only_eligible)
    out = {
        "features": res.features,
        "manifest": FE.feature_manifest(res.audit, res.contract, only_eligible),
        "quality": FE.feature_quality(res.audit, res.contract),
        "suspicious_ranges": FE.suspicious_ranges(res.audit),
        "eligibility": EL.eligibility_table(res.audit),
        "eligibility_reasons": EL.reason_counts(res.audit),
    }
    if output_dir:
        io.write_table(res.features, os.path.join(output_dir, "features"))
        for name in ("manifest", "quality", "suspicious_ranges", "eligibility", "eligibility_reasons"):
            io.write_json_report(out[name], os.path.join(output_dir, name))
        if write_split_outputs:
            io.write_splits(res.features, os.path.join(output_dir, "features_by_split"))
    return out
