"""Severity rules: ordered cases over the axes of a record or a table cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def derive_severity(exists: Column, supports: Column, priority: Column) -> Column:
    must = priority == "obligatory"
    return (
        F.when(exists == "no", "high")
        .when(must & (supports == "does_not"), "high")
        .when(must & (supports == "partial"), "medium")
        .when(supports == "does_not", "low")
        .when((exists == "unresolved") | (supports == "inconclusive"), "low")
        .when(supports == "partial", "low")
        .otherwise("ok")
    )


def derive_cell_severity(mark: Column, verdict: Column, is_self: Column) -> Column:
    wrong = verdict == "contradicted"
    return (
        F.when(wrong & (((mark == "no") & ~is_self) | ((mark == "yes") & is_self)), "high")
        .when(wrong, "medium")
        .when(verdict == "may_not_support", F.when(is_self, "low").otherwise("medium"))
        .when(verdict == "undefined", "medium")
        .when(verdict == "unverifiable", "low")
        .otherwise("ok")
    )


def finalize_severity(exists: Column, supports: Column, priority: Column, severity: Column, tier: Column, in_table: Column) -> tuple[Column, Column]:
    """(supports, severity): citations in tables are skipped; a judge's severity other than ok stays."""
    final = F.when(in_table, F.lit("skipped")).otherwise(supports)
    return final, F.when((severity != "ok") & (tier == "judge"), severity).otherwise(derive_severity(exists, final, priority))


def inconclusive_reason(exists: Column, notes: Column) -> Column:
    """Why a verdict is open: whatever does not exist for sure is unresolved; else the notes say, in this spelling, that the full text was read."""
    return F.when(~F.coalesce(exists == "yes", F.lit(False)), "unresolved").when(F.contains(notes, F.lit("full text")), "fulltext").otherwise("abstract")


def hallucination_pred(exists: Column, issues: Column) -> Column:
    return F.coalesce((exists == "no") | (F.size(issues) > 0), F.lit(False))


def eligible(exists: Column, in_table: Column) -> Column:
    """Whether a citation goes to the judge: its work exists and it stands in prose."""
    return (exists == "yes") & ~F.coalesce(in_table, F.lit(False))
