"""Name → analysis, and the single entry point :func:`run`."""

from __future__ import annotations

from dataclasses import replace
from typing import Callable, Mapping

from innsight.errors import AnalysisError
from innsight.plans import feedback, indicators, infirmary, occupancy, overtime, revenue, sentiment
from innsight.plans.spec import AnalysisResult, Page
from innsight.sources.catalog import Catalog

Analysis = Callable[[Catalog, Mapping, Page], AnalysisResult]

REGISTRY: dict[str, Analysis] = {
    "list_daily_occupancy": occupancy.list_daily_occupancy,
    "summarize_guests_by_month": occupancy.summarize_guests_by_month,
    "calculate_complaint_per_guest_index": occupancy.calculate_complaint_per_guest_index,
    "list_guest_feedback": feedback.list_guest_feedback,
    "count_feedback_by_type": feedback.count_feedback_by_type,
    "rank_by_keyword": feedback.rank_by_keyword,
    "search_feedback_by_keyword": feedback.search_feedback_by_keyword,
    "get_closed_period_indicators": indicators.get_closed_period_indicators,
    "list_extra_revenue_records": revenue.list_extra_revenue_records,
    "calculate_revenue_share": revenue.calculate_revenue_share,
    "compare_extra_revenue_per_guest": revenue.compare_extra_revenue_per_guest,
    "analyze_item_sales": revenue.analyze_item_sales,
    "list_medical_attendances": infirmary.list_medical_attendances,
    "rank_medical_occurrences": infirmary.rank_medical_occurrences,
    "calculate_attendance_per_guest_index": infirmary.calculate_attendance_per_guest_index,
    "count_attendances_by_patient_type": infirmary.count_attendances_by_patient_type,
    "get_employee_overtime_balance": overtime.get_employee_overtime_balance,
    "get_department_overtime_balance": overtime.get_department_overtime_balance,
    "get_resort_adherence": sentiment.get_resort_adherence,
    "get_department_adherence": sentiment.get_department_adherence,
    "get_survey_status": sentiment.get_survey_status,
    "rank_by_survey_status": sentiment.rank_by_survey_status,
}


def run(name: str, filters: Mapping | None, catalog: Catalog, page: int = 1, limit: int = 50,
        after: str | None = None) -> AnalysisResult:
    """Plan analysis ``name`` for ``filters``; nothing executes until the result is used. ``after``: the ``next`` token of
    the page before (listings and ranked counts)."""
    if name not in REGISTRY:
        raise AnalysisError(f"unknown analysis {name!r}")
    given = dict(filters or {})
    pg = Page(limit=int(limit), number=int(page), after=after)
    result = REGISTRY[name](catalog, given, pg)
    return replace(result, page=result.page or pg, analysis=name, filters=given)


def answer(name: str, filters: Mapping | None, catalog: Catalog, page: int = 1, limit: int = 50, after: str | None = None) -> dict:
    """K6: the response of a request: the envelope, or ``{"error": ...}`` where the request or its data is at fault. Failures
    of Spark itself are raised."""
    try:
        return run(name, filters, catalog, page, limit, after).envelope()
    except AnalysisError as fault:
        return {"error": str(fault)}
