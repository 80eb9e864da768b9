"""The SQL face of the model: its tables, views and reports as temp views for ``spark.sql``.

A view is the lazy DataFrame of the operator, so a query over it is planned with the
operator's own plan: filters and column pruning reach the files as usual.
"""

from __future__ import annotations

MODEL_VIEWS = {
    "v_latest_review": "latest_review",
    "v_item_order": "item_order",
    "v_payment_order": "payment_order",
    "v_order_fact": "order_fact",
    "v_delivered_order_fact": "delivered_fact",
}
REPORT_VIEWS = {
    f"r_{name}": name
    for name in (
        "kpi_summary",
        "kpi_extended",
        "delay_impact",
        "state_performance",
        "state_report",
        "category_performance",
        "category_report",
        "priority_categories",
        "repeat_customers",
        "monthly_performance",
        "monthly_report",
        "payment_mix",
        "seller_performance",
        "seller_report",
        "priority_sellers",
        "seller_risk_summary",
        "findings_summary",
        "summary_rows",
    )
}


def register_views(model) -> list[str]:
    """Register the raw tables under their own names, the model views (``v_``) and the
    reports (``r_``) as session temp views; returns their names."""
    frames = dict(model.tables)
    frames |= {view: getattr(model, name)() for view, name in (MODEL_VIEWS | REPORT_VIEWS).items()}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)
