"""Ordered rules that sort disclosures into categories: one CASE, no Python on the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import form_symbol

# Form symbols and keywords of the disclosure categories.
BY_FORM = {
    "CORP_INSIDER_HOLDINGS": ("ת076", "ת077", "ת078"),
    "MGMT_OFFICER_CHANGE": ("ת094", "ת091", "ת093", "ת097", "ת304", "ת306"),
    "FIN_CAPITAL_STRUCTURE": ("ת081", "ת085", "ת086", "ת087", "ת310", "ת880"),
    "FIN_FINANCIAL_REPORTS": ("ת126", "ת930"),
    "CORP_ADMIN_UPDATE": ("ת100", "ת101"),
    "CANDIDATE_CREDIT_RATING": ("ד125", "ת125"),
    "CANDIDATE_INTEREST_PAYMENTS": ("ת089",),
    "NEW_CANDIDATE_BOND_TRUSTEE_CHANGE": ("א121",),
}
KEYWORD_FORMS = ("ת121", "ת053")
KEYWORDS = {
    "CORP_INVESTOR_RELATIONS": ("מצגת משקיעים", "שיחת ועידה", "מועד פרסום דוחות", "כנס משקיעים", "Zoom"),
    "CORP_MATERIAL_EVENTS": ("תובענה ייצוגית", "פסק דין", "הסכם מהותי", "זכייה במכרז", "אישור רגולטורי"),
    "CORP_HOLDER_MEETINGS": ("אסיפה כללית", "סדר יום", "כתב הצבעה"),
    "CANDIDATE_PROSPECTUS_ISSUANCE": ("תשקיף מדף", "הצעה פרטית"),
    "FIN_CAPITAL_STRUCTURE": ("דיבידנד", "מניות רדומות", "רכישה עצמית"),
}
MISC = "CORP_MISC_UPDATE"


def category(form_type: Column, event_ids: Column, text: Column) -> Column:
    """Category of a document (CLS1). Event ids are a comma string, compared exactly, without trimming.

    Rules fall through where their keywords do not occur; nulls count as empty.
    """
    form, text = F.coalesce(form_type, F.lit("")), F.coalesce(text, F.lit(""))
    events = F.split(F.coalesce(event_ids, F.lit("")), ",")
    has = lambda name: F.exists(F.array(*map(F.lit, KEYWORDS[name])), lambda k: F.contains(text, k))
    event = lambda e: F.array_contains(events, e)
    out = F.when(F.lit(False), F.lit(MISC))
    for name, forms in BY_FORM.items():
        out = out.when(form.isin(*forms), name)
    told = form.isin(*KEYWORD_FORMS) | event("201")
    return (
        out.when(told & has("CORP_INVESTOR_RELATIONS"), "CORP_INVESTOR_RELATIONS")
        .when(told & has("CORP_MATERIAL_EVENTS"), "CORP_MATERIAL_EVENTS")
        .when(event("602") & has("CORP_HOLDER_MEETINGS"), "CORP_HOLDER_MEETINGS")
        .when(event("602"), "MGMT_OFFICER_CHANGE")
        .when(event("707") & has("CANDIDATE_PROSPECTUS_ISSUANCE"), "CANDIDATE_PROSPECTUS_ISSUANCE")
        .when(event("707") & has("FIN_CAPITAL_STRUCTURE"), "FIN_CAPITAL_STRUCTURE")
        .otherwise(MISC)
    )


def classified(docs: DataFrame, form_col: str = "form_type", events_col: str = "eventIds", text_col: str = "text") -> DataFrame:
    """Adds form_type (repaired from the text where it is null, not where it is ''), category_handle and classification_status (CLS2)."""
    form = F.coalesce(F.col(form_col), form_symbol(F.col(text_col)))
    out = docs.withColumn(form_col, form)
    found = F.coalesce(F.col(form_col), F.lit("")) != ""
    handle = F.when(found, category(F.col(form_col), F.col(events_col), F.col(text_col)))
    out = out.withColumn("_handle", handle)
    status = F.when(~found, "Error: Form symbol not found.").when(F.col("_handle") == MISC, f"Fallback: {MISC}")
    return out.withColumn("classification_status", status).withColumn("category_handle", F.when(status.isNull(), F.col("_handle"))).drop("_handle")


def routed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classified, not classified) rows (SET7)."""
    return df.where("classification_status is null"), df.where("classification_status is not null")
