"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import languages, licenses, mixing, near_dups, neighbours, outliers, packing, quality_model, secrets, urls

QUERIES = {
    "op1_quality_model": quality_model.op1_quality_model,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_nearest": neighbours.op3_nearest,
    "op4_packing": packing.op4_packing,
    "op5_quality_rules": outliers.op5_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_url_filter": urls.op8_url_filter,
    "op9_near_dups": near_dups.op9_near_dups,
    "op10_language_id": languages.op10_language_id,
}
SQL = {"op2_secret_scan": secrets.SQL, "op6_mixing": mixing.SQL, "op8_url_filter": urls.SQL}
