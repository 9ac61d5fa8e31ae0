"""Oracle SQL: the audit again, written from the rules' wording for another engine."""

from __future__ import annotations

from packlens.functions.vocab import INSTITUTION_WORDS
from packlens.plans.synth import listing_sql

PNC, NMR, UTV, NA, PASS = "'POTENTIAL_NON_COMPLIANCE'", "'NEEDS_MANUAL_REVIEW'", "'UNABLE_TO_VERIFY'", "'NOT_APPLICABLE'", "'PASS'"

LST = f"lst AS ({listing_sql()})"

#: one row per inspection: best value and confidence per field, online and image sides, evidence
CTX = f"""{LST},
base AS (SELECT *, has_page AND fetch_status = 'SUCCESS' AS pg, CAST(ocr_conf AS DOUBLE) AS oc FROM lst),
f AS (SELECT *, CASE WHEN pg THEN title END AS name, CASE WHEN pg THEN replace(mrp_text, 'Rs. ', '') END AS on_mrp, CASE WHEN pg THEN qty_text END AS on_qty,
        CASE WHEN pg THEN country_text END AS on_country, CASE WHEN pg THEN maker_text END AS maker, CASE WHEN pg THEN maker_addr END AS maddr,
        CASE WHEN pg THEN importer_text END AS importer, CASE WHEN pg THEN importer_addr END AS iaddr, CASE WHEN pg THEN care_name END AS cname,
        CASE WHEN pg THEN care_phone END AS cphone, CASE WHEN pg THEN care_email END AS cmail, CASE WHEN pg THEN mfg_text END AS mfg,
        CASE WHEN pg THEN best_text END AS bb, CASE WHEN pg THEN unit_text END AS usp FROM base),
g AS (SELECT *, CASE WHEN on_mrp IS NULL OR (ocr_mrp IS NOT NULL AND oc > 0.85) THEN ocr_mrp ELSE on_mrp END AS mrp,
        CASE WHEN on_mrp IS NULL OR (ocr_mrp IS NOT NULL AND oc > 0.85) THEN oc ELSE 0.85 END AS mrp_c,
        CASE WHEN on_qty IS NULL OR (ocr_qty IS NOT NULL AND oc > 0.85) THEN ocr_qty ELSE on_qty END AS qty,
        CASE WHEN on_qty IS NULL OR (ocr_qty IS NOT NULL AND oc > 0.85) THEN oc ELSE 0.85 END AS qty_c,
        CASE WHEN on_country IS NULL OR (ocr_country IS NOT NULL AND oc > 0.8) THEN ocr_country ELSE on_country END AS country,
        CASE WHEN on_country IS NULL OR (ocr_country IS NOT NULL AND oc > 0.8) THEN oc ELSE 0.8 END AS country_c,
        (CASE WHEN name IS NULL THEN 0 ELSE 1 END + CASE WHEN on_mrp IS NULL THEN 0 ELSE 1 END + CASE WHEN on_qty IS NULL THEN 0 ELSE 1 END
         + CASE WHEN on_country IS NULL THEN 0 ELSE 1 END + CASE WHEN maker IS NULL THEN 0 ELSE 2 END + CASE WHEN importer IS NULL THEN 0 ELSE 2 END
         + CASE WHEN cname IS NULL THEN 0 ELSE 3 END + CASE WHEN mfg IS NULL THEN 0 ELSE 1 END + CASE WHEN bb IS NULL THEN 0 ELSE 1 END
         + CASE WHEN usp IS NULL THEN 0 ELSE 1 END) AS nf FROM f),
ctx AS (SELECT *, pg AND nf > 1 AS usable, (pg AND nf > 1) OR n_images > 0 AS suff,
        ((CASE WHEN pg AND nf > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN n_images > 0 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END)
          + (CASE WHEN n_images > 0 THEN oc ELSE 0.5::DOUBLE END)) / 3 AS q,
        CASE WHEN importer IS NOT NULL THEN 'IMPORTED' WHEN (has_page OR n_images > 0) AND maker IS NOT NULL THEN 'DOMESTIC' ELSE 'UNKNOWN' END AS origin,
        CASE k % 6 WHEN 0 THEN 'FOOD' WHEN 1 THEN 'COSMETIC_PERSONAL_CARE' WHEN 2 THEN 'HOUSEHOLD' WHEN 3 THEN 'FOOD' ELSE 'UNKNOWN' END AS category,
        CAST(split_part(qty, ' ', 1) AS DOUBLE) * CASE WHEN split_part(qty, ' ', 2) = 'kg' THEN 1000 ELSE 1 END AS amount FROM g)"""

#: Rule 3: packages for institutions and those above 50 kg or 25 l are exempt, whatever their category.
EXEMPT = f"(regexp_matches(lower(url || ' ' || title), '{'|'.join(INSTITUTION_WORDS)}') OR coalesce(amount > CASE WHEN split_part(qty, ' ', 2) = 'ml' THEN 25000 ELSE 50000 END, FALSE))"
ABS_S = f"CASE WHEN NOT suff THEN {UTV} WHEN q < 0.5 THEN {NMR} ELSE {PNC} END"
ABS_C = "CASE WHEN NOT suff THEN 0.3 WHEN q < 0.5 THEN 0.5 + 0.3 * (1 - q) ELSE 0.55 + 0.35 * q END"
ABSENT = (ABS_S, ABS_C)


def _rule(key: str, severity: str, cases: list[tuple[str, str, str]], other: tuple[str, str], gated: bool = True, food: str = "") -> str:
    first = [(EXEMPT, NA, "0.7")] if gated else []
    if food == "excluded":
        first.append(("category = 'FOOD'", NA, "0.9"))
    if food == "only":
        first.append(("category <> 'FOOD'", NA, "0.85"))
    if gated:
        first.append(("coalesce(amount <= 10 AND title NOT LIKE '%tobacco%', FALSE)", NA, "0.7"))
    every = [*first, *cases]
    status = "CASE " + " ".join(f"WHEN {c} THEN {s}" for c, s, _ in every) + f" ELSE {other[0]} END" if every else other[0]
    conf = "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, _, x in every) + f" ELSE {other[1]} END" if every else other[1]
    return f"SELECT inspection_id, k, batch_id, '{key}' AS rule_key, '{severity}' AS severity, {status} AS status, floor(CAST({conf} AS DOUBLE) * 100 + 0.5) / 100 AS confidence FROM ctx"


def _same(side_a: str, side_b: str, conf: str, equal: str) -> tuple[list[tuple[str, str, str]], tuple[str, str]]:
    c = f"least({conf}, oc)"
    return [(f"{side_a} IS NULL OR {side_b} IS NULL", UTV, "0.3"), (equal, PASS, c)], (PNC, c)


def checks_sql() -> str:
    none = [("TRUE", UTV, "0.3")]
    maker = [("maker IS NOT NULL", PASS, "0.55"), ("importer IS NOT NULL", PASS, "0.55")]
    no_ev = [("NOT suff", UTV, "0.3")]
    date_low = [("NOT suff", UTV, "0.3"), ("q < 0.5", NMR, "0.55")]
    amount = lambda s: f"CAST(split_part({s}, ' ', 1) AS DOUBLE) * CASE WHEN split_part({s}, ' ', 2) = 'kg' THEN 1000 ELSE 1 END"
    mrp, qty, ctry = _same("on_mrp", "ocr_mrp", "0.85", "on_mrp = ocr_mrp"), _same("on_qty", "ocr_qty", "0.85", f"{amount('on_qty')} = {amount('ocr_qty')}"), _same("on_country", "ocr_country", "0.8", "on_country = ocr_country")
    shown = "name IS NOT NULL AND on_qty IS NOT NULL AND on_mrp IS NOT NULL AND (maker IS NOT NULL OR importer IS NOT NULL) AND cname IS NOT NULL"
    rules = [
        _rule("R6-1A-MFR-NAME", "MAJOR", maker, ABSENT, food="excluded"),
        _rule("R6-1AA-COUNTRY-ORIGIN", "MAJOR", [("origin = 'UNKNOWN'", UTV, "0.3"), ("origin = 'DOMESTIC'", NA, "0.6"), ("country IS NOT NULL", PASS, "country_c")], ABSENT),
        _rule("R6-1B-GENERIC-NAME", "MINOR", [("name IS NOT NULL", PASS, "0.6")], ABSENT),
        _rule("R6-1C-NET-QUANTITY", "CRITICAL", [("qty IS NOT NULL", PASS, "qty_c")], ABSENT, gated=False),
        _rule("R6-1D-MFG-DATE", "MINOR", [("mfg IS NOT NULL", PASS, "0.7"), *date_low], (NMR, "0.55")),
        _rule("R6-1DA-BEST-BEFORE", "MAJOR", [("bb IS NOT NULL", PASS, "0.7"), *date_low], (PNC, "0.55"), food="only"),
        _rule("R6-1E-MRP", "CRITICAL", [("mrp IS NOT NULL", PASS, "mrp_c")], ABSENT),
        _rule("R6-2-CONSUMER-CARE", "MAJOR", [], ABSENT),
        _rule("R6-10-ECOMMERCE-DISPLAY", "CRITICAL", [("NOT has_page", NA, "0.9"), (shown, PASS, "0.85")], ABSENT),
        _rule("R6-11-UNIT-SALE-PRICE", "MINOR", [("coalesce(usp = mrp, FALSE)", PASS, "0.75"), *no_ev], (NMR, "0.5")),
        _rule("R9-MANNER", "MINOR", no_ev, (NMR, "0.5")),
        _rule("R10-NAME-ADDR-FORM", "MAJOR", [("maker IS NULL AND importer IS NULL", *ABSENT), ("maker IS NOT NULL", PASS, "0.55")], (NMR, "0.5"), food="excluded"),
        _rule("R11-QTY-BASIS", "MINOR", [("qty IS NULL", UTV, "0.3")], (PASS, "qty_c")),
        _rule("R31-ADVERTISEMENT-NET-QTY", "MINOR", [("NOT has_page", NA, "0.85"), ("mrp IS NULL", NA, "0.6"), ("qty IS NULL", *ABSENT)], (NMR, "0.55")),
        _rule("R26-EXEMPT-FAST-FOOD", "MINOR", [], (NA, "0.6")),
        _rule("R26-EXEMPT-DRUG-FORMULATIONS", "MINOR", no_ev, (NA, "0.6")),
        _rule("R26-EXEMPT-THREAD-COIL", "MINOR", no_ev, (NA, "0.6")),
        _rule("CONSISTENCY-MRP", "MAJOR", *mrp),
        _rule("CONSISTENCY-NET-QUANTITY", "MAJOR", *qty),
        _rule("CONSISTENCY-PRODUCT-NAME", "MINOR", none, (UTV, "0.3")),
        _rule("CONSISTENCY-MANUFACTURER", "MAJOR", none, (UTV, "0.3")),
        _rule("CONSISTENCY-IMPORTER", "MAJOR", none, (UTV, "0.3")),
        _rule("CONSISTENCY-COUNTRY-ORIGIN", "MAJOR", *ctry),
    ]
    return f"{CTX},\nchecks AS ({' UNION ALL '.join(rules)})"


CHECKS = checks_sql()
RANK = f"CASE status WHEN {PNC} THEN 0 WHEN {NMR} THEN 1 WHEN {UTV} THEN 2 WHEN {PASS} THEN 3 ELSE 4 END"
OVERALL = f"{CHECKS}, overall AS (SELECT inspection_id, batch_id, k, CASE min({RANK}) WHEN 0 THEN {PNC} WHEN 1 THEN {NMR} WHEN 2 THEN {UTV} WHEN 3 THEN {PASS} ELSE {UTV} END AS overall_status FROM checks GROUP BY ALL)"
