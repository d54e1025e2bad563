"""Fixed values. They must stay equal to the published study tables for results to agree."""

from __future__ import annotations

# --- fixed values: codes ------------------------------------------------------------------------
REMOTE_MODIFIERS = ("95", "GT", "93", "FQ", "FR")
REMOTE_PLACE_OF_SERVICE = "2"
HOSPITAL_AND_EMERGENCY_CODES = (
    "99221", "99222", "99223", "99231", "99232", "99233", "99234", "99235", "99236", "99238", "99239",
    "G0316", "99281", "99282", "99283", "99284", "99285",
)
REDACTED = "[REDACTED]"
GARBAGE_CAUSE = "_gc"
UNMAPPED = "Unmapped"
COVID_CAUSE = "lri_corona"
COVID_NAME = "COVID-19"
COVID_NAME_PATTERN = "Coronavirus|coronavirus|COVID-19"
COVID_EMPIRICAL_CODES = ("U07100", "U07101", "U0710", "U07103", "U07104")
MENTAL_FAMILY = "fam_mental"

# --- fixed values: demographics -----------------------------------------------------------------
RACE_CODES = {"1002-5": "aian", "2028-9": "aapi", "2076-8": "aapi", "2054-5": "black", "2106-3": "white"}
ETHNICITY_CODES = {"H": 1, "N": 0}
RACE_GROUP_NOT_HISPANIC = {"aian": "aian", "aapi": "aapi", "black": "bnh", "white": "wnh"}
GROUPS = ("aian", "aapi", "bnh", "wnh", "hispanic")
GROUP_LABELS = {"aian": "AI/AN", "aapi": "AAPI", "bnh": "Black", "wnh": "White", "hispanic": "Hispanic"}
ASIAN_LANGUAGES = ("bod", "hin", "hmn", "ind", "jpn", "khm", "kor", "nep", "pan", "tgl", "tha", "urd", "vie", "zho")

# --- fixed values: thresholds -------------------------------------------------------------------
RURAL_PERCENT = 25
POVERTY_PERCENT = 15
SMALL_NETWORK_PATIENT_DAYS = 1300
MORE_WHITE_SHARE = 0.75
RURAL_BAND_EDGES = (5.3, 27.4, 39.0)
RURAL_BAND_LABELS = ("Most urban", "Part urban", "Part rural", "Most rural")

# --- fixed values: policy windows in run months (1 = first study month, both ends inclusive) ------
POLICY_ALWAYS = ("AR", "CO", "DE", "HI", "KY", "MN", "NJ", "NM", "VA")
POLICY_WINDOWS = {
    "GA": (13, None),
    "AZ": (16, None), "CA": (16, None), "CT": (16, None), "IL": (16, None), "IA": (16, None),
    "MA": (16, None), "NH": (16, None), "RI": (16, None), "VT": (16, None), "WA": (16, None),
    "MT": (16, 25),
    "TN": (20, 39),
    "OR": (30, None),
    "MD": (31, None),
    "NV": (34, None),
    "OK": (37, None),
    "NY": (40, None),
}
POLICY_WAVE = ("AZ", "CA", "CT", "IL", "IA", "MA", "MT", "NH", "RI", "VT", "WA")
GROUP_NEVER = "Never"
GROUP_BEFORE = "Parity before 2019"
GROUP_WAVE = "Parity from April 2020"
GROUP_OTHER = "Parity another date"
GROUP_EARLY_OR_WAVE = "Parity at or before April 2020"
POLICY_START_LABELS = {
    "GA": "Jan 2020", "TN": "Aug 2020", "OR": "June 2021", "MD": "July 2021", "NV": "Oct 2021",
    "OK": "Jan 2022", "NY": "Apr 2022",
}

# --- fixed values: mandate stringency by state --------------------------------------------------
STRINGENCY = {
    "AL": 0.33, "AR": 0.39, "AZ": 0.70, "CA": 0.95, "CO": 0.65, "CT": 0.73, "DE": 0.55, "FL": 0.22,
    "GA": 0.29, "IA": 0.24, "ID": 0.27, "IL": 0.81, "IN": 0.41, "KS": 0.24, "KY": 0.54, "LA": 0.48,
    "MA": 0.75, "MD": 0.48, "ME": 0.71, "MI": 0.73, "MN": 0.61, "MO": 0.15, "MS": 0.39, "MT": 0.28,
    "NC": 0.67, "NE": 0.20, "NH": 0.41, "NJ": 0.52, "NM": 0.86, "NY": 0.63, "OH": 0.51, "OK": 0.08,
    "OR": 0.83, "PA": 0.57, "PR": 0.50, "RI": 0.62, "SC": 0.29, "TN": 0.25, "TX": 0.47, "UT": 0.35,
    "VA": 0.52, "WA": 1.01, "WV": 0.51, "WY": 0.38,
}

# --- fixed values: regions ----------------------------------------------------------------------
REGIONS = {
    "Northeast": ("ME", "VT", "NH", "MA", "CT", "RI", "NY", "NJ", "PA", "MD", "DE"),
    "Midwest": ("MI", "OH", "IN", "IL", "WI", "MN", "IA", "MO", "ND", "SD", "NE", "KS"),
    "South": ("VA", "WV", "KY", "TN", "NC", "SC", "GA", "FL", "AL", "MS", "AR", "LA", "OK", "TX", "PR"),
    "West": ("MT", "WY", "CO", "NM", "AZ", "NV", "UT", "ID", "WA", "OR", "CA", "AK", "HI"),
}
STATES_WITHOUT_NETWORKS = ("AK", "NV", "ND", "SD", "WI", "VT", "HI", "DC")

# --- fixed values: order of cause families ------------------------------------------------------
FAMILY_ORDER = (
    "Neonatal disorders",
    "Neglected tropical diseases and malaria",
    "HIV/AIDS and sexually transmitted infections",
    "Enteric infections",
    "Other infectious diseases",
    "Nutritional deficiencies",
    "Maternal disorders",
    "Respiratory infections and tuberculosis",
    "COVID-19",
    "Congenital birth defects",
    "Hemoglobinopathies and hemolytic anemias",
    "Substance use disorders",
    "Kidney diseases",
    "Oral disorders",
    "Urinary diseases and male infertility",
    "Neoplasms",
    "Gynecological diseases",
    "Endocrine, metabolic, blood, and immune disorders",
    "Sense organ diseases",
    "Digestive diseases",
    "Skin and subcutaneous diseases",
    "Cardiovascular diseases",
    "Neurological disorders",
    "Diabetes",
    "Chronic respiratory diseases",
    "Musculoskeletal disorders",
    "Mental disorders",
    "Injuries",
    "Tobacco intervention",
    "Treatment of obesity",
    "Treatment of hyperlipidemia",
    "Well causes",
    "Treatment of hypertension",
    "Unmapped",
    "Garbage code",
)
FAMILY_REGROUP = {
    "Unmapped": "Unassigned",
    "Garbage code": "Unassigned",
    "Well causes": "Well visits",
    "Neglected tropical diseases and malaria": "Non-respiratory infectious diseases",
    "HIV/AIDS and sexually transmitted infections": "Non-respiratory infectious diseases",
    "Enteric infections": "Non-respiratory infectious diseases",
    "Other infectious diseases": "Non-respiratory infectious diseases",
}
SELECTED_FAMILIES = ("COVID-19", "Mental disorders", "Substance use disorders")
