"""Names, codes and weights the results depend on."""

# Taxonomy prefixes of the home-health cohort, and their display names.
COHORT_PREFIXES = ["251E", "253Z", "251J"]
TAXONOMY_TYPES = {
    "251E": "Home Health Agency",
    "253Z": "In Home Supportive Care",
    "251J": "Nursing Care Agency",
}

# Procedure codes of each home-health category.
CATEGORY_CODES = {
    "skilled_nursing": ["G0299", "G0300", "T1030", "T1031", "S9123", "S9124"],
    "aide": ["G0156", "T1020", "T1021", "S9122"],
    "personal_care": ["T1019"],
    "therapy": ["G0151", "G0152", "G0153", "G0157", "G0159", "G0160"],
    "assessment": ["G0155", "G0162", "G0493"],
}
CATEGORIES = list(CATEGORY_CODES)
OTHER_CATEGORY = "non_hh"

# The 23 columns of the general model, and those of them taken as log1p.
MODEL_FEATURES = [
    "total_paid", "total_claims", "total_beneficiaries",
    "num_hcpcs_codes", "num_active_months",
    "paid_per_claim", "claims_per_beneficiary", "paid_per_beneficiary",
    "pct_round_dollar", "pct_round_hundred", "pct_npi_mismatch",
    "revenue_concentration", "monthly_paid_cv", "max_monthly_paid",
    "max_peer_zscore", "mean_peer_zscore",
    "entity_type", "provider_age_years", "is_deactivated", "was_reactivated",
    "is_sole_proprietor", "is_org_subpart", "num_taxonomy_codes",
]
LOG_FEATURES = [
    "total_paid", "total_claims", "total_beneficiaries",
    "paid_per_claim", "paid_per_beneficiary", "max_monthly_paid",
]
FILL_FEATURES = {"revenue_concentration": 1.0}
# The model features less the flags and the entity type: the columns of the feature profile.
PROFILE_FEATURES = [
    name for name in MODEL_FEATURES
    if name not in {"entity_type", "is_deactivated", "was_reactivated", "is_sole_proprietor", "is_org_subpart"}
]

# Weights of the cohort risk score; monthly_paid_cv only counts as a possible extreme.
COHORT_WEIGHTS = {
    "hh_max_peer_zscore": 1.0,
    "hh_mean_peer_zscore": 0.5,
    "nursing_to_aide_ratio": 0.3,
    "claims_per_beneficiary": 0.2,
    "paid_per_beneficiary": 0.2,
    "pct_non_hh": 0.1,
}
COHORT_SCORED = [*COHORT_WEIGHTS, "monthly_paid_cv"]

# Network score: weight per match tier, per percentile-ranked column and per flag.
TIER_WEIGHTS = {1: 3.0, 2: 2.0, 3: 1.5, 4: 0.5}
PERCENTILE_WEIGHTS = {
    "num_deactivated": 1.5,
    "npi_count": 1.0,
    "num_states": 0.8,
    "total_spending": 0.5,
    "same_address_ratio": 0.4,
}
FLAG_WEIGHTS = {
    "has_leie_org_match": 2.0,
    "has_deact_ind_match": 1.5,
    "has_hh_taxonomy": 0.3,
    "temporal_flag": 1.0,
}
TIER_LABELS = {
    1: "Tier 1 (direct NPI match)",
    2: "Tier 2 (name + state + city)",
    3: "Tier 3 (name + state + middle)",
    4: "Tier 4 (name + state only)",
}
NO_NPI = "0000000000"

# Bin edges of the network reports: (lower bound, label), lowest first.
SIZE_BINS = [(1, "1"), (2, "2-4"), (5, "5-9"), (10, "10-19"), (20, "20-49"), (50, "50+")]
SPENDING_TIERS = [
    (None, "< 100K"), (100_000, "100K-1M"), (1_000_000, "1M-10M"),
    (10_000_000, "10M-100M"), (100_000_000, "100M+"),
]

# Column headers of the public files, and the names used here.
SPENDING_COLUMNS = {
    "BILLING_PROVIDER_NPI_NUM": ("billing_npi", "string"),
    "SERVICING_PROVIDER_NPI_NUM": ("servicing_npi", "string"),
    "HCPCS_CODE": ("hcpcs_code", "string"),
    "CLAIM_FROM_MONTH": ("claim_from_month", "date"),
    "TOTAL_UNIQUE_BENEFICIARIES": ("total_unique_beneficiaries", "bigint"),
    "TOTAL_CLAIMS": ("total_claims", "bigint"),
    "TOTAL_PAID": ("total_paid", "double"),
}
NUM_TAXONOMIES = 15
PROVIDER_COLUMNS = {
    "NPI": "npi",
    "Entity Type Code": "entity_type",
    "Provider Enumeration Date": "enumeration_date",
    "NPI Deactivation Date": "deactivation_date",
    "NPI Reactivation Date": "reactivation_date",
    "Is Sole Proprietor": "sole_proprietor",
    "Is Organization Subpart": "org_subpart",
    "Provider Business Practice Location Address State Name": "state",
    **{f"Healthcare Provider Taxonomy Code_{i}": f"taxonomy_{i}" for i in range(1, NUM_TAXONOMIES + 1)},
}
ORGANISATION_COLUMNS = {
    "NPI": "npi",
    "Entity Type Code": "entity_type",
    "Provider Organization Name (Legal Business Name)": "org_name",
    "Provider Other Organization Name": "org_dba",
    "Provider First Line Business Practice Location Address": "address_line1",
    "Provider Business Practice Location Address City Name": "city",
    "Provider Business Practice Location Address State Name": "state",
    "Provider Business Practice Location Address Postal Code": "zip5",
    "Provider Enumeration Date": "enumeration_date",
    "NPI Deactivation Date": "deactivation_date",
    "NPI Reactivation Date": "reactivation_date",
    "Healthcare Provider Taxonomy Code_1": "primary_taxonomy",
    "Is Organization Subpart": "is_subpart",
    "Parent Organization LBN": "parent_org_name",
    "Parent Organization TIN": "parent_org_tin",
    "Authorized Official Last Name": "ao_last",
    "Authorized Official First Name": "ao_first",
    "Authorized Official Middle Name": "ao_middle",
    "Authorized Official Telephone Number": "ao_phone",
}
INDIVIDUAL_COLUMNS = {
    "NPI": "npi",
    "Entity Type Code": "entity_type",
    "Provider Last Name (Legal Name)": "ind_last",
    "Provider First Name": "ind_first",
    "Provider Business Practice Location Address State Name": "ind_state",
    "NPI Deactivation Date": "deactivation_date",
    "Healthcare Provider Taxonomy Code_1": "ind_taxonomy",
}
EXCLUSION_COLUMNS = {
    "LASTNAME": "lastname", "FIRSTNAME": "firstname", "MIDNAME": "midname", "BUSNAME": "busname",
    "NPI": "npi", "CITY": "city", "STATE": "state", "EXCLTYPE": "excltype", "EXCLDATE": "excldate",
}
