"""Domain configuration: everything the operators need that is not logic.

The operators take these objects as arguments, so another domain (another
taxonomy, other needs, other aliases) is a different instance, not other code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# Record schema
# --------------------------------------------------------------------------

# Columns of the record, claim, gap and mirror tables, in order (fixed values).
TEXT_FIELDS = (
    "record_id", "record_type", "entity_name", "state", "district", "city", "pincode",
    "facility_type", "operator_type", "phone", "website", "description", "office_type", "delivery",
)
INDICATORS = (
    "households_surveyed", "institutional_birth_pct", "stunting_pct", "anaemia_pct",
    "improved_water_pct", "improved_sanitation_pct", "health_insurance_pct",
)
RECORD_FIELDS = (
    "record_id", "record_type", "entity_name", "state", "district", "city", "pincode",
    "latitude", "longitude", "facility_type", "operator_type", "phone", "website",
    "description", "office_type", "delivery", *INDICATORS,
)
RECORD_TYPES = ("facility", "pincode", "district")

CLAIM_FIELDS = (
    "facility_id", "facility_name", "state", "district_or_city", "district_source", "capability",
    "claim_status", "confidence", "evidence_text", "uncertainty_reason", "extraction_method", "updated_at",
)
GAP_FIELDS = (
    "district_id", "district_name", "state", "care_need", "planning_priority_score", "risk_score",
    "supply_score", "evidence_score", "data_quality_score", "relevant_claims", "strong_claims",
    "partial_claims", "pincode_inferred_claims", "city_fallback_claims", "uncertainty_label",
    "explanation", "updated_at",
)
MIRROR_FIELDS = (
    "facility_id", "facility_name", "facility_type", "operator_type", "source_city", "analysis_state",
    "analysis_district", "source_pincode", "phone", "website", "latitude", "longitude", "description",
    "pincode_match_status", "district_match_status", "district_source", "location_confidence",
    "source_quality_flags", "analysis_location_key", *INDICATORS,
)

# Column names each logical input field may carry, first hit wins (fixed values).
FACILITY_COLUMNS = {
    "id": ("unique_id", "facility_id", "id", "uuid", "place_id", "source_id"),
    "name": ("entity_name", "facility_name", "hospital_name", "clinic_name", "name", "title"),
    "state": ("state", "state_name", "statename", "address_stateOrRegion"),
    "district": ("district", "district_name", "districtname"),
    "city": ("city", "town", "village", "locality", "subdistrict", "address_city"),
    "pincode": ("pincode", "pin_code", "postal_code", "postcode", "pin", "address_zipOrPostcode"),
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon", "lng"),
    "facility_type": ("facility_type", "facilityTypeId", "type", "category", "amenity"),
    "operator_type": ("operator_type", "operatorTypeId", "ownership", "owner_type", "operator"),
    "phone": ("phone", "officialPhone", "phone_numbers", "telephone", "mobile", "contact", "contact_number"),
    "website": ("website", "officialWebsite", "websites", "url", "web_url", "site"),
    "description": ("description", "about", "overview", "summary"),
    "services": ("services", "specialities", "specialties", "departments"),
    "rebuild_id": ("record_id", "facility_id", "unique_id", "id", "uuid", "place_id", "source_id"),
}
DIRECTORY_COLUMNS = {
    "pincode": ("pincode", "pin_code", "postal_code", "postcode", "pin"),
    "state": ("state", "state_name", "statename"),
    "district": ("district", "district_name", "districtname"),
    "office_name": ("entity_name", "office_name", "officename", "post_office", "name"),
    "office_type": ("office_type", "officetype"),
    "delivery": ("delivery", "delivery_status", "deliverystatus"),
    "circle_name": ("circle", "circle_name", "circlename"),
    "region_name": ("region", "region_name", "regionname"),
    "division_name": ("division", "division_name", "divisionname"),
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon", "lng"),
}
DISTRICT_COLUMNS = {
    "district": ("district", "district_name", "districtname", "entity_name"),
    "state": ("state", "state_name", "statename", "state_ut"),
    "households_surveyed": ("households_surveyed", "sample_households", "households"),
    "institutional_birth_pct": (
        "institutional_birth_pct", "institutional_births_pct", "institutional_delivery_pct",
        "institutional_birth_5y_pct",
    ),
    "stunting_pct": ("stunting_pct", "children_stunted_pct", "child_u5_who_are_stunted_height_for_age_18_pct"),
    "anaemia_pct": ("anaemia_pct", "anemia_pct", "women_anaemia_pct", "all_w15_49_who_are_anaemic_pct"),
    "improved_water_pct": ("improved_water_pct", "improved_drinking_water_pct", "hh_improved_water_pct"),
    "improved_sanitation_pct": ("improved_sanitation_pct", "sanitation_pct", "hh_use_improved_sanitation_pct"),
    "health_insurance_pct": (
        "health_insurance_pct", "covered_by_health_insurance_pct", "hh_member_covered_health_insurance_pct",
    ),
}

# Table discovery: (column names after lower-casing and dropping punctuation, weight) (fixed values).
DISCOVERY_WEIGHTS = {
    "facility": (
        (("name", "facilityname", "hospitalname"), 6),
        (("description", "about", "services", "specialities", "specialties"), 3),
        (("latitude", "lat", "longitude", "lon", "lng", "website", "phone"), 1),
    ),
    "pincode": (
        (("pincode", "pin", "postalcode"), 5),
        (("officename", "officetype", "delivery", "circle", "region", "division"), 3),
    ),
    "district": (
        (("district", "districtname", "state", "statename"), 3),
        (("stuntingpct", "anaemiapct", "anemiapct", "institutionalbirthpct", "improvedwaterpct"), 5),
    ),
}

# --------------------------------------------------------------------------
# Places
# --------------------------------------------------------------------------

# Canonical state labels (fixed values).
STATES = (
    "Andaman & Nicobar Islands", "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chandigarh",
    "Chhattisgarh", "Dadra & Nagar Haveli and Daman & Diu", "Delhi", "Goa", "Gujarat", "Haryana",
    "Himachal Pradesh", "Jammu & Kashmir", "Jharkhand", "Karnataka", "Kerala", "Ladakh", "Lakshadweep",
    "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Puducherry",
    "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand",
    "West Bengal",
)

# Other spellings of a state, by name key (fixed values).
STATE_SPELLINGS = {
    "andaman and nicobar islands": "Andaman & Nicobar Islands",
    "andaman nicobar": "Andaman & Nicobar Islands",
    "andaman nicobar islands": "Andaman & Nicobar Islands",
    "chattisgarh": "Chhattisgarh",
    "chhatisgarh": "Chhattisgarh",
    "daman diu": "Dadra & Nagar Haveli and Daman & Diu",
    "dadra and nagar haveli and daman and diu": "Dadra & Nagar Haveli and Daman & Diu",
    "dadra and nagar haveli daman and diu": "Dadra & Nagar Haveli and Daman & Diu",
    "dadra and nagar haveli": "Dadra & Nagar Haveli and Daman & Diu",
    "dadra nagar haveli": "Dadra & Nagar Haveli and Daman & Diu",
    "dadra nagar haveli daman diu": "Dadra & Nagar Haveli and Daman & Diu",
    "jammu and kashmir": "Jammu & Kashmir",
    "maharastra": "Maharashtra",
    "nct delhi": "Delhi",
    "nct of delhi": "Delhi",
    "new delhi": "Delhi",
    "orissa": "Odisha",
    "pondicherry": "Puducherry",
    "tamilnadu": "Tamil Nadu",
    "u p": "Uttar Pradesh",
    "up": "Uttar Pradesh",
    "uttaranchal": "Uttarakhand",
}


def plain_key(label: str) -> str:
    """Driver-side twin of ``functions.text.name_key`` for configuration keys."""
    return " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in label.lower()).split())


STATE_ALIASES = {plain_key(s): s for s in STATES} | STATE_SPELLINGS

# District name key -> district label of the indicator survey, per state (fixed values).
DISTRICT_ALIASES = {
    "Andhra Pradesh": {
        "eluru": "West Godavari", "anakapalli": "Visakhapatnam", "annamayya": "Y.S.R.",
        "bhimavaram": "West Godavari", "kakinada": "East Godavari", "madanapalle": "Chittoor",
        "nandyal": "Kurnool", "ntr": "Krishna", "palnadu": "Guntur", "rajamahendravaram": "East Godavari",
        "spsr nellore": "Sri Potti Sriramulu Nello", "sri sathya sai": "Anantapur", "tirupati": "Chittoor",
        "vijayawada": "Krishna", "visakhapatanam": "Visakhapatnam", "visakhatapanam": "Visakhapatnam",
    },
    "Assam": {"kamrup metro": "Kamrup Metropolitan", "marigaon": "Morigaon"},
    "Bihar": {"purbi champaran": "Purba Champaran"},
    "Chhattisgarh": {"kabirdham": "Kabeerdham", "kawardha": "Kabeerdham"},
    "Delhi": {"delhi": "New Delhi"},
    "Gujarat": {"ahmedabad": "Ahmadabad", "arvalli": "Aravali", "kabilpore": "Navsari"},
    "Haryana": {"gurugram": "Gurgaon"},
    "Jammu & Kashmir": {"budgam": "Badgam"},
    "Jharkhand": {
        "east singhbhum": "Purbi Singhbhum", "east singhbum": "Purbi Singhbhum", "jamshedpur": "Purbi Singhbhum",
    },
    "Karnataka": {
        "ballari": "Bellary", "belagavi": "Belgaum", "bengaluru": "Bangalore",
        "bengaluru rural": "Bangalore Rural", "bengaluru urban": "Bangalore", "davangere": "Davanagere",
        "kalaburagi": "Gulbarga", "mysuru": "Mysore", "shivamogga": "Shimoga", "tumakuru": "Tumkur",
        "vemagal": "Kolar", "vijaynagar": "Bellary", "vijayapura": "Bijapur", "hubballi": "Dharwad",
    },
    "Kerala": {"kuttippuram": "Malappuram", "muvattupuzha": "Ernakulam"},
    "Madhya Pradesh": {
        "east nimar": "Khandwa (East Nimar)", "khargone": "Khargone (West Nimar)",
        "narsinghpur": "Narsimhapur", "napier town": "Jabalpur",
    },
    "Maharashtra": {
        "ahmednagar": "Ahmadnagar", "beed": "Bid", "buldhana": "Buldana", "gondia": "Gondiya",
        "kurla": "Mumbai Suburban", "raigad": "Raigarh", "sawangi": "Wardha", "ulhasnagar": "Thane",
        "goregaon west": "Mumbai Suburban",
    },
    "Meghalaya": {"ri bhoi": "Ribhoi"},
    "Puducherry": {"pondicherry": "Puducherry"},
    "Punjab": {
        "firozepur": "Firozpur", "malerkotla": "Sangrur", "s a s nagar": "Sahibzada Ajit Singh Nagar",
        "sas nagar": "Sahibzada Ajit Singh Nagar", "sri muktsar sahib": "Muktsar", "urmar tanda": "Hoshiarpur",
    },
    "Rajasthan": {"jalore": "Jalor", "jhunjhunu": "Jhunjhunun", "chittorgarh": "Chittaurgarh"},
    "Tamil Nadu": {
        "chengalpattu": "Kancheepuram", "aminjikarai chennai": "Chennai", "kallakurichi": "Viluppuram",
        "kanchipuram": "Kancheepuram", "ranipet": "Vellore", "tenkasi": "Tirunelveli",
        "tirupathur": "Vellore", "tuticorin": "Thoothukkudi",
    },
    "Telangana": {"hanumakonda": "Warangal Urban", "moinabad": "Ranga Reddy"},
    "Uttar Pradesh": {
        "ayodhya": "Faizabad", "bhadohi": "Sant Ravidas Nagar (Bhadohi)", "greater noida": "Gautam Buddha Nagar",
        "hathras": "Mahamaya Nagar", "kushi nagar": "Kushinagar", "maharajganj": "Mahrajganj",
        "amroha": "Jyotiba Phule Nagar", "prayagraj": "Allahabad", "siddhar nagar": "Siddharthnagar",
        "siddharth nagar": "Siddharthnagar",
    },
    "Uttarakhand": {"haridwar": "Hardwar", "udam singh nagar": "Udham Singh Nagar"},
    "West Bengal": {
        "24 paraganas north": "North Twenty Four Pargana", "24 paraganas south": "South Twenty Four Pargana",
        "24 parganas north": "North Twenty Four Pargana", "24 parganas south": "South Twenty Four Pargana",
        "coochbehar": "Koch Bihar", "barddhaman": "Paschim Barddhaman", "darjeeling": "Darjiling",
        "dinajpur uttar": "Uttar Dinajpur", "hooghly": "Hugli", "howrah": "Haora",
        "medinipur west": "Paschim Medinipur", "paschim bardhaman": "Paschim Barddhaman",
        "purba bardhaman": "Paschim Barddhaman", "purulia": "Puruliya",
    },
}


@dataclass(frozen=True)
class Places:
    """Alias tables used to bring place names to one spelling."""

    states: dict = field(default_factory=lambda: STATE_ALIASES)
    districts: dict = field(default_factory=lambda: DISTRICT_ALIASES)

    @property
    def canonical_states(self) -> tuple[str, ...]:
        return tuple(sorted(set(self.states.values())))


PLACES = Places()

# --------------------------------------------------------------------------
# Categories
# --------------------------------------------------------------------------

# Ordered (regex, label) rules on the lower-cased text; no hit keeps the text (fixed values).
FACILITY_TYPE_RULES = (
    ("hospital|medical college|nursing home", "hospital"),
    ("dental|dentist", "dentist"),
    ("doctor|physician", "doctor"),
    ("pharmacy|farmacy", "pharmacy"),
    ("clinic|centre|center|lab|diagnostic", "clinic"),
)
OPERATOR_TYPE_RULES = (
    ("government|govt|public", "public"),
    ("private|trust|charitable|ngo", "private"),
)
# Values the sources are expected to hold, and values the record table may hold (fixed values).
EXPECTED_FACILITY_TYPES = (
    "hospital", "clinic", "dentist", "doctor", "pharmacy", "farmacy", "nursing_home", "medical college",
)
EXPECTED_OPERATOR_TYPES = ("private", "public", "government", "trust", "charitable", "ngo")
VALID_FACILITY_TYPES = ("", "hospital", "clinic", "dentist", "doctor", "pharmacy", "farmacy", "nursing_home", "null")
VALID_OPERATOR_TYPES = ("", "private", "public", "government", "null")

# Sentences of the facility profile: label of an indicator -> its column (fixed values).
PROFILE_RATES = {
    "Institutional birth rate": "institutional_birth_pct", "Child stunting": "stunting_pct", "Anaemia": "anaemia_pct",
    "Health insurance coverage": "health_insurance_pct",
}

# Location provenance -> confidence of the location (fixed values).
LOCATION_CONFIDENCE = {"source_district": 1.0, "pincode_inferred": 0.85, "city_fallback": 0.45}

# --------------------------------------------------------------------------
# Capability taxonomy
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Capability:
    """Something a facility may claim. Patterns are tried in order; the first that hits is cited."""

    key: str
    label: str
    strong: tuple[str, ...]
    partial: tuple[str, ...] = ()


# Capability patterns (fixed values).
CAPABILITIES = (
    Capability(
        "c_section", "C-section",
        strong=(r"\bc[- ]?section\b", r"\bcaesarean\b", r"\bcesarean\b", r"\blscs\b", r"\blower segment caesarean\b"),
        partial=(r"\bobstetric", r"\bobgyn\b", r"\bgynaec", r"\blabou?r room\b", r"\bdelivery room\b"),
    ),
    Capability(
        "obgyn", "OBGYN",
        strong=(r"\bobgyn\b", r"\bobstetric", r"\bgynaec", r"\bgynec", r"\bgynae\b", r"\bmaternity\b"),
        partial=(r"\bwomen'?s health\b", r"\bantenatal\b", r"\bdelivery\b", r"\bmother and child\b", r"\breproductive"),
    ),
    Capability(
        "nicu", "NICU",
        strong=(r"\bnicu\b", r"\bneonatal intensive care\b", r"\bsncu\b", r"\bspecial newborn care\b"),
        partial=(
            r"\bneonatal\b", r"\bnewborn\b", r"\bpaediatric intensive\b", r"\bpediatric intensive\b",
            r"\bpaediatric\b", r"\bpediatric\b",
        ),
    ),
    Capability(
        "blood_bank", "Blood bank",
        strong=(r"\bblood bank\b", r"\bblood storage\b", r"\bblood transfusion\b", r"\bblood storage unit\b"),
        partial=(r"\bblood component\b", r"\bblood centre\b", r"\bblood center\b"),
    ),
    Capability(
        "ambulance", "Ambulance",
        strong=(r"\bambulance\b", r"\bemergency transport\b", r"\bpatient transport\b", r"\b108 ambulance\b"),
    ),
    Capability(
        "emergency_24x7", "24x7 emergency",
        strong=(
            r"\b24\s*[x/]\s*7\b.*\bemergency\b", r"\bemergency\b.*\b24\s*[x/]\s*7\b",
            r"\b24\s*hour\b.*\bemergency\b", r"\bemergency\b.*\b24\s*hour\b",
        ),
        partial=(r"\bemergency\b", r"\btrauma\b", r"\bcasualty\b", r"\baccident\b", r"\bemergency department\b"),
    ),
    Capability(
        "icu", "ICU",
        strong=(r"\bicu\b", r"\bintensive care\b", r"\bintensive care unit\b", r"\bccu\b"),
        partial=(r"\bcritical care\b", r"\bhigh dependency\b", r"\bhdu\b", r"\bcardiac care\b"),
    ),
    Capability(
        "ventilator", "Ventilator",
        strong=(r"\bventilator", r"\bventilation support\b", r"\bmechanical ventilation\b"),
        partial=(r"\boxygen\b", r"\blife support\b", r"\brespiratory support\b"),
    ),
    Capability(
        "dialysis", "Dialysis",
        strong=(r"\bdialysis\b", r"\bhemodialysis\b", r"\bhaemodialysis\b", r"\bdialysis unit\b"),
        partial=(r"\bnephrology\b", r"\brenal\b", r"\bkidney\b"),
    ),
)

# Facility type -> capabilities it hints at (fixed values).
TYPE_HINTS = {"hospital": ("emergency_24x7",), "nursing_home": ("obgyn",)}


@dataclass(frozen=True)
class Taxonomy:
    capabilities: tuple[Capability, ...]
    hints: dict = field(default_factory=dict)
    method: str = "deterministic_regex_v1"
    hint_method: str = "facility_type_hint_v1"
    strong_reason: str = "Explicit capability term found in facility description."
    partial_reason: str = "Related term found, but capability is not stated explicitly."
    hint_reason: str = "Weak facility-type hint only; capability is not stated in the source description."
    window: int = 90

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(c.key for c in self.capabilities)


TAXONOMY = Taxonomy(CAPABILITIES, TYPE_HINTS)

# --------------------------------------------------------------------------
# Scoring
# --------------------------------------------------------------------------

# Weights of a claim by confidence and by location provenance (fixed values).
CONFIDENCE_WEIGHT = {"strong": "1.00", "partial": "0.45", "weak": "0.20", "missing": "0.00", "conflicting": "0.10"}
SOURCE_WEIGHT = {"source_district": "1.00", "pincode_inferred": "0.85", "city_fallback": "0.45", "missing_location": "0.00"}
UNKNOWN_SOURCE_WEIGHT = "0.30"

# Facility types counted per location: output column -> facility_type (fixed values).
FACILITY_COUNTS = {"hospitals": "hospital", "clinics": "clinic", "doctors": "doctor", "nursing_homes": "nursing_home"}


@dataclass(frozen=True)
class Need:
    """Scoring model of one need.

    ``risk``: (indicator, weight, gap) where gap means ``100 - indicator``.
    ``floor``: (cap, slope, facility-count columns) terms, summed and capped at ``floor_cap``.
    """

    key: str
    risk: tuple[tuple[str, float, bool], ...]
    supply: dict
    core: tuple[str, ...] = ()
    floor: tuple[tuple[float, float, tuple[str, ...]], ...] = ((20.0, 0.5, ("total_facilities",)),)
    floor_cap: float = 20.0
    missing_core_penalty: float = 8.0

    @property
    def capabilities(self) -> tuple[str, ...]:
        return tuple(self.supply)


def generic_need(key: str, capabilities: tuple[str, ...]) -> Need:
    """Model of a need nobody tuned: equal risk terms, one plain presence term."""
    return Need(
        key,
        risk=(("anaemia_pct", 1.0, False), ("stunting_pct", 1.0, False), ("institutional_birth_pct", 1.0, True)),
        supply={c: 1.0 for c in capabilities},
    )


# Need models (fixed values).
NEEDS = (
    Need(
        "maternal_emergency",
        risk=(("anaemia_pct", 0.45, False), ("institutional_birth_pct", 0.40, True), ("stunting_pct", 0.15, False)),
        supply={
            "c_section": 1.35, "obgyn": 1.1, "blood_bank": 1.2, "nicu": 0.95, "emergency_24x7": 0.65, "ambulance": 0.45,
        },
        core=("c_section", "obgyn", "blood_bank"),
        floor=(
            (8.0, 0.6, ("total_facilities",)), (10.0, 2.5, ("hospitals",)), (10.0, 3.0, ("nursing_homes",)),
            (4.0, 0.4, ("clinics", "doctors")),
        ),
        floor_cap=24.0,
    ),
    Need(
        "critical_care",
        risk=(
            ("health_insurance_pct", 0.35, True), ("improved_sanitation_pct", 0.20, True),
            ("improved_water_pct", 0.15, True), ("anaemia_pct", 0.15, False), ("stunting_pct", 0.15, False),
        ),
        supply={"icu": 1.45, "ventilator": 1.35, "emergency_24x7": 0.85, "ambulance": 0.45},
        core=("icu", "ventilator"),
        floor=((10.0, 0.7, ("total_facilities",)), (22.0, 4.0, ("hospitals",)), (5.0, 1.0, ("nursing_homes",))),
        floor_cap=32.0,
    ),
    Need(
        "dialysis_access",
        risk=(
            ("health_insurance_pct", 0.45, True), ("anaemia_pct", 0.25, False),
            ("improved_water_pct", 0.15, True), ("improved_sanitation_pct", 0.15, True),
        ),
        supply={"dialysis": 1.85, "icu": 0.25, "emergency_24x7": 0.2},
        core=("dialysis",),
        floor=((3.0, 0.15, ("total_facilities",)), (4.0, 0.7, ("hospitals",)), (1.0, 0.2, ("nursing_homes",))),
        floor_cap=7.0,
        missing_core_penalty=12.0,
    ),
)

# Score thresholds of the priority bands, highest first (fixed values).
PRIORITY_BANDS = ((70.0, "High"), (45.0, "Medium"))
PRIORITY_DEFAULT = "Watch"

# Words that say nothing about which facility a name means (fixed values).
NAME_STOPWORDS = (
    "and", "the", "of", "in", "at", "for", "near", "road", "west", "east", "north", "south", "clinic",
    "hospital", "medical", "health", "care", "centre", "center", "dental", "doctor", "dr",
)

# Indicator columns of the fixed source schema (fixed values).
STRICT_INDICATORS = {
    "households_surveyed": "households_surveyed",
    "institutional_birth_pct": "institutional_birth_5y_pct",
    "stunting_pct": "child_u5_who_are_stunted_height_for_age_18_pct",
    "anaemia_pct": "all_w15_49_who_are_anaemic_pct",
    "improved_water_pct": "hh_improved_water_pct",
    "improved_sanitation_pct": "hh_use_improved_sanitation_pct",
    "health_insurance_pct": "hh_member_covered_health_insurance_pct",
}
