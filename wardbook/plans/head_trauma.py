"""The head trauma study as configuration: names, codes, dependencies, rule branches.

Only values live here; the operators know nothing about this table.
"""

from __future__ import annotations

# Raw name, readable name, kind (C multi-level code, B binary code,
# I integer) and the valid codes after cleaning ("-" for any integer), in table order.
COLUMN_TABLE = """
PatNum patient_number I -
EmplType physician_employment_type C 1,2,3,4,5
Certification physician_certification C 1,2,3,4,90
InjuryMech injury_mechanism C 1,2,3,4,5,6,7,8,9,10,11,12,90
High_impact_InjSev injury_mechanism_severity C 1,2,3
Amnesia_verb has_event_amnesia B 0,1,91
LOCSeparate has_loss_of_consciousness_history B 0,1,2
LocLen loss_of_consciousness_duration C 1,2,3,4
Seiz has_posttraumatic_seizure B 0,1
SeizOccur seizure_timing C 1,2,3
SeizLen posttraumatic_seizure_duration C 1,2,3,4
ActNorm acting_normal B 0,1
HA_verb has_headache_at_ED B 0,1,91
HASeverity headache_severity C 1,2,3
HAStart headache_start_time C 1,2,3,4
Vomit has_vomiting_post_injury B 0,1
VomitNbr number_of_vomiting_episodes C 1,2,3
VomitStart vomiting_start_time C 1,2,3,4
VomitLast vomiting_last_time C 1,2,3
Dizzy has_dizziness_at_ED B 0,1
Intubated eval_after_intubation B 0,1
Paralyzed eval_after_paralysis B 0,1
Sedated eval_after_sedated B 0,1
GCSEye gcs_eye_score C 1,2,3,4
GCSVerbal gcs_verbal_score C 1,2,3,4,5
GCSMotor gcs_motor_score C 1,2,3,4,5,6
GCSTotal gcs_total_score I -
GCSGroup gcs_category C 1,2
AMS has_altered_mental_status B 0,1
AMSAgitated ams_agitated B 0,1
AMSSleep ams_sleepy B 0,1
AMSSlow ams_slow_to_respond B 0,1
AMSRepeat ams_repetitive_questions B 0,1
AMSOth ams_other B 0,1
SFxPalp has_palpable_skull_fracture B 0,1,2
SFxPalpDepress skull_fracture_depressed B 0,1
FontBulg has_anterior_fontanelle_bulging B 0,1
SFxBas has_basilar_skull_fracture_signs B 0,1
SFxBasHem has_basilar_hemotympanum B 0,1
SFxBasOto has_basilar_csf_otorrhea B 0,1
SFxBasPer has_basilar_raccoon_eyes B 0,1
SFxBasRet has_basilar_battles_sign B 0,1
SFxBasRhi has_basilar_csf_rhinorrhea B 0,1
Hema has_hematomas_or_swellings B 0,1
HemaLoc hemotomas_or_swellings_location C 1,2,3
HemaSize largest_hemotoma_or_swelling_size C 1,2,3
Clav has_trauma_above_clavicles B 0,1
ClavFace has_trauma_face B 0,1
ClavNeck has_trauma_neck B 0,1
ClavFro has_trauma_scalp_frontal B 0,1
ClavOcc has_trauma_scalp_occipital B 0,1
ClavPar has_trauma_scalp_parietal B 0,1
ClavTem has_trauma_scalp_temporal B 0,1
NeuroD has_neuro_deficit B 0,1
NeuroDMotor has_neuro_deficit_motor B 0,1
NeuroDSensory has_neuro_deficit_sensory B 0,1
NeuroDCranial has_neuro_deficit_cranial_nerve B 0,1
NeuroDReflex has_neuro_deficit_reflexes B 0,1
NeuroDOth has_neuro_deficit_other B 0,1
OSI has_other_substantial_injury_non_head B 0,1
OSIExtremity has_osi_extremity B 0,1
OSICut has_osi_laceration_requiring_operation B 0,1
OSICspine has_osi_cervical_spine B 0,1
OSIFlank has_osi_chest_back_flank B 0,1
OSIAbdomen has_osi_abdominal B 0,1
OSIPelvis has_osi_pelvis B 0,1
OSIOth has_osi_other B 0,1
Drugs clinical_suspicion_of_intoxication B 0,1
CTForm1 ct_head_imaging_ordered B 0,1
IndAge ct_primary_indication_young_age B 0,1
IndAmnesia ct_primary_indication_amnesia B 0,1
IndAMS ct_primary_indication_altered_mental_status B 0,1
IndClinSFx ct_primary_indication_skull_fracture B 0,1
IndHA ct_primary_indication_headache B 0,1
IndHema ct_primary_indication_scalp_hematoma B 0,1
IndLOC ct_primary_indication_loss_of_consciousness B 0,1
IndMech ct_primary_indication_injury_mechanism B 0,1
IndNeuroD ct_primary_indication_neuro_deficit B 0,1
IndRqstMD ct_primary_indication_md_request B 0,1
IndRqstParent ct_primary_indication_parental_request B 0,1
IndRqstTrauma ct_primary_indication_trauma_team_request B 0,1
IndSeiz ct_primary_indication_seizure B 0,1
IndVomit ct_primary_indication_vomiting B 0,1
IndXraySFx ct_primary_indication_skull_fracture_on_xray B 0,1
IndOth ct_primary_indication_other B 0,1
CTSed ct_sedation_given B 0,1
CTSedAgitate ct_sedation_reason_agitation B 0,1
CTSedAge ct_sedation_reason_young_age B 0,1
CTSedRqst ct_sedation_reason_technician_request B 0,1
CTSedOth ct_sedation_reason_other B 0,1
AgeInMonth patient_age_months I -
AgeinYears patient_age_years I -
AgeTwoPlus patient_age_under_2yr C 1,2
Gender patient_gender C 1,2
Ethnicity patient_ethnicity C 1,2
Race patient_race C 1,2,3,4,5,90
Observed ed_observation_for_ct_decision B 0,1
EDDisposition ed_discharge_status C 1,2,3,4,5,6,7,8,90
CTDone head_ct_performed B 0,1
EDCT head_ct_performed_in_ed B 0,1
PosCT ct_shows_tbi B 0,1
Finding1 ct_finding_cerebellar_hemorrhage B 0,1
Finding2 ct_finding_cerebral_contusion B 0,1
Finding3 ct_finding_cerebral_edema B 0,1
Finding4 ct_finding_cerebral_hemorrhage B 0,1
Finding5 ct_finding_skull_diastasis B 0,1
Finding6 ct_finding_epidural_hematoma B 0,1
Finding7 ct_finding_extra_axial_hematoma B 0,1
Finding8 ct_finding_intraventricular_hemorrhage B 0,1
Finding9 ct_finding_midline_shift B 0,1
Finding10 ct_finding_pneumocephalus B 0,1
Finding11 ct_finding_skull_fracture B 0,1
Finding12 ct_finding_subarachnoid_hemorrhage B 0,1
Finding13 ct_finding_subdural_hematoma B 0,1
Finding14 ct_finding_traumatic_infarction B 0,1
Finding20 ct_extra_finding_diffuse_axonal_injury B 0,1
Finding21 ct_extra_finding_herniation B 0,1
Finding22 ct_extra_finding_shear_injury B 0,1
Finding23 ct_extra_finding_sigmoid_sinus_thrombosis B 0,1
DeathTBI death_due_to_tbi B 0,1
HospHead hospitalized_2plus_nights_head_injury B 0,1
HospHeadPosCT hospitalized_2plus_nights_with_positive_ct B 0,1
Intub24Head intubated_24plus_hours_head_trauma B 0,1
Neurosurgery neurosurgery_performed B 0,1
PosIntFinal has_clinically_important_tbi B 0,1
"""

_ROWS = [line.split() for line in COLUMN_TABLE.split("\n") if line]

NAME_MAPPING = {raw: name for raw, name, _, _ in _ROWS}
COLUMN_KINDS = {name: kind for _, name, kind, _ in _ROWS}
VALID_CODES = {name: [int(c) for c in codes.split(",")] for _, name, _, codes in _ROWS if codes != "-"}
COLUMN_TYPES = {name: "int" for name in COLUMN_KINDS} | {"patient_number": "bigint"}
FINDING_COLUMNS = [c for c in COLUMN_KINDS if c.startswith(("ct_finding_", "ct_extra_finding_"))]


def _starting(*prefixes: str, but: tuple = ()) -> list[str]:
    return [c for c in COLUMN_KINDS if c.startswith(prefixes) and c not in but]


# Which detail columns belong to which parent column. A detail
# must be null or 0 where its parent is 0 or null.
DEPENDENTS = {
    "has_loss_of_consciousness_history": ["loss_of_consciousness_duration"],
    "has_posttraumatic_seizure": ["seizure_timing", "posttraumatic_seizure_duration"],
    "has_headache_at_ED": _starting("headache_"),
    "has_vomiting_post_injury": ["number_of_vomiting_episodes", "vomiting_start_time", "vomiting_last_time"],
    "has_altered_mental_status": _starting("ams_"),
    "has_palpable_skull_fracture": ["skull_fracture_depressed"],
    "has_basilar_skull_fracture_signs": _starting("has_basilar_", but=("has_basilar_skull_fracture_signs",)),
    "has_hematomas_or_swellings": ["hemotomas_or_swellings_location", "largest_hemotoma_or_swelling_size"],
    "has_trauma_above_clavicles": ["has_trauma_face", "has_trauma_neck"] + _starting("has_trauma_scalp_"),
    "has_neuro_deficit": _starting("has_neuro_deficit_"),
    "has_other_substantial_injury_non_head": _starting("has_osi_"),
    "ct_head_imaging_ordered": _starting("ct_primary_indication_"),
    "ct_sedation_given": _starting("ct_sedation_reason_"),
}

# Further parents looked at while exploring, too strict to be kept as rules.
EXPLORED_DEPENDENTS = DEPENDENTS | {
    "head_ct_performed": ["ct_shows_tbi"],
    "head_ct_performed_in_ed": ["ct_shows_tbi"],
    "ct_shows_tbi": FINDING_COLUMNS,
    "has_clinically_important_tbi": ["death_due_to_tbi"],
}

GCS_PARTS = ["gcs_eye_score", "gcs_verbal_score", "gcs_motor_score"]
GCS_TOTAL = "gcs_total_score"
OUTCOME = "has_clinically_important_tbi"
PRIMARY_FLAG = "in_primary_analysis"
MAX_AGE_MONTHS = 215

# Fixed values: (column, recorded value, corrected value, change of the total).
GCS_SNAPS = [
    ("gcs_eye_score", 5, 4, -1),
    ("gcs_verbal_score", 0, 1, 1),
    ("gcs_verbal_score", 6, 5, -1),
]

# Fixed values: (lowest total, highest total, category), None for an open end.
GCS_CATEGORIES = [(None, 13, 1), (14, None, 2)]

# Columns in which 0 is not a possible value: every multi-level code, the identifier and months.
ZERO_IS_INVALID = [c for c, kind in COLUMN_KINDS.items() if kind == "C"] + ["patient_number", "patient_age_months"]

# Code labels.
MECHANISM_LABELS = {
    1: "Motor vehicle crash", 2: "Bike (no motor)", 3: "Bike (motor)", 4: "Pedestrian vs vehicle",
    5: "Fall < 3 feet", 6: "Sports/recreation", 7: "Struck by object", 8: "Fall from elevation",
    9: "Non-accidental trauma", 10: "Unknown", 11: "Object struck head", 12: "Assault", 90: "Other",
}
GENDER_LABELS = {1: "Male", 2: "Female"}
ETHNICITY_LABELS = {1: "Hispanic", 2: "Non-Hispanic"}
RACE_LABELS = {1: "White", 2: "Black", 3: "Asian", 4: "Native American", 5: "Pacific Islander", 90: "Other"}
LOC_DURATION_LABELS = {1: "<5 seconds", 2: "5-60 seconds", 3: "1-5 minutes", 4: ">5 minutes"}

# Age groups, as right-closed edges with labels and as left-closed bands.
AGE_EDGES, AGE_LABELS = [-1, 0, 2, 5, 12, 17], ["<1yr", "1-2yr", "3-5yr", "6-12yr", "13-17yr"]
BROAD_AGE_EDGES, BROAD_AGE_LABELS = [-1, 5, 12, 17], ["0-5 years", "6-12 years", "13-17 years"]
LIFE_STAGES = [(0, 1, "Infants"), (1, 3, "Toddlers"), (3, 6, "Preschool"), (6, 13, "School Age"), (13, 18, "Adolescents")]
RISK_BANDS = [(0, 2, "<2yr"), (2, 6, "2-5yr"), (6, 13, "6-12yr"), (13, 18, "13-17yr")]
RATE_TIERS, RATE_TIER_DEFAULT = [(3.0, "high"), (1.5, "medium")], "low"
BAR_TIERS, BAR_TIER_DEFAULT = [(2.0, "high"), (1.0, "medium")], "low"

# Predictor flag -> the (column, codes) that switch it on; missing means off.
PREDICTOR_FLAGS = {
    "cdr_ams": [("has_altered_mental_status", [1])],
    "cdr_loc_any": [("has_loss_of_consciousness_history", [1, 2])],
    "cdr_loc_over5s": [("loss_of_consciousness_duration", [2, 3, 4])],
    "cdr_palpable_skull_fx": [("has_palpable_skull_fracture", [1, 2])],
    "cdr_basilar_skull_fx": [("has_basilar_skull_fracture_signs", [1])],
    "cdr_scalp_hematoma_nonfrontal": [
        ("has_trauma_scalp_occipital", [1]),
        ("has_trauma_scalp_parietal", [1]),
        ("has_trauma_scalp_temporal", [1]),
    ],
    "cdr_not_acting_normally": [("acting_normal", [0])],
    "cdr_severe_headache": [("headache_severity", [3])],
    "cdr_vomiting": [("has_vomiting_post_injury", [1])],
    "cdr_severe_mechanism": [("injury_mechanism_severity", [3])],
}
AGE_GROUP = "patient_age_under_2yr"
AGE_FLAG = {"is_under_2": [(AGE_GROUP, [1])]}
MODEL_FEATURES = [*PREDICTOR_FLAGS, *AGE_FLAG]

# Age group -> tests of the decision rule in the order they are asked.
RULE_BRANCHES = {
    1: [
        ("gcs_category", 1), ("cdr_ams", 1), ("cdr_palpable_skull_fx", 1),
        ("cdr_scalp_hematoma_nonfrontal", 1), ("cdr_loc_over5s", 1),
        ("cdr_severe_mechanism", 1), ("cdr_not_acting_normally", 1),
    ],
    2: [
        ("gcs_category", 1), ("cdr_ams", 1), ("cdr_basilar_skull_fx", 1), ("cdr_loc_any", 1),
        ("cdr_vomiting", 1), ("cdr_severe_mechanism", 1), ("cdr_severe_headache", 1),
    ],
}

# The probability cut of the forest.
FOREST_THRESHOLD = 0.27

# Metric, published lower and upper bound.
PUBLISHED_BOUNDS = [
    ("primary population", 42412.0, 42412.0, 20.0),
    ("outcome rate", 0.9, 0.9, 0.05),
    ("outcome rate, under 2", 0.86, 1.13, 0.0),
    ("outcome rate, 2 and older", 0.85, 0.98, 0.0),
    ("neurosurgery count", 60.0, 60.0, 0.0),
    ("total 15 rate", 97.0, 97.0, 0.5),
    ("under 2 share", 25.0, 25.0, 0.5),
    ("CT rate", 35.3, 35.3, 0.05),
    ("palpable fracture rate, under 2", 3.4, 3.4, 0.05),
    ("palpable fracture rate, 2 and older", 2.1, 2.1, 0.05),
    ("vomiting rate", 12.9, 15.0, 0.0),
    ("altered mental status rate", 11.6, 13.7, 0.0),
]
