"""Fixed schemas of the raw hospital tables and of the mapping tables."""

from __future__ import annotations

# Columns and types, as Spark DDL.
RAW = {
    "patients": "subject_id bigint, sex string, anchor_age string",
    "admissions": (
        "subject_id bigint, hadm_id string, edregtime timestamp, edouttime timestamp, admittime timestamp, dischtime timestamp, "
        "deathtime timestamp, admission_type string, discharge_location string, marital_status string, insurance string, "
        "nationality string, hospital_expire_flag int, icu_expire_flag int"
    ),
    "icustays": "subject_id bigint, hadm_id string, stay_id string, intime timestamp, outtime timestamp, los double",
    "d_icd_diagnoses": "icd_code string, icd_version int, long_title string",
    "diagnoses_icd": "subject_id bigint, hadm_id string, seq_num int, icd_code string",
    "procedures_icd": "subject_id bigint, hadm_id string, seq_num int, icd_code string, icd_version int",
    "transfers": "subject_id bigint, hadm_id string, eventtype string, careunit string, intime timestamp, outtime timestamp",
    "emar": (
        "subject_id bigint, hadm_id string, stay_id string, emar_type string, charttime string, medication string, event_txt string, "
        "emar_id string, emar_seq int, pharmacy_id string, itemid bigint"
    ),
    "emar_detail": (
        "subject_id bigint, hadm_id string, stay_id string, emar_id string, itemid bigint, emar_seq int, pharmacy_id string, "
        "note_txt string, infusion_rate_hr string, infusion_rate_min string"
    ),
    "chartevents": (
        "subject_id bigint, hadm_id string, stay_id string, charttime timestamp, itemid bigint, value string, valuenum double, valueuom string"
    ),
    "labevents": (
        "subject_id bigint, hadm_id string, stay_id string, itemid bigint, charttime timestamp, value string, valuenum double, valueuom string"
    ),
    "outputevents": "subject_id bigint, hadm_id string, icustay_id string, charttime timestamp, itemid bigint, value string, valueuom string",
    "inputevents": (
        "subject_id bigint, hadm_id string, icustay_id string, starttime timestamp, endtime timestamp, itemid bigint, amount string, "
        "amountuom string, patientweight double"
    ),
    "procedureevents": (
        "subject_id bigint, hadm_id string, stay_id string, starttime timestamp, endtime timestamp, itemid bigint, patientweight double"
    ),
    "d_items": "itemid bigint, label string, linksto string",
    "d_labitems": "itemid bigint, label string",
}

# Folder of each table below the data root; all others are under 'hosp'.
FOLDERS = {t: "icu" for t in ("icustays", "chartevents", "outputevents", "inputevents", "procedureevents", "d_items")}

# Type of the key columns.
KEY_TYPES = {"subject_id": "bigint", "hadm_id": "string", "stay_id": "string"}
