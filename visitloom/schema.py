"""Explicit schemas of the flat sources and of the nested record. Columns beyond these pass through."""

from __future__ import annotations

ENCOUNTER_ID, PERSON_ID = "EncounterId_SH", "PatientEpicId_SH"

#: Flat tables: columns that the engine names; identifiers and codes are always strings.
TABLES = {
    "Person_Table": "person_id string",
    "Encounter_Table": "PatientEpicId_SH string, EncounterId_SH string, PatientType string, PatientClass string, DepartmentKey string, PlaceOfServiceKey string, GroupType string, StartVisit string",
    "Diagnosis_Table": "EncounterId_SH string, Diagnosis_1_Code string, Diagnosis_Name string",
    "Medication_Table": "EncounterId_SH string, MedSimpleGenericName string",
    "Procedure_Table": "EncounterId_SH string, CPT_Procedure_Description string",
    "RXNorm_Table": "MedicationEpicID string, RXNORM_CODE string",
}

#: Child tables: nested list, name field.
CHILDREN = {"diagnoses": "Diagnosis_Name", "medications": "MedSimpleGenericName", "procedures": "CPT_Procedure_Description"}
CATEGORIES = ("diagnoses", "medications", "treatments")

PATIENT = (
    "patient_id string, demographics map<string,string>, encounters array<struct<encounter_id:string, details:struct<StartVisit:string>, "
    "diagnoses:array<struct<Diagnosis_1_Code:string,Diagnosis_Name:string>>, medications:array<struct<MedSimpleGenericName:string>>, "
    "procedures:array<struct<CPT_Procedure_Description:string>>>>"
)
SYNONYM_REPLY = "array<struct<meanings:array<struct<definitions:array<struct<synonyms:array<string>>>>>>>"
PREDICTION = "struct<predicted_visit:struct<diagnoses:array<string>,medications:array<string>,treatments:array<string>>>"
WORD_VECTOR = "word string, vec array<double>"
