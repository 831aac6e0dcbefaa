"""Synthetic clinical notes from the orders table: one SQL expression that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notemill.sources.scan import spread


def _pick(key: str, options: list[str]) -> str:
    """A CASE over key modulo the number of options."""
    return f"case {key} % {len(options)} " + " ".join(f"when {i} then '{o}'" for i, o in enumerate(options)) + " end"


def _num(key: str, n: int, low: int) -> str:
    return f"cast({key} % {n} + {low} as varchar(12))"


K, C = "o_orderkey", "o_custkey"
DRUGS = ["metformin", "lisinopril", "aspirin", "atorvastatin", "amoxicillin", "warfarin", "insulin", "rosuvastatin"]
PARTS = [
    "'DATE: '", _pick(K, ["01/15/2024", "2024-03-02", "March 5, 2024", "12 May 2023"]), "chr(10)",
    "'PATIENT: Dr. '", _pick(K, ["John Smith", "Mary Jones", "Ann Lee", "Paul Brown"]), "' MRN: AB'", _num(C, 900000, 100000), "' phone 415-555-'", _num(K, 9000, 1000), "' email user'", _num(K, 50, 1), "'@mail.example.org'", "chr(10)",
    "'CHIEF COMPLAINT:'", "chr(10)", _pick(K, ["Chest pain", "Shortness of breath", "Headache for 3 days", "Routine follow up"]), "'.'", "chr(10)",
    "'HISTORY OF PRESENT ILLNESS:'", "chr(10)", "'A '", _num(K, 75, 25), "' year old patient '", _pick(K, ["denies fever", "reports possible pneumonia", "has hypertension", "with no evidence of heart failure", "may have diabetes mellitus", "admits chest pain"]), "'. '",
    _pick(C, ["Family history of stroke", "History of myocardial infarction", "Suspected COPD", "Ruled out pulmonary embolism", "Biopsy performed 2 weeks ago", "Appendectomy last year"]), "'.'", "chr(10)",
    "'MEDICATIONS:'", "chr(10)", _pick(K, DRUGS), "' '", _pick(C, ["500 mg", "10 mg", "81 mg", "20 units"]), "' '", _pick(K, ["PO BID", "daily", "IV q8h", "po qhs"]), "'. '", _pick(C, DRUGS), "' 5 mg daily.'", "chr(10)",
    "'ALLERGIES:'", "chr(10)", _pick(C, ["Penicillin (severe rash)", "NKDA", "Sulfa causes hives", "No known drug allergies", "Latex"]), "'.'", "chr(10)",
    "'VITAL SIGNS:'", "chr(10)", "'BP: '", _num(K, 120, 80), "'/'", _num(C, 60, 45), "' mmHg, HR: '", _num(K, 130, 40), "' bpm, Temp: '", _pick(K, ["98.6 F", "101.2 F", "37.5 C", "39.9 C"]), "', RR: '", _num(C, 28, 8), "', SpO2: '", _num(K, 18, 83), "'%, Weight: '", _num(C, 90, 45), "' kg, Height: '", _num(K, 50, 150), "' cm, pain score '", _num(K, 11, 0), "'/10.'", "chr(10)",
    "'SOCIAL HISTORY:'", "chr(10)", _pick(K, ["Smokes 1 pack per day", "Denies alcohol use", "Homeless", "Lives with family and exercises regularly", "Unemployed"]), "'.'", "chr(10)",
    "'ASSESSMENT:'", "chr(10)", _pick(C, ["Type 2 diabetes mellitus", "Essential hypertension", "Chronic kidney disease", "Congestive heart failure", "COPD exacerbation", "Acute myocardial infarction", "Pneumonia"]), "'.'", "chr(10)",
    "'PLAN:'", "chr(10)", _pick(K, ["Follow up in 2 weeks", "Schedule MRI", "Urgent cardiology consult", "Continue current medications"]), "'.'",
]
#: Notes that a task makes and reads.
TASK_NOTES = 20_000
SQL = f"select {K} as note_id, {C} as patient_id, " + " || ".join(PARTS) + " as text from orders"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, patient_id, text: a note for each order. Rows are spread before they become texts, which are some fifty times larger."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(K, C), K, TASK_NOTES)
    return spark.sql(SQL.replace(" from orders", " from {orders}").replace("as varchar(12)", "as string"), orders=orders)
