"""Prompts as column expressions. Their wording is fixed, since models answer to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts of the prompts.
NARRATIVE = ("Here is a patient's medical visit history. Summarize their journey so far in 2–4 readable sentences. "
             "Mention key conditions, medications, or treatments if relevant.\n\n")
RELEVANCE = ("You are an expert in medical narratives. Rate the relevance of the following two patient narratives on a scale from 0 to 9, "
             "where 0 means completely irrelevant and 9 means highly relevant.\n\n")
SYSTEM = "You are a helpful medical assistant. Only return structured responses."
NO_NEIGHBORS = "No neighbor data was available for this patient."
PREDICTION = """You are a medical expert generating a prediction for a patient's next visit.

    [Patient History]
    {history}

    [Similar Patient Cases (Neighbors)]
    {neighbors}

    [Instruction]
    Based on the patient's history and the histories of similar patients, predict the diagnoses, medications, and treatments for the patient's NEXT clinical visit.
    Return the prediction as a structured JSON object.

    [Output Format Example]
    ```json
    {
    "predicted_visit": {
        "diagnoses": ["Example Diagnosis"],
        "medications": ["Example Medication"],
        "treatments": ["Example Treatment"]
    }
    }"""


def narrative(sentences: Column, visits: int) -> Column:
    """The prompt for a summary of the first ``visits`` visits."""
    blocks = F.transform(F.slice(sentences, 1, visits), lambda s, i: F.concat(F.lit("\nVisit "), i.cast("string"), F.lit(":\n"), s, F.lit("\n")))
    return F.concat(F.lit(NARRATIVE), F.array_join(blocks, ""))


def relevance(patient: Column, neighbor: Column) -> Column:
    return F.concat(F.lit(RELEVANCE + "Patient Narrative:\n"), patient, F.lit("\n\nNeighbor Narrative:\n"), neighbor, F.lit("\n\nRelevance Score (0-9):"))


def neighbor_block(neighbor_id: Column, text: Column) -> Column:
    return F.concat(F.lit("[Neighbor: "), neighbor_id, F.lit("]\n"), text)


def prediction(history: Column, neighbors: Column) -> Column:
    """``neighbors``: the blocks of an array; without any, a fixed sentence stands there."""
    joined = F.when(F.size(F.coalesce(neighbors, F.array().cast("array<string>"))) > 0, F.array_join(neighbors, "\n\n")).otherwise(F.lit(NO_NEIGHBORS))
    first, rest = PREDICTION.split("{history}")
    middle, last = rest.split("{neighbors}")
    return F.concat(F.lit(first), history, F.lit(middle), joined, F.lit(last))


def with_pathway(text: Column, diagnosis: Column, pathway: Column) -> Column:
    """A narrative with the pathway of its key diagnosis, where both are known."""
    more = F.concat(F.lit("The primary diagnosis, "), diagnosis, F.lit(", is associated with the "), pathway, F.lit("."))
    return F.concat_ws(" ", text, more)
