"""Conditions and classes of medicines that users mention, by keywords; JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords in lower case of a whole conversation, in order of the labels.
CHAT_CONDITIONS = {
    "anxiety": ["anxiety", "anxious", "panic", "panic attacks"],
    "insomnia": ["insomnia", "sleep problems", "can't sleep", "trouble sleeping"],
    "hypertension": ["hypertension", "high blood pressure"],
    "diabetes": ["diabetes", "diabetic", "blood sugar"],
    "kidney_disease": ["kidney disease", "ckd", "renal"],
}
CHAT_MEDICINES = {
    "ssri": ["ssri", "prozac", "zoloft", "lexapro", "sertraline", "fluoxetine", "escitalopram", "citalopram"],
    "maoi": ["maoi", "phenelzine", "tranylcypromine", "isocarboxazid"],
    "anticoagulants": ["warfarin", "coumadin", "apixaban", "eliquis", "xarelto", "rivaroxaban", "heparin"],
    "bp_meds": ["lisinopril", "amlodipine", "losartan", "metoprolol", "atenolol", "carvedilol"],
}
# Keywords of one text, in order of the labels.
TEXT_CONDITIONS = {
    "anxiety": ["anxiety", "anxious", "panic", "worry"],
    "depression": ["depression", "depressed", "sad", "mood"],
    "hypertension": ["high blood pressure", "hypertension", "bp"],
    "diabetes": ["diabetes", "diabetic", "blood sugar", "insulin"],
    "insomnia": ["insomnia", "sleep problems", "can't sleep", "trouble sleeping"],
    "heart_disease": ["heart disease", "cardiac", "heart problems"],
    "kidney_disease": ["kidney", "renal", "kidney disease"],
}
TEXT_MEDICINES = {
    "ssri": ["ssri", "antidepressant", "prozac", "zoloft", "lexapro", "citalopram", "sertraline"],
    "maoi": ["maoi", "phenelzine", "tranylcypromine"],
    "anticoagulant": ["blood thinner", "warfarin", "coumadin", "anticoagulant"],
    "bp_med": ["blood pressure medication", "ace inhibitor", "beta blocker", "lisinopril", "metoprolol"],
}


def says(text: Column, words: list[str]) -> Column:
    """Whether any of the keywords is part of the text, in any case; null says nothing."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(words))


def mentioned(text: Column, table: dict[str, list[str]]) -> Column:
    """The labels, in the table's order, whose keywords are part of the text."""
    return F.array_compact(F.array(*[F.when(says(text, words), F.lit(k)) for k, words in table.items()]))


def by_conversation(messages: DataFrame, key: str, text: str, tables: dict[str, dict[str, list[str]]]) -> DataFrame:
    """``key`` and an array of labels for each table, over all messages of a conversation.

    No keyword holds a newline, so a conversation says what any of its messages says: flags
    are combined before the shuffle and no conversation is put together.
    """
    flags = [F.bool_or(says(F.col(text), words)).alias(f"{name}_{k}") for name, table in tables.items() for k, words in table.items()]
    found = messages.groupBy(key).agg(*flags)
    return found.select(key, *[F.array_compact(F.array(*[F.when(F.col(f"{name}_{k}"), F.lit(k)) for k in table])).alias(name) for name, table in tables.items()])
