"""Explicit schemas of the evaluation item files, per task family.

Ids such as ``image_id`` stay strings (``007`` must not become ``7``).  Files
whose columns are spelled differently are read with ``evaluate(rename=...)``,
a mapping from the file's names to these.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L = T.StringType(), T.IntegerType(), T.LongType()
AS, AI = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SELECTION_ITEM = _struct(
    ("image_id", S), ("image", AS), ("image_url", AS), ("object", S), ("correct_ids", AI), ("uncorrect_ids", AI),
    ("correct_terms", AS), ("correct_ids_with_term", AS), ("uncorrect_ids_with_term", AS), ("all_ids_with_term", AS))

GENERATION_ITEM = _struct(("image_id", S), ("image", AS), ("image_url", AS), ("object", S), ("terms", AS))

PAIR_RATING_ITEM = _struct(
    ("id", L), ("object_id", L), ("object_term_id", L), ("object", S), ("term", S), ("naturalness", I),
    ("naturalness_str", S), ("naturalness_by_worker", AI))

YES_NO_ITEM = _struct(("id", L), ("term", S), ("label", I), ("label_str", S))

CHOICE_ITEM = _struct(
    ("id", L), ("correct_ids", AI), ("uncorrect_ids", AI), ("correct_terms", AS), ("uncorrect_terms", AS),
    ("correct_ids_with_term", AS), ("uncorrect_ids_with_term", AS), ("all_ids_with_term", AS))

# Item schema per (task, sub_task).
ITEM_SCHEMAS = {
    ("perception", "selection"): SELECTION_ITEM,
    ("perception", "generation"): GENERATION_ITEM,
    ("commonsense", "generation"): GENERATION_ITEM,
    ("commonsense", "classification"): PAIR_RATING_ITEM,
    ("taxonomic", "yes_no_classification"): YES_NO_ITEM,
    ("taxonomic", "a_b_classification"): CHOICE_ITEM,
    ("taxonomic", "multiple_choice_classification"): CHOICE_ITEM,
}
