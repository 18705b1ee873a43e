"""Prompt rendering (C1-C12) as column expressions.

Templates are plain strings with ``{name}`` slots.  ``render`` turns one into
a ``concat`` of literals and columns when the plan is built, so Catalyst folds
the literals and the projection stays in whole-stage codegen.  The template
texts below are this package's own wording; pass your own to reproduce a
particular benchmark's instructions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.constants import RANDOM_SUB_SUBTASK

_SLOT = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")

# Default templates (parameters, not fixed values).
TEMPLATES = {
    "generation": "Object: {object}\nDescribe the material and surface qualities this object suggests.",
    "selection": "Object: {object}\nOptions: {choices}\nAnswer: ",
    "pair_rating_en": ("Object: {object}\nWord: {term}\nIs this combination natural?\n"
                       "1. natural  2. somewhat natural  3. somewhat unnatural  4. unnatural  5. not a quality word\n"
                       "Answer: "),
    "pair_rating_ja": ("対象: {object}\n語: {term}\nこの組み合わせは自然ですか。\n"
                       "1. 自然  2. やや自然  3. やや不自然  4. 不自然  5. 物の性質を表す語ではない\n回答: "),
    "yes_no": "Word: {term}\nDoes this word describe a material quality? Reply yes or no.\nAnswer: ",
    "a_b": "Which option describes a material quality?\n{choices}\nAnswer: ",
    "multi_choice": "Which option describes a material quality? {choices}\nAnswer: ",
}

SYSTEM_TEXTS = {
    "selection": "Pick the option that best fits the object. Reply with the option number only.",
    "selection_random": ("Pick the option that best fits the object. Reply with the option number only; "
                         "reply -1 when no option fits."),
    "generation": "List words for the qualities the object suggests.",
    "pair_rating": "Rate how natural the pairing of object and word is. Reply with the option number only.",
    "yes_no": "Reply yes or no.",
    "a_b": "Reply with A or B only.",
    "multi_choice": "Reply with the option number only.",
}


# What differs for Japanese runs.
JA_TEMPLATES = {
    "generation": "対象: {object}\nこの対象から感じられる素材や表面の性質を述べてください。",
    "selection": "対象: {object}\n選択肢: {choices}\n回答: ",
    "yes_no": "語: {term}\nこの語は物の質感を表しますか。yes か no で答えてください。\n回答: ",
    "a_b": "質感を表すのはどちらですか。\n{choices}\n回答: ",
    "multi_choice": "質感を表すのはどれですか。 {choices}\n回答: ",
}

JA_SYSTEM_TEXTS = {
    "selection": "対象に最も合う選択肢を選び、その番号だけを答えてください。",
    "selection_random": "対象に最も合う選択肢を選び、その番号だけを答えてください。合うものがなければ -1 と答えてください。",
    "generation": "対象から感じられる性質を表す語を挙げてください。",
    "pair_rating": "対象と語の組み合わせがどれほど自然かを評価し、選択肢の番号だけを答えてください。",
    "yes_no": "yes か no で答えてください。",
    "a_b": "A か B だけで答えてください。",
    "multi_choice": "選択肢の番号だけを答えてください。",
}


def templates(lang: str) -> dict[str, str]:
    """Prompt templates of a language."""
    return {**TEMPLATES, **(JA_TEMPLATES if lang == "ja" else {})}


def system_texts(lang: str) -> dict[str, str]:
    """Instruction texts of a language."""
    return {**SYSTEM_TEXTS, **(JA_SYSTEM_TEXTS if lang == "ja" else {})}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a template into ("lit", text) and ("slot", name) parts."""
    out: list[tuple[str, str]] = []
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            out.append(("lit", template[pos:m.start()]))
        out.append(("slot", m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append(("lit", template[pos:]))
    return out


def render(template: str, **slots: Column | str) -> Column:
    """Fill ``{name}`` slots with columns; a null slot gives a null prompt."""
    parts = []
    for kind, val in template_parts(template):
        if kind == "lit":
            parts.append(F.lit(val))
        else:
            if val not in slots:
                raise KeyError(f"template slot {{{val}}} has no column")
            parts.append(_col(slots[val]).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def choice_text(choices: Column | str, sep: str = ", ") -> Column:
    """Join the choice list (C1).  ``array_join`` would silently skip a null
    element where the harness raised, so a null element fails the query."""
    c = _col(choices)
    has_null = F.exists(c, lambda x: x.isNull())
    return F.when(has_null, F.raise_error(F.lit("null element in choice list"))).otherwise(F.array_join(c, sep))


def prompt_generation(obj: Column | str, template: str = TEMPLATES["generation"]) -> Column:
    return render(template, object=obj)  # C2


def prompt_selection(obj: Column | str, choices: Column | str, template: str = TEMPLATES["selection"]) -> Column:
    return render(template, object=obj, choices=choice_text(choices))  # C3


def prompt_pair_rating(obj: Column | str, term: Column | str, lang: Column | str,
                       templates: Mapping[str, str] | None = None) -> Column:
    """Template chosen per row by language (C4)."""
    templates = templates or {"en": TEMPLATES["pair_rating_en"], "ja": TEMPLATES["pair_rating_ja"]}
    lang_c = _col(lang)
    expr = None
    for code, tpl in templates.items():
        r = render(tpl, object=obj, term=term)
        expr = F.when(lang_c == code, r) if expr is None else expr.when(lang_c == code, r)
    return expr.otherwise(F.raise_error(F.concat(F.lit("no pair-rating template for lang "), lang_c)).cast("string"))


def prompt_yes_no(term: Column | str, template: str = TEMPLATES["yes_no"]) -> Column:
    return render(template, term=term)  # C5


def prompt_a_b(choices: Column | str, template: str = TEMPLATES["a_b"]) -> Column:
    return render(template, choices=choice_text(choices))  # C6


def prompt_multi_choice(choices: Column | str, template: str = TEMPLATES["multi_choice"]) -> Column:
    return render(template, choices=choice_text(choices))  # C7


def system_instruction(sub_subtask: Column | str, default_text: str, random_text: str | None = None) -> Column:
    """The ``random`` sub_subtask gets the variant that allows answer -1."""
    if random_text is None:
        return F.lit(default_text)
    return F.when(_col(sub_subtask) == RANDOM_SUB_SUBTASK, F.lit(random_text)).otherwise(F.lit(default_text))


def tag_run(df: DataFrame, *, task: str, sub_task: str, lang: str, model_type: str, model_name: str,
            sub_subtask: str | None = None) -> DataFrame:
    """Add run metadata columns (C9); an existing ``sub_subtask`` column wins."""
    cols = {
        "task": F.lit(task), "sub_task": F.lit(sub_task), "lang": F.lit(lang),
        "model_type": F.lit(model_type), "model_name": F.lit(model_name),
    }
    if "sub_subtask" not in df.columns:
        cols["sub_subtask"] = F.lit(sub_subtask).cast("string")
    return df.withColumns(cols)


def model_basename(name: Column | str) -> Column:
    """Last path component; trailing slashes ignored like ``pathlib``."""
    return F.regexp_extract(_col(name), r"([^/]+)/*$", 1)


def select_sub_subtasks(df: DataFrame, wanted: Sequence[str] | None, column: str = "sub_subtask") -> DataFrame:
    """Keep the requested sub_subtasks (C11); ``None`` keeps all.  On a table
    partitioned by ``sub_subtask`` this prunes partitions at the scan."""
    if wanted is None:
        return df
    return df.where(F.col(column).isin(list(wanted)))


# Result-column names per task family (C12): internal -> written.
ANSWER_COLUMNS = {
    "selection": {"raw_response": "original_response", "parsed": "response"},
    "classification": {"raw_response": "original_model_inference", "parsed": "model_inference"},
    "generation": {"raw_response": "original_response"},
}


def answer_columns(df: DataFrame, family: str) -> DataFrame:
    """Rename the internal answer columns to the task family's names."""
    mapping = {k: v for k, v in ANSWER_COLUMNS[family].items() if k in df.columns}
    out = df.withColumnsRenamed(mapping)
    if family == "generation" and "parsed" in out.columns:
        out = out.drop("parsed")
    return out
