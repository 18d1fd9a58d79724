"""Context and prompt tables for question answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions.text import fixed, prefix

# ---- fixed values -------------------------------------------------------------------------
SNIPPET = 600
SOURCE_SEPARATOR = "\n\n---\n\n"
INSTRUCTION = (
    "Ты — опытный научный аналитик и гид по российским НИОКР-проектам. "
    "Отвечай уверенно, как эксперт: никогда не говори 'из контекста', 'из предоставленных данных', 'согласно контексту'. "
    "Излагай так, как будто ты лично разбираешься в этой теме. "
    "Выдели самое интересное и значимое: уникальные методы, масштаб, неожиданный угол или особый бюджет. "
    "Если проект примечателен — скажи об этом прямо. "
    "Отвечай строго на русском языке. Будь конкретным и живым, без сухих канцеляризмов."
)
PROMPT_QUERY = "\n\nЗапрос: "
PROMPT_DATA = "\n\nДанные о проектах:\n\n"
PROMPT_END = "\n\nАнализ:"
SOURCE_NAME = "Проект: "
SOURCE_YEAR = "\nГод: "
SOURCE_INSTITUTION = " | Организация: "
SOURCE_TEXT = "\nОписание: "
QUESTION_HEAD = 'Расскажи подробнее об этом проекте: "'
QUESTION_END = '". Каковы цели исследования и ожидаемые результаты?'
QUESTION_NAME_CUT = 80
BRIEF_TITLE = 'Analyse the research project: "'
BRIEF_BUDGET = '". \nBudget: '
BRIEF_MONEY = " million RUB"
BRIEF_YEAR = ". \nYear: "
BRIEF_INSTITUTION = ".\nInstitution: "
BRIEF_FOCUS = ".\nFocus: "
BRIEF_END = ".\nWhat are the key research goals and potential impact?"
BRIEF_UNKNOWN = "unknown"
BRIEF_GENERAL = "general research"
# ---- end of fixed values ------------------------------------------------------------------


def _text(c: Column | str) -> Column:
    """Text of a value as shown to the reader; a missing one reads ``None``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("None"))


def build_context(hits: DataFrame) -> DataFrame:
    """One context text per question, sources in rank order.

    ``hits`` carries a fixed number of sources per question, so the text of a group is bounded.
    """
    source = F.concat(
        F.lit(SOURCE_NAME), _text("name"),
        F.lit(SOURCE_YEAR), _text("year"), F.lit(SOURCE_INSTITUTION), _text("institution"),
        F.lit(SOURCE_TEXT), prefix(F.coalesce("source_text", F.lit("")), SNIPPET),
    )
    parts = F.array_sort(F.collect_list(F.struct("rank", source.alias("text"))))
    return hits.groupBy("question_id").agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), SOURCE_SEPARATOR).alias("context")
    )


def build_prompts(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """Instruction, question and context as one text per question."""
    asked = questions.select(F.col("question_id").cast("string"), "question")
    return contexts.join(asked, "question_id").select(
        "question_id",
        F.concat(
            F.lit(INSTRUCTION + PROMPT_QUERY), "question",
            F.lit(PROMPT_DATA), "context", F.lit(PROMPT_END),
        ).alias("prompt"),
    )


def project_question(name: Column) -> Column:
    """Question about one project, from the first characters of its name."""
    return F.concat(
        F.lit(QUESTION_HEAD),
        prefix(F.coalesce(name, F.lit("")), QUESTION_NAME_CUT),
        F.lit(QUESTION_END),
    )


def project_brief(
    name: Column, key: Column, budget: Column, year: Column, institution: Column, keywords: Column
) -> Column:
    """Analysis request for one project with its budget, year, institution and focus."""
    unknown = F.lit(BRIEF_UNKNOWN)
    title = F.coalesce(F.nullif(name, F.lit("")), key, F.lit(""))
    money = F.when(budget != 0, F.concat(fixed(budget / 1000, 1), F.lit(BRIEF_MONEY)))
    first = F.array_join(F.slice(F.split(F.coalesce(keywords, F.lit("")), ";"), 1, 3), ", ")
    return F.concat(
        F.lit(BRIEF_TITLE), title, F.lit(BRIEF_BUDGET),
        F.coalesce(money, unknown),
        F.lit(BRIEF_YEAR), F.coalesce(F.when(year != 0, year.cast("string")), unknown),
        F.lit(BRIEF_INSTITUTION), F.coalesce(F.nullif(institution, F.lit("")), unknown),
        F.lit(BRIEF_FOCUS), F.coalesce(F.nullif(first, F.lit("")), F.lit(BRIEF_GENERAL)),
        F.lit(BRIEF_END),
    )
