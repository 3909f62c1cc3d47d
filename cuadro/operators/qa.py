"""Retrieval context for question answering: stuffed context, prompt, source snippets.

All per-question work is bounded by k (the retrieved documents), so the ``collect_list``
inside each question group holds at most k entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet

# ---------------------------------------------------------------------------------------
# The answer prompt (context and question are filled in), the separator
# between stuffed documents, retrieval sizes, the error texts of an unknown store and of a failed question, and the line that
# names a question's chart after the answer.
PROMPT_TEMPLATE = """Eres un analista de datos experto que ayuda a responder preguntas sobre datasets tabulares.

CONTEXTO DE DATOS:
{context}

INSTRUCCIONES:
1. Analiza cuidadosamente los datos proporcionados en el contexto
2. Responde la pregunta basándote ÚNICAMENTE en la información disponible
3. Si los datos contienen información relevante, proporciona una respuesta clara y específica
4. Incluye números, fechas y detalles específicos cuando sea posible
5. Si la información no está disponible en los datos, indica claramente que no puedes responder
6. Cita las columnas o filas relevantes cuando sea apropiado

PREGUNTA: {question}

RESPUESTA:"""
CONTEXT_SEPARATOR = "\n\n"
ASK_K = 3
SEARCH_K = 5
ERROR_ANSWER = "Error: No se pudo cargar el dataset especificado."
ERROR_QUESTION = ("Lo siento, ocurrió un error al procesar tu pregunta. Por favor, verifica que el dataset esté disponible "
                  "e intenta nuevamente.")
ERROR_STORE = "Vector store '{store}' no encontrado"
CHART_NOTE = "\n\n📊 Gráfico generado: "
# ---------------------------------------------------------------------------------------


def build_prompt(context: Column, question: Column) -> Column:
    """The prompt template with both slots filled (NULL context gives NULL)."""
    head, rest = PROMPT_TEMPLATE.split("{context}")
    mid, tail = rest.split("{question}")
    return F.concat(F.lit(head), context, F.lit(mid), question, F.lit(tail))


def stuff_context(ranked: DataFrame, group_cols: list[str], rank_col: str, text_col: str,
                  sep: str = CONTEXT_SEPARATOR, out: str = "context") -> DataFrame:
    """Join the texts of each group in rank order, separated by a blank line."""
    return ranked.groupBy(*group_cols).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank_col, text_col))),
                                 lambda x: x[text_col]), sep).alias(out))


def sources_column(rank_col: str, content_col: str, metadata: Column) -> Column:
    """Aggregate: the retrieved sources in rank order, content cut to a snippet."""
    items = F.collect_list(F.struct(F.col(rank_col).alias("r"), snippet(F.col(content_col)).alias("content"),
                                    metadata.alias("metadata")))
    # ordered by rank alone (metadata may be a map, which has no ordering)
    by_rank = F.array_sort(items, lambda a, b: F.when(a["r"] < b["r"], -1).when(a["r"] > b["r"], 1).otherwise(0))
    return F.transform(by_rank, lambda x: F.struct(x["content"].alias("content"), x["metadata"].alias("metadata")))
