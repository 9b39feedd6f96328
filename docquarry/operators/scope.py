"""Which documents a question may use.

A scope is kept in two tables: what each question may use by name, and what is in each name.  Questions
with the same selection share its documents, and "all" is no list at all, so there are never rows for
every question and document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def names_to_documents(documents: DataFrame, order: str) -> DataFrame:
    """A repeated file name means the document indexed last."""
    return documents.groupBy("kb_id", "file_name").agg(
        F.max_by("doc_id", order).alias("doc_id")
    )


def active_documents(requests: DataFrame, documents: DataFrame, order: str) -> DataFrame:
    """(query_id, kb_id, doc_id) per request.

    ``requests``: query_id, kb_id, scope_mode, selected (array of names).  Only
    the mode 'selected' narrows the scope; without names it allows nothing.
    """
    selected = requests.filter(F.col("scope_mode").eqNullSafe("selected"))
    named = (
        selected.select("query_id", "kb_id", F.explode("selected").alias("file_name"))
        .distinct()
        .join(names_to_documents(documents, order), ["kb_id", "file_name"])
        .select("query_id", "kb_id", "doc_id")
    )
    everything = (
        requests.filter(~F.col("scope_mode").eqNullSafe("selected"))
        .select("query_id", "kb_id")
        .join(documents.select("kb_id", "doc_id"), "kb_id")
    )
    return named.unionByName(everything).distinct()


@dataclass(frozen=True)
class Scope:
    """questions(query_id, scope_id), NULL for all documents of the base; members(scope_id, doc_id).

    A question that is not listed, or whose scope has no members, may use nothing.
    """

    questions: DataFrame
    members: DataFrame

    def allowed(self, rows: DataFrame) -> DataFrame:
        """Rows (query_id, doc_id, ...) of documents that the question may use."""
        inside = self.members.select("scope_id", "doc_id").distinct().withColumn("__in", F.lit(True))
        return (
            rows.join(self.questions.select("query_id", "scope_id"), "query_id")
            .join(inside, ["scope_id", "doc_id"], "left")
            .filter(F.col("scope_id").isNull() | F.col("__in"))
            .select(*rows.columns)
        )


def as_scope(scope: Scope | DataFrame | None) -> Scope | None:
    """A table of pairs (query_id, doc_id) is a scope of its own for each question."""
    if scope is None or isinstance(scope, Scope):
        return scope
    pairs = scope.select(F.col("query_id").alias("scope_id"), "doc_id")
    return Scope(scope.select("query_id", F.col("query_id").alias("scope_id")).distinct(), pairs)


def by_group(questions: DataFrame, documents: DataFrame) -> Scope:
    """Every question may use the documents of its group: (query_id, group) and (doc_id, group)."""
    return Scope(
        questions.filter(F.col("group").isNotNull()).select("query_id", F.col("group").alias("scope_id")),
        documents.select(F.col("group").alias("scope_id"), "doc_id"),
    )


def of_requests(requests: DataFrame, documents: DataFrame, order: str) -> Scope:
    """The scope of requests as :func:`active_documents` takes them."""
    narrowed = F.col("scope_mode").eqNullSafe("selected")
    names = F.array_sort(F.array_distinct(F.coalesce("selected", F.array().cast("array<string>"))))
    chosen = requests.select("query_id", "kb_id", names.alias("names"), narrowed.alias("narrowed")).withColumn(
        "scope_id", F.when(F.col("narrowed"), F.md5(F.to_json(F.struct("kb_id", "names"))))
    )
    listed = (
        chosen.filter("narrowed").select("scope_id", "kb_id", F.explode("names").alias("file_name")).distinct()
    )
    members = listed.join(names_to_documents(documents, order), ["kb_id", "file_name"])
    return Scope(chosen.select("query_id", "scope_id"), members.select("scope_id", "doc_id"))
