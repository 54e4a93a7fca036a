"""Search over artifacts: all-terms search, scored search, search among parameters.

Text is matched piece by piece where it is stored; only matches are shuffled, never the text of an artifact with all
its links.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans import top_per_project
from strandline.vocab import PARAM_QUESTION_WORDS, STOP_WORDS

P = "project_id"
NODE = ["project_id", "node_id"]


def tokens(text: Column) -> Column:
    """Distinct lower-case words of two or more characters; dots and underscores belong to words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_.]+"), lambda t: F.length(t) > 1))


def question_words(question: str, more_stops: list[str] = ()) -> list[str]:
    words = {w for w in re.split("[^a-z0-9_.]+", question.lower()) if len(w) > 1}
    return sorted(words - set(STOP_WORDS) - set(more_stops))


def param_text(params: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(params), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")


# texts of an artifact; those that a table lacks are left out
TEXTS = ("node_id", "label", "type", "path", "grp", "description", "tags", "groups", "notes")


def pieces(nodes: DataFrame, edges: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(node_id, piece): the texts of an artifact (strings or lists of strings), and the parameters of every link into it."""
    kinds = dict(nodes.dtypes)
    plain = [c for c in columns if kinds.get(c, "array").split("<")[0] != "array"]
    lists = [F.coalesce(c, F.array().cast("array<string>")) for c in columns if kinds.get(c) == "array<string>"]
    own = nodes.select(*NODE, F.explode(F.array_compact(F.concat(F.array(*plain), *lists))).alias("piece"))
    into = edges.where(F.size("params") > 0).select(P, F.col("target").alias("node_id"), param_text(F.col("params")).alias("piece"))
    return own.unionByName(into)


def search_all_terms(nodes: DataFrame, edges: DataFrame, query: str,
                     columns: tuple[str, ...] = TEXTS) -> DataFrame:
    """Artifacts in whose texts every term occurs somewhere."""
    terms = query.lower().split()
    if not terms:
        return nodes.select(*NODE)
    text = F.lower("piece")
    hits = pieces(nodes, edges, columns).select(*NODE, *[F.contains(text, F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)])
    any_hit = reduce(Column.__or__, [F.col(f"t{i}") for i in range(len(terms))])
    found = hits.where(any_hit).groupBy(*NODE).agg(*[F.bool_or(f"t{i}").alias(f"t{i}") for i in range(len(terms))])
    return found.where(reduce(Column.__and__, [F.col(f"t{i}") for i in range(len(terms))])).select(*NODE)


def search_scored(nodes: DataFrame, edges: DataFrame, question: str, limit: int | None = None,
                  columns: tuple[str, ...] = TEXTS) -> DataFrame:
    """(node_id, score), the best `limit` of a project if given: a question word scores 2 in the label or 1 elsewhere, and 1 for every word
    that contains it or is contained in it (question words of more than three letters).
    """
    words = question_words(question)
    if not words:
        return nodes.select(*NODE, F.lit(0).cast("long").alias("score")).limit(0)
    asked = F.array(*[F.lit(w) for w in words])
    longer = F.filter(asked, lambda q: F.length(q) > 3)
    found = (pieces(nodes, edges, columns).select(*NODE, F.explode(tokens(F.col("piece"))).alias("word"))
             .withColumn("exact", F.array_contains(asked, F.col("word")))
             .withColumn("near", F.size(F.filter(longer, lambda q: (q != F.col("word")) & (
                 F.contains(F.col("word"), q) | F.contains(q, F.col("word"))))))
             .where("exact OR near > 0"))
    labels = nodes.select(*NODE, tokens(F.col("label")).alias("_label"))
    scored = (found.groupBy(*NODE, "word").agg(F.first("exact").alias("exact"), F.first("near").alias("near"))
              .join(labels, NODE, "left"))
    in_label = F.coalesce(F.array_contains("_label", F.col("word")), F.lit(False))
    points = F.when(F.col("exact"), F.when(in_label, 2).otherwise(1)).otherwise(0) + F.col("near")
    out = scored.groupBy(*NODE).agg(F.sum(points).alias("score"))
    return out if limit is None else top_per_project(out, [F.col("score").desc(), F.col("node_id")], limit)


def search_params(nodes: DataFrame, edges: DataFrame, question: str, limit: int | None = None) -> DataFrame:
    """Links whose parameters or end labels share a word with the question; all with parameters if none is left."""
    words = question_words(question, PARAM_QUESTION_WORDS)
    label = nodes.select(P, "node_id", "label")
    rows = (edges.where(F.size("params") > 0)
            .join(label.select(P, F.col("node_id").alias("source"), F.col("label").alias("_a")), [P, "source"])
            .join(label.select(P, F.col("node_id").alias("target"), F.col("label").alias("_b")), [P, "target"]))
    if words:
        text = F.concat_ws(" ", param_text(F.col("params")), "_a", "_b")
        rows = rows.where(F.arrays_overlap(tokens(text), F.array(*[F.lit(w) for w in words])))
    out = rows.select(P, "edge_id", "source", "target")
    return out if limit is None else top_per_project(out, [F.col("edge_id")], limit)


def search_records(table: DataFrame, text: str) -> DataFrame:
    """Rows whose whole record, as JSON, contains the text."""
    return table.where(F.contains(F.lower(F.to_json(F.struct(*table.columns))), F.lit(text.lower())))
