"""JSON and text sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

TREE_SCHEMA = (
    "tree_id string, path array<int>, parent_path array<int>, depth int, kind string, "
    "instance_id bigint, clustered boolean, description string, input string"
)


def scan_json_array(spark: SparkSession, path: str, element: str) -> DataFrame:
    """A4: files that each hold one JSON array: `file`, `position` and the fields of the element.

    The position is the key of an element, which a plain JSON reader loses. Convert once to a table
    with an explicit id; an array has to fit in one row.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    items = text.select("file", F.posexplode(F.from_json("value", f"array<{element}>")).alias("position", "item"))
    return items.select("file", "position", "item.*") if element.startswith("struct") else items


def scan_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A5."""
    return spark.read.schema(schema).json(path)


def parse_trees(documents: DataFrame, tree_id: str = "tree_id", text: str = "value") -> DataFrame:
    """One row per node of nested tree documents.

    A child is an instance id, or an object whose `subtrees` is a list, an object keyed by cluster, or
    a single instance id. A child's place in a list, or its cluster, is its step in the path; an
    instance listed directly keeps the path of the node it hangs under.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def rows(name: str, document: str):
            pending = [([], json.loads(document))]
            while pending:
                path, node = pending.pop()
                parent_path = path[:-1] if path else None
                if not isinstance(node, dict):
                    yield name, path, parent_path, len(path), "leaf", int(node), False, None, None
                    continue
                below = node.get("subtrees")
                clustered = isinstance(below, dict)
                yield (
                    name, path, parent_path, len(path), "inner", None, clustered,
                    node.get("description"), node.get("input"),
                )
                if below is None:
                    continue
                if isinstance(below, int):
                    pending.append((path, below))
                else:
                    steps = below.items() if clustered else enumerate(below)
                    for step, child in steps:
                        leaf_in_list = not clustered and not isinstance(child, dict)
                        pending.append((path if leaf_in_list else [*path, int(step)], child))

        names = [part.split(" ")[0] for part in TREE_SCHEMA.split(", ")]
        for batch in batches:
            flat = [row for name, document in zip(batch[tree_id], batch[text]) for row in rows(name, document)]
            frame = pd.DataFrame(flat, columns=names)
            frame["instance_id"] = frame["instance_id"].astype("Int64")
            yield frame

    return documents.select(tree_id, text).mapInPandas(run, TREE_SCHEMA)


def scan_trees(spark: SparkSession, path: str) -> DataFrame:
    """A6 from files, one tree per file; the file name is the tree id."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.json)?$", 1)
    return parse_trees(spark.read.text(path, wholetext=True).select(name.alias("tree_id"), "value"))


def tree_leaves(nodes: DataFrame) -> DataFrame:
    """The leaf table the tree operators read.

    A leaf that is itself a cluster stands under its own path; its node is then the leaf alone.
    """
    return nodes.filter("kind = 'leaf'").select("tree_id", "instance_id", "path")


def first_mean(text):
    """The first number after `mean` in a printed table, as a Column."""
    return F.regexp_extract(text, r"mean\s+([-+0-9.eE]+)", 1).try_cast("double")


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """Text reports with the first mean they print."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), first_mean(F.col("value")).alias("mean"))
    )


def _decoded(path):
    """File paths in metadata are escaped like URLs."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _glob(template: str, placeholder: str) -> str:
    head, tail = template.split(placeholder)
    for mark in "\\[]{}*?":
        head, tail = head.replace(mark, "\\" + mark), tail.replace(mark, "\\" + mark)
    return head + "*" + tail


def scan_numbered(spark: SparkSession, template: str, max_index: int, placeholder: str = "{PLACEHOLDER}") -> DataFrame:
    """The files `template` names for 1..max_index, with their number; absent numbers are skipped.

    Each file holds one JSON array of strings: `profile_id`, `rank`, `capability`.
    """
    import re

    head, tail = template.split(placeholder)
    pattern = re.escape(head.rsplit("/", 1)[-1]) + r"(\d+)" + re.escape(tail)
    number = F.regexp_extract(_decoded(F.col("_metadata.file_path")), pattern, 1).try_cast("int")
    return (
        spark.read.text(_glob(template, placeholder), wholetext=True)
        .select(number.alias("profile_id"), "value")
        .filter(F.col("profile_id").between(1, max_index))
        .select("profile_id", F.posexplode(F.from_json("value", "array<string>")).alias("rank", "capability"))
    )


def explode_catalogue(documents: DataFrame, text: str = "value") -> DataFrame:
    """`subject -> index -> question` documents as rows, in document order."""
    subjects = documents.select(
        F.posexplode(F.map_entries(F.from_json(text, "map<string,map<string,string>>"))).alias("subject_position", "_subject")
    )
    return subjects.select(
        F.col("_subject.key").alias("subject"),
        "subject_position",
        F.posexplode(F.map_entries(F.col("_subject.value"))).alias("position", "_entry"),
    ).select("subject", "subject_position", "position", F.col("_entry.key").alias("idx"), F.col("_entry.value").alias("question"))


def explode_scores(documents: DataFrame, text: str = "value") -> DataFrame:
    """`index -> score` documents as rows."""
    return documents.select(F.explode(F.from_json(text, "map<string,double>")).alias("idx", "score"))


def scan_catalogue(spark: SparkSession, questions_path: str, scores_path: str) -> tuple[DataFrame, DataFrame]:
    """A14 from files."""
    questions, scores = (spark.read.text(path, wholetext=True) for path in (questions_path, scores_path))
    return explode_catalogue(questions), explode_scores(scores)
