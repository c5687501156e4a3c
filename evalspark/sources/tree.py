"""Task trees: directories with a prompt document each, leaves with messages.

The functions work on tables with a ``directory`` column (relative, ``a/b/c``), so a tree can
be walked (``scan_tree``, ``scan_problems``; see ``walk``) or come from any table. ``list_files`` and
``read_prompts`` read it with Spark's own file sources, for stores that only these can open; those do not
see directories without any file below them, files of length zero, and names that start with ``_``.
"""

from __future__ import annotations

import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.identity import with_identity
from evalspark.sources import walk
from evalspark.sources.prompts import parse_prompts
from evalspark.sources.walk import DESCRIPTION_FILE, VALIDATOR_FILE

#: A line at the left margin that defines, assigns or imports the name ``validate``.
VALIDATOR_NAME = (
    r"(?m)^(?:(?:(?:async[ \t]+)?def|class)[ \t]+validate\b|validate[ \t]*[:=](?!=)"
    r"|(?:from[ \t][^\n]*[ \t])?import[ \t][^\n#]*\bvalidate\b)"
)

# Values of ``kind`` in a problem table; the last is a warning, the others are failures.
NOT_A_DIRECTORY = "root is not a directory"
MISSING_DESCRIPTION = "missing description"
UNREADABLE_DIRECTORY = "unreadable directory"
UNREADABLE_DESCRIPTION = "unreadable description"
UNREADABLE_VALIDATOR = "unreadable validator"
NO_SUBDIRECTORIES = "no subdirectories"


class TreeError(ValueError):
    """The root of a task tree cannot be used."""


def _root_path(root: str) -> str:
    """The path part of a root: scheme and authority are removed, local paths made absolute."""
    remote = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?(/.*)?$", root)
    path = (remote.group(1) or "") if remote else os.path.abspath(root)
    return path.rstrip("/")


def _relative(uri: Column, root: str) -> Column:
    """A file's path below the root; file URIs are percent-encoded, ``+`` stands for itself."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(decoded, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    return F.substring(path, F.lit(len(_root_path(root)) + 2), F.length(path))


def _parts(directory: Column) -> Column:
    return F.split(directory, "/", -1)


def _directory_of(path: Column) -> Column:
    """All but the last part of a path; empty for a file right below the root."""
    parts = _parts(path)
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def _visible(directory: Column) -> Column:
    return ~F.exists(_parts(directory), lambda part: part.startswith("."))


def _prefixes(directory: Column, with_self: bool) -> Column:
    """The ancestors of a directory, outermost first, with their depth; maybe also itself."""
    parts = _parts(directory)
    last = F.size(parts) if with_self else F.size(parts) - 1
    return F.when(
        last > 0,
        F.transform(
            F.sequence(F.lit(1), last),
            lambda depth: F.struct(
                depth.alias("depth"),
                F.array_join(F.slice(parts, F.lit(1), depth), "/").alias("node"),
            ),
        ),
    )


def _load(reader_load, root: str) -> DataFrame:
    try:
        return reader_load(root)
    except AnalysisException as failure:
        raise TreeError(f"cannot list {root}") from failure


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path): every visible file below the root, relative to it. No file content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = _load(reader.load, root)
    return files.select(_relative(F.col("_metadata.file_path"), root).alias("path"))


def list_directories(files: DataFrame) -> DataFrame:
    """(directory): every visible directory that has a file somewhere below it."""
    own = files.select(_directory_of(F.col("path")).alias("directory")).filter(
        (F.col("directory") != "") & _visible(F.col("directory"))
    )
    steps = own.select(F.explode(_prefixes(F.col("directory"), with_self=True)).alias("step"))
    return steps.select(F.col("step.node").alias("directory")).distinct()


def validator_directories(files: DataFrame) -> DataFrame:
    """(directory): the directories that hold a validator file."""
    return files.filter(F.substring_index("path", "/", -1) == VALIDATOR_FILE).select(
        _directory_of(F.col("path")).alias("directory")
    )


def read_validators(spark: SparkSession, root: str) -> DataFrame:
    """(directory): the directories whose validator file has the name ``validate``.

    The file is read as text, not run: a name that is made in another way is not seen.
    """
    reader = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", VALIDATOR_FILE)
    )
    return (
        _load(reader.load, root)
        .filter(F.col("value").rlike(VALIDATOR_NAME))
        .select(_directory_of(_relative(F.col("_metadata.file_path"), root)).alias("directory"))
    )


def read_prompts(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """(directory, id, messages, parse_error): every prompt document below the root."""
    reader = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", DESCRIPTION_FILE)
    )
    texts = _load(reader.load, root).select(
        _directory_of(_relative(F.col("_metadata.file_path"), root)).alias("directory"),
        F.col("value").alias("text"),
    )
    in_tree = (F.col("directory") != "") & _visible(F.col("directory"))
    return parse_prompts(texts.filter(in_tree), strict=strict)


def leaf_chains(prompts: DataFrame) -> DataFrame:
    """(directory, id_chain) of every leaf that is not below another leaf.

    Only the ids of the nodes take part: the messages stay where they are until the chain is
    known. A leaf with an ancestor that has no readable prompt is left out, since its chain is
    not known; ``tree_problems`` reports that ancestor.
    """
    is_leaf = F.size("messages") > 0
    nodes = prompts.select("directory", "id", F.coalesce(is_leaf, F.lit(False)).alias("is_leaf"))
    leaves = nodes.filter("is_leaf").select("directory", "id")
    ancestors = _prefixes(F.col("directory"), with_self=False)
    steps = leaves.select("directory", "id", F.explode_outer(ancestors).alias("step"))
    above = nodes.select(
        F.col("directory").alias("node"),
        F.col("id").alias("ancestor_id"),
        F.col("is_leaf").alias("ancestor_is_leaf"),
    )
    joined = steps.select("directory", "id", "step.depth", "step.node").join(above, "node", "left")
    chains = joined.groupBy("directory", "id").agg(
        F.sort_array(F.collect_list(F.struct("depth", "ancestor_id"))).alias("steps"),
        F.bool_or("ancestor_is_leaf").alias("below_leaf"),
        F.bool_or(F.col("depth").isNotNull() & F.col("ancestor_id").isNull()).alias("broken"),
    )
    known = F.filter("steps", lambda step: step["depth"].isNotNull())
    return chains.filter(~F.coalesce("below_leaf", F.lit(False)) & ~F.col("broken")).select(
        "directory",
        F.concat(F.transform(known, lambda step: step["ancestor_id"]), F.array("id")).alias("id_chain"),
    )


def build_tasks(
    prompts: DataFrame, validators: DataFrame | None = None, root: str = "", ordered: bool = True
) -> DataFrame:
    """The task table of a parsed tree, depth first in the order of the directory names."""
    leaves = prompts.filter(F.size("messages") > 0).select("directory", "messages")
    tasks = leaf_chains(prompts).join(leaves, "directory")
    if validators is None:
        tasks = tasks.withColumn("has_validator", F.lit(False))
    else:
        marks = validators.select("directory").distinct().withColumn("mark", F.lit(True))
        tasks = tasks.join(marks, "directory", "left").withColumn(
            "has_validator", F.coalesce("mark", F.lit(False))
        )
    if ordered:
        tasks = tasks.orderBy(_parts(F.col("directory")))
    return with_identity(
        tasks.select(
            F.concat(F.lit(f"{root.rstrip('/')}/"), F.col("directory")).alias("path"),
            "id_chain",
            "messages",
            "has_validator",
        )
    )


def tree_problems(prompts: DataFrame, directories: DataFrame) -> DataFrame:
    """(directory, kind): what is wrong with a tree. Nothing below a leaf is looked at.

    Every directory meets the prompts of its ancestors and its own in one join; one grouping
    then tells what it is. Only containers are looked up among the parents.
    """
    states = prompts.select(
        F.col("directory").alias("node"),
        F.coalesce(F.size("messages") > 0, F.lit(False)).alias("is_leaf"),
        F.coalesce("parse_error", F.when(F.size("messages") == 0, NO_SUBDIRECTORIES)).alias("finding"),
    )
    steps = directories.select(
        "directory", F.explode(_prefixes(F.col("directory"), with_self=True)).alias("step")
    )
    joined = steps.select("directory", "step.node").join(states, "node", "left")
    is_self = F.col("node") == F.col("directory")
    found = joined.groupBy("directory").agg(
        F.bool_or(~is_self & F.col("is_leaf")).alias("below_leaf"),
        F.bool_or(is_self & F.col("is_leaf").isNotNull()).alias("described"),
        F.max(F.when(is_self, F.col("finding"))).alias("finding"),
    )
    kind = F.when(~F.col("described"), MISSING_DESCRIPTION).otherwise(F.col("finding"))
    problems = (
        found.filter(~F.coalesce("below_leaf", F.lit(False)))
        .select("directory", kind.alias("kind"))
        .filter(F.col("kind").isNotNull())
    )
    parents = directories.select(
        _directory_of(F.col("directory")).alias("directory"), F.lit(NO_SUBDIRECTORIES).alias("kind")
    )
    return problems.join(parents, ["directory", "kind"], "left_anti")


def walked_problems(walked: DataFrame) -> DataFrame:
    """(directory, kind) for the rows of ``walk_tree``."""
    is_leaf = F.size("messages") > 0
    root = F.when(F.col("state") != walk.FOUND, NOT_A_DIRECTORY)
    inner = (
        F.when(F.col("state") != walk.FOUND, UNREADABLE_DIRECTORY)
        .when(F.col("prompt") == walk.MISSING, MISSING_DESCRIPTION)
        .when(F.col("prompt") == walk.UNREADABLE, UNREADABLE_DESCRIPTION)
        .when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(is_leaf & F.col("validator").isin(walk.BROKEN, walk.UNREADABLE), UNREADABLE_VALIDATOR)
        .when(~is_leaf & (F.size("subdirectories") == 0), NO_SUBDIRECTORIES)
    )
    kind = F.when(F.col("directory") == "", root).otherwise(inner)
    return walked.select("directory", kind.alias("kind")).filter("kind IS NOT NULL")


def walked_prompts(walked: DataFrame) -> DataFrame:
    """(directory, id, messages, parse_error) of the directories with a prompt."""
    readable = (F.col("directory") != "") & (F.col("prompt") == walk.FOUND)
    return walked.filter(readable).select("directory", "id", "messages", "parse_error")


def scan_problems(spark: SparkSession, root: str) -> DataFrame:
    """(directory, kind) for a tree of files."""
    return walked_problems(walk.walk_tree(spark, root))


def scan_tree(spark: SparkSession, root: str, strict: bool = True, ordered: bool = True) -> DataFrame:
    """The task table of a tree of files.

    The tree is walked on the executors; each directory is read and parsed once where the
    cluster has a checkpoint folder. ``strict`` looks for failures first (one job, of which only the first one is kept)
    and raises TreeError; otherwise unreadable parts of the tree are left out.
    """
    walked = walk.walk_tree(spark, root)
    if strict:
        failures = walked_problems(walked).filter(F.col("kind") != NO_SUBDIRECTORIES)
        first = failures.orderBy(_parts(F.col("directory"))).limit(1).collect()
        if first:
            raise TreeError(f"{first[0]['kind']}: {root}/{first[0]['directory']}".rstrip("/"))
    marks = walked.filter(F.col("validator") == walk.FOUND).select("directory")
    return build_tasks(walked_prompts(walked), marks, root, ordered)
