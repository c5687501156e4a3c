"""Walking a task tree on the executors, level by level.

A file listing by Spark shows files only: not the directories without any, not empty files, not
names that start with ``_``. Here the directories of one level are the rows of a table, dealt over
the cluster; each is listed where its row is, and its prompt and validator files, which are small,
are read there too. Its subdirectories are the next level, unless its prompt makes it a leaf: nothing
below a leaf is looked at. A walk has as many rounds as the tree is deep, and the driver sees
of each only whether there is a next one.

Files are reached through ``pyarrow.fs``: local paths and the addresses that it knows. What cannot
be listed, read or decoded is a state of its directory, not a failed job.
"""

from __future__ import annotations

import ast
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import materialized
from evalspark.sources.prompts import parse_prompts

DESCRIPTION_FILE = "description.md"
VALIDATOR_FILE = "validate.py"
ENTRY_POINT = "validate"

# States of a directory, of its prompt and of its validator.
FOUND, MISSING, UNREADABLE, NO_DIRECTORY = "found", "missing", "unreadable", "no directory"
NAMELESS, BROKEN = "nameless", "broken"

VISIT = "directory string, state string, prompt string, text string, validator string, subdirectories array<string>"


def _bound_names(target: ast.expr) -> set[str]:
    return {node.id for node in ast.walk(target) if isinstance(node, ast.Name)}


def _binds(statements: list[ast.stmt], name: str) -> bool:
    """Whether statements of a module give a name a value, also in its branches, loops and blocks."""
    for statement in statements:
        match statement:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                found = statement.name == name
            case ast.Import() | ast.ImportFrom():
                found = any((alias.asname or alias.name.split(".")[0]) == name for alias in statement.names)
            case ast.Assign():
                found = any(name in _bound_names(target) for target in statement.targets)
            case ast.AnnAssign():
                found = statement.value is not None and name in _bound_names(statement.target)
            case _:
                inner = [getattr(statement, part, []) for part in ("body", "orelse", "finalbody")]
                inner += [handler.body for handler in getattr(statement, "handlers", [])]
                inner += [case.body for case in getattr(statement, "cases", [])]
                found = any(_binds(block, name) for block in inner)
        if found:
            return True
    return False


def validator_state(source: bytes) -> str:
    """Whether a validator file binds its entry point; the file is parsed, never run."""
    try:
        return FOUND if _binds(ast.parse(source).body, ENTRY_POINT) else NAMELESS
    except (SyntaxError, ValueError, RecursionError):
        return BROKEN


def _visit(root: str):
    def look(files, place: str) -> tuple:
        """(state, prompt, text, validator, subdirectories) of one directory."""
        from pyarrow import fs

        if files.get_file_info(place).type != fs.FileType.Directory:
            return NO_DIRECTORY, MISSING, None, MISSING, []
        try:
            children = files.get_file_info(fs.FileSelector(place))
        except OSError:
            return UNREADABLE, MISSING, None, MISSING, []
        names = {child.base_name: child for child in children}
        below = sorted(name for name, child in names.items() if child.type == fs.FileType.Directory)
        prompt, text, validator = MISSING, None, MISSING
        if DESCRIPTION_FILE in names:
            try:
                prompt, text = FOUND, _content(files, names[DESCRIPTION_FILE].path).decode()
            except (OSError, UnicodeDecodeError):
                prompt = UNREADABLE
        if VALIDATOR_FILE in names:
            try:
                validator = validator_state(_content(files, names[VALIDATOR_FILE].path))
            except OSError:
                validator = UNREADABLE
        return FOUND, prompt, text, validator, below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            directories = batch.column(0).to_pylist()
            found = [look(files, f"{base}/{directory}".rstrip("/") or "/") for directory in directories]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(directories, pa.string()), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True))],
                ["directory", "state", "prompt", "text", "validator", "subdirectories"],
            )

    return run


def _content(files, path: str) -> bytes:
    with files.open_input_stream(path) as stream:
        return stream.read()


def _level(directories: DataFrame, root: str) -> DataFrame:
    """A level's directories with what is in them, their prompts parsed."""
    visited = directories.mapInArrow(_visit(root), VISIT)
    parsed = parse_prompts(visited, yaml=True)
    return materialized(parsed.select("directory", "state", "prompt", "validator", "subdirectories", "id", "messages", "parse_error"))


def walk_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every directory from the root (``""``) on: directory, state, prompt, validator, subdirectories,
    id, messages, parse_error. Hidden directories, and all below leaves, are left out.

    Each level is written to the cluster's checkpoint folder; a session without one lists a level again
    for each that comes after it.
    """
    address = root if "://" in root else _absolute(root)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = _level(spark.createDataFrame([("",)], "directory string"), address)
    levels = [level]
    while True:
        open_ends = F.coalesce(F.size("messages") == 0, F.lit(True)) & (F.col("state") == FOUND)
        below = level.filter(open_ends).select("directory", F.explode("subdirectories").alias("name"))
        below = below.filter(~F.col("name").startswith("."))
        path = F.when(F.col("directory") == "", F.col("name")).otherwise(F.concat("directory", F.lit("/"), "name"))
        if below.isEmpty():
            break
        level = _level(below.select(path.alias("directory")).repartition(tasks, "directory"), address)
        levels.append(level)
    walked = levels[0]
    for level in levels[1:]:
        walked = walked.unionByName(level)
    return walked


def _absolute(root: str) -> str:
    path = root.removeprefix("file:")
    return os.path.abspath(path)
