"""File discovery and text reading, as filters over a listing."""

from __future__ import annotations

import os
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.functions.text import LANGUAGES, language_of, last_suffix
from cartograph.session import stage

# Directories that are never indexed.
SKIP_DIRS = (
    "node_modules", ".git", "__pycache__", "target",
    "venv", ".venv", ".env", "dist", "build",
    ".mypy_cache", ".pytest_cache", ".ruff_cache",
    ".next", ".turbo", "coverage",
)


def in_scope(path: Column, scope: str) -> Column:
    """Whole path components: scope ``src/co`` does not take ``src/core/a.py``."""
    clean = scope.rstrip("/")
    if not clean:
        return F.lit(True)
    return (path == F.lit(clean)) | path.startswith(clean + "/")


def supported(path: Column) -> Column:
    return last_suffix(path).isin(*LANGUAGES)


def _folders(path: Column) -> Column:
    """Directory components of a path, the file name left out."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def outside_skip_dirs(path: Column) -> Column:
    return ~F.arrays_overlap(_folders(path), F.array(*map(F.lit, SKIP_DIRS)))


def not_hidden(path: Column) -> Column:
    """No component of the path starts with a dot."""
    return ~path.rlike(r"(^|/)\.")


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("lang", language_of(F.col("path")))


_LISTED = "full_path string, is_dir boolean, length long, modified timestamp"


def _list_folders(root: str):
    """Task that lists folders. A link to a folder is not followed."""

    def run(batches):
        filesystem, _ = fs.FileSystem.from_uri(root)
        local = isinstance(filesystem, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch["full_path"]:
                # A folder that has vanished since its parent was listed has no entries.
                selector = fs.FileSelector(folder, allow_not_found=True)
                entries = [
                    (e.path, e.type == fs.FileType.Directory, e.size, e.mtime)
                    for e in filesystem.get_file_info(selector)
                    if not (local and e.type == fs.FileType.Directory and os.path.islink(e.path))
                ]
                frame = pd.DataFrame(entries, columns=["full_path", "is_dir", "length", "modified"])
                frame["length"] = frame["length"].astype("Int64")
                frame["modified"] = pd.to_datetime(frame["modified"], utc=True)
                yield frame

    return run


def walk(
    spark: SparkSession, root: str, skip_dirs: bool = True, hidden_dirs: bool = False
) -> DataFrame:
    """(path, full_path, length, modified) of every file below ``root``.

    Spark's own file sources leave out names that start with ``_`` (such as ``__init__.py``) or a
    dot, so folders are listed by tasks, one level of the tree per job. Skipped and hidden folders
    are not entered.
    """
    _, base = fs.FileSystem.from_uri(root)
    base = base.rstrip("/")
    level = spark.createDataFrame([(base,)], "full_path string")
    path = F.col("path")
    files: list[DataFrame] = []
    while True:
        listed = level.mapInPandas(_list_folders(root), _LISTED).select(
            F.substr(F.col("full_path"), F.lit(len(base) + 2)).alias("path"),
            "full_path",
            "is_dir",
            "length",
            "modified",
        )
        folder = F.concat(path, F.lit("/x"))
        if skip_dirs:
            listed = listed.where(~F.col("is_dir") | outside_skip_dirs(folder))
        if not hidden_dirs:
            listed = listed.where(~F.col("is_dir") | not_hidden(folder))
        found = stage(listed, "listing", dirs=F.sum(F.col("is_dir").cast("int")))
        files.append(found.df.where("NOT is_dir").drop("is_dir"))
        if not found.metrics["dirs"]:
            return reduce(DataFrame.unionByName, files)
        # By a fixed number: names are few bytes, so adaptive execution would merge them all.
        tasks = min(found.metrics["dirs"], 4 * spark.sparkContext.defaultParallelism)
        level = found.df.where("is_dir").select("full_path").repartition(tasks, "full_path")


def discover(
    spark: SparkSession,
    root: str,
    scope: str | None = None,
    suffixes: tuple[str, ...] = tuple(LANGUAGES),
    skip_dirs: bool = True,
    hidden: bool = False,
) -> DataFrame:
    """The source files below ``root``, by suffix and scope; ``path`` is relative to ``root``.

    No contents are read.
    """
    return select_files(walk(spark, root, skip_dirs, hidden), root, scope, suffixes, hidden)


def select_files(
    files: DataFrame,
    root: str,
    scope: str | None = None,
    suffixes: tuple[str, ...] = tuple(LANGUAGES),
    hidden: bool = False,
) -> DataFrame:
    path = F.col("path")
    kept = files.where(last_suffix(path).isin(*suffixes))
    if scope:
        _, base = fs.FileSystem.from_uri(root)
        kept = kept.where(in_scope(path, scope.removeprefix(base.rstrip("/") + "/")))
    return kept if hidden else kept.where(not_hidden(path))


def _read_files(root: str):
    """Task that reads files one at a time; only the file at hand is in memory.

    A file that cannot be read gives a row with the reason; it does not end the job.
    """

    def run(batches):
        filesystem, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, full in zip(batch["path"], batch["full_path"]):
                content, reason = None, None
                try:
                    with filesystem.open_input_stream(full) as stream:
                        content = stream.read()
                except FileNotFoundError:
                    reason = "vanished"
                except OSError:
                    reason = "unreadable"
                yield pd.DataFrame({"path": [path], "content": [content], "reason": [reason]})

    return run


# Bytes of files to a reading task.
READ_BYTES = 128 << 20


def read_bytes(root: str, files: DataFrame) -> DataFrame:
    """(path, content BINARY, reason) of the listed files; the reason says why there is no content.

    The tasks are set by the number and the bytes of the files: the shuffle carries names only, so
    adaptive execution would merge it to one.
    """
    size = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).first()
    parallel = 4 * files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(size["n"], parallel), -(-(size["bytes"] or 0) // READ_BYTES))
    return (
        files.select("path", "full_path")
        .repartition(tasks, "path")
        .mapInPandas(_read_files(root), "path string, content binary, reason string")
    )


def split_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files(path, content BINARY)`` to (sources, quarantine); only valid UTF-8 becomes text.

    A column ``reason`` tells why a content is missing.
    """
    why = F.col("reason") if "reason" in files.columns else F.lit(None).cast("string")
    text = files.withColumn("text", F.col("content").cast("string")).withColumn(
        "valid", F.is_valid_utf8("text")
    )
    good = text.where("valid").select("path", F.col("text").alias("content"))
    bad = text.where("valid IS NULL OR NOT valid").select(
        "path",
        F.octet_length("text").cast("long").alias("length"),
        F.coalesce(why, F.when(F.col("content").isNull(), "unreadable"), F.lit("not UTF-8")).alias("reason"),
    )
    return good, bad


def read_sources(root: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contents of the discovered ``files``: (sources, quarantine). Bytes are read and staged once."""
    return split_text(stage(read_bytes(root, files), "contents").df)


# ---------------------------------------------------------------- ignore rules


# The parts of a glob: an escape, a class, the forms of ``**``, a star, a question mark, plain text.
_GLOB_PART = (
    r"\\[\s\S]|\[[!^]?\]?(?:\\[\s\S]|[^\]\\])*\]|^\*\*/|/\*\*/|/\*\*$|\*+|\?|[^\\\[*?/]+|[\s\S]"
)


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"([.+^$(){}|\\\[\]*?&\-])", r"\\$1")


def _class(part: Column) -> Column:
    """``[...]`` of a glob; ``!`` negates it and no class takes a slash."""
    inner = F.regexp_replace(part, r"^\[[!^]?|\]$", "")
    # An escaped sign stays itself; other signs that the engine would read are quoted.
    letters = F.regexp_replace(inner, r"\\([A-Za-z0-9])", "$1")
    quoted = F.regexp_replace(letters, r"\\([\s\S])|([\[\]^&])", r"\\$1$2")
    negated = part.rlike(r"^\[[!^]")
    return F.concat(F.lit("(?!/)["), F.when(negated, "^").otherwise(""), quoted, F.lit("]"))


def _glob_regex(part: Column) -> Column:
    return (
        F.when(part.startswith("\\"), _plain(F.substring(part, 2, 1)))
        .when(part.startswith("["), _class(part))
        .when(part == "**/", "(?:.*/)?")
        .when(part == "/**/", "/(?:.*/)?")
        .when(part == "/**", "/.+")
        .when(part.startswith("*"), "[^/]*")
        .when(part == "?", "[^/]")
        .otherwise(_plain(part))
    )


def _ignore_lines(lines: DataFrame) -> DataFrame:
    """(dir, line_no, line, negated, glob, parts, malformed) of the lines that are rules."""
    raw = F.rtrim("line")
    rows = lines.where((raw != "") & ~raw.startswith("#")).select(
        "dir",
        "line_no",
        "line",
        raw.startswith("!").alias("negated"),
        F.regexp_replace(raw, r"^!|^\\(?=[#!])", "").alias("glob"),
    )
    body = F.regexp_replace("glob", r"^/|/$", "")
    parts = F.regexp_extract_all(body, F.lit(_GLOB_PART), F.lit(0))
    # An open bracket without its pair, a backslash at the end, a range that runs backwards.
    backwards = F.exists(
        F.flatten(
            F.transform(
                F.filter("parts", lambda p: p.startswith("[")),
                lambda p: F.regexp_extract_all(p, F.lit(r"[^\[!^\\]-[^\]\\]"), F.lit(0)),
            )
        ),
        lambda r: F.ascii(F.substring(r, 1, 1)) > F.ascii(F.substring(r, 3, 1)),
    )
    open_end = F.exists("parts", lambda p: p.isin("[", "\\"))
    return rows.withColumn("parts", parts).withColumn("malformed", open_end | backwards)


def malformed_rules(lines: DataFrame) -> DataFrame:
    """(dir, line_no, line) of the lines that are no valid pattern; they match nothing."""
    return _ignore_lines(lines).where("malformed").select("dir", "line_no", "line")


def parse_ignore_rules(lines: DataFrame) -> DataFrame:
    """``lines(dir, line_no, line)`` of ignore files to rules (dir, regex, negated, only_dirs, ord).

    ``dir`` is the folder of the ignore file relative to the root, empty for the root. Deeper files
    and later lines come later in ``ord`` and win. Malformed lines are left out, see
    :func:`malformed_rules`.
    """
    rows = _ignore_lines(lines).where("NOT malformed")
    glob = F.col("glob")
    anchored = F.regexp_replace(glob, r"/$", "").contains("/")
    start = F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?"))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    return rows.select(
        "dir",
        F.concat(start, F.array_join(F.transform("parts", _glob_regex), ""), F.lit("$")).alias("regex"),
        "negated",
        glob.endswith("/").alias("only_dirs"),
        F.struct(depth.alias("depth"), "line_no").alias("ord"),
    )


def read_ignore_files(root: str, files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """Rules of the ignore files among the walked ``files``."""
    found = files.where((F.col("path") == name) | F.col("path").endswith("/" + name))
    texts = read_bytes(root, found).withColumn("value", F.col("content").cast("string"))
    lines = texts.where(F.is_valid_utf8("value")).select(
        F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"),
        F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"),
    )
    return parse_ignore_rules(lines)


# Rules that every task may hold; more meet the entries by a shuffle of both.
FEW_RULES = 20_000


def drop_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no rule excludes, by the last matching rule for the file and each folder above.

    Files meet rules by equality on the folder of the ignore file: every folder above an entry is
    one join key. A file below an excluded folder stays excluded whatever later rules say.

    An entry has a row per folder above it, which the planner's estimate from the listing's bytes
    leaves out. The rules are therefore staged, and by their number it is said which way they meet
    the entries: these are never sent to the driver as the smaller side.
    """
    staged = stage(rules, "rules")
    rules = staged.df.hint("broadcast" if staged.rows <= FEW_RULES else "merge")
    parts = F.split("path", "/")
    prefix = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    entries = files.select(
        "path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), F.size(parts).alias("total")
    ).select("path", prefix(F.col("n")).alias("entry"), (F.col("n") < F.col("total")).alias("is_dir"))
    above = F.split("entry", "/")
    keyed = entries.withColumn("up", F.explode(F.sequence(F.lit(0), F.size(above) - 1))).select(
        "path",
        "entry",
        "is_dir",
        F.array_join(F.slice(above, F.lit(1), F.col("up")), "/").alias("dir"),
    )
    inner = F.when(F.col("dir") == "", F.col("entry")).otherwise(
        F.substr(F.col("entry"), F.length("dir") + 2)
    )
    matched = keyed.join(rules, "dir").where(
        F.rlike(inner, F.col("regex")) & (~F.col("only_dirs") | F.col("is_dir"))
    )
    excluded = (
        matched.groupBy("path", "entry")
        .agg(F.max_by("negated", "ord").alias("negated"))
        .where("NOT negated")
        .select("path")
        .distinct()
    )
    return files.join(excluded, "path", "left_anti")
