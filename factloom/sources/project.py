"""Projects as DataFrames: listing, reading and parsing source files, package files, source maps."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lowering import SCHEMAS, facts_of

# Folders that hold no source of the project, and its package files.
SKIPPED = ["oh_modules", "node_modules", "ets-loader"]
PACKAGE_FILE, BUILD_SCRIPT = "oh-package.json5", "hvigorfile.ts"
# How imports of the system's libraries begin.
SYSTEM_IMPORTS = ["@ohos.", "@kit."]


# The keys of a project's configuration that are read, and their meaning when absent.
CONFIG = {"targetProjectName": "", "targetProjectDirectory": "", "logPath": "", "etsSdkPath": "", "otherSdks": []}


def read_config(spark: SparkSession, path: str) -> dict:
    """A project's configuration: name, directory, log path and SDKs, other keys passed over; a missing file raises."""
    found = read_json5(spark.read.option("wholetext", True).text(path).first()[0]) or {}
    return {k: found.get(k, default) for k, default in CONFIG.items()}


def config_of(directory: str) -> dict:
    """The configuration of a project that has no file of its own: its folder's name and the folder."""
    return {**CONFIG, "targetProjectName": directory.rstrip("/").rpartition("/")[2], "targetProjectDirectory": directory}


def sdk_files(spark: SparkSession, config: dict) -> DataFrame:
    """(sdk, path, code): the declaration files of each SDK that a configuration names."""
    sdks = [("ets", config["etsSdkPath"])] if config["etsSdkPath"] else []
    sdks += [(x["name"], x["path"]) for x in config["otherSdks"]]
    out = spark.createDataFrame([], "sdk string, path string, code string")
    for name, folder in sdks:
        out = out.unionByName(list_files(spark, folder, [".d.ts", ".d.ets"], True).select(F.lit(name).alias("sdk"), "path", "code"))
    return out


def original_paths(files: DataFrame) -> DataFrame:
    """(path, original): what a generated file was made of: ``x.ts`` of ``x.ets`` where there is a map ``x.ts.map``, else itself."""
    maps = files.where(F.endswith("path", F.lit(".map"))).select(F.regexp_replace("path", r"\.map$", "").alias("path"), F.lit(True).alias("mapped")).distinct()
    original = F.when(F.col("mapped") & F.endswith("path", F.lit(".ts")), F.regexp_replace("path", r"\.ts$", ".ets")).otherwise(F.col("path"))
    return files.where(~F.endswith("path", F.lit(".map"))).join(maps, "path", "left").select("path", original.alias("original"))


def list_files(spark: SparkSession, root: str, extensions: list[str], is_sdk: bool = False) -> DataFrame:
    """(path, code, is_sdk) of the files under ``root`` with one of the extensions, paths relative to it; none where there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "path string, code string, is_sdk boolean")
    found = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(root).select(F.col("value").alias("code"), F.input_file_name().alias("full"))
    relative = F.regexp_replace("full", "^.*?" + re.escape(re.sub(r"^\w+:/*", "/", root).rstrip("/")) + "/", "")
    ends = F.lit(False)
    for e in extensions:
        ends = ends | F.endswith(F.col("path"), F.lit(e))
    inside = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in SKIPPED]))
    return found.withColumn("path", relative).where(ends & ~inside).select("path", "code", F.lit(is_sdk).alias("is_sdk"))


def governing_packages(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, packages): each file's package files from the root down, by the folders that its path starts with; build scripts have none."""
    files = files.where(~F.col("path").rlike(rf"(^|/){re.escape(BUILD_SCRIPT)}$"))
    parts = F.split("path", "/")
    depth = F.size(parts)
    folders = files.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), depth - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "folder"))
    held = packages.select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.col("path").alias("package"))
    found = folders.join(held, "folder").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "package"))), lambda x: x["package"]).alias("packages"))
    return files.select("path").join(found, "path", "left").select("path", F.coalesce("packages", F.array().cast("array<string>")).alias("packages"))


def parse_files(files: DataFrame, project: str) -> DataFrame:
    """(table, path, row): the facts of each (path, code), rows as JSON. A file that can't be parsed gives one row of ``error``."""

    def run(batches):
        for batch in batches:
            for path, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = [(t, path, json.dumps(r)) for t, r in facts_of(project, path, code or "")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*got)], ["table", "path", "row"])

    return files.select("path", "code").mapInArrow(run, "table string, path string, row string")


class Program:
    """The facts of a project, by table, with typed columns.

    Parsed facts are written once, in a folder a table; a table's rows get their types when it is first asked for and are stored like
    that. ``sdk_paths`` are a column ``path`` of files that are not the project's own.
    """

    def __init__(self, parsed: DataFrame, sdk_paths: DataFrame | None = None):
        from ..tables import Cleaning, fresh_dir

        self.spark, self.path, self.sdk_paths = parsed.sparkSession, fresh_dir(parsed.sparkSession, "facts"), sdk_paths
        with Cleaning(self.spark):
            parsed.select("table", "path", "row").write.partitionBy("table").parquet(self.path)
        self.tables: dict[str, DataFrame] = {}

    def __getitem__(self, table: str) -> DataFrame:
        from ..tables import durable

        if table not in self.tables:
            stored = self.spark.read.schema("path string, row string, table string").option("basePath", self.path).parquet(self.path).where(F.col("table") == table)
            self.tables[table] = durable(stored.select("path", F.from_json("row", SCHEMAS[table]).alias("r")).select("path", "r.*"), table)
        return self.tables[table]

    def own(self, table: str) -> DataFrame:
        """A table's rows of the project's own files."""
        return self[table] if self.sdk_paths is None else self[table].join(self.sdk_paths.select("path"), "path", "left_anti")


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content hash is not among the (path, hash) known: what an incremental run has to parse again."""
    return files.withColumn("hash", F.sha2("code", 256)).join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def import_files(imports: DataFrame, packages: DataFrame | None = None, sdks: DataFrame | None = None) -> DataFrame:
    """(path, from_spec, kind, file): where each import of (path, from_spec) leads, without extension.

    Relative ones lead to the project's own files, those of ``SYSTEM_IMPORTS`` to the system's SDK, names of (name) ``sdks`` to those, and
    what starts with a dependency (name, target) of ``packages`` to its target; of several dependencies the last of the order that they
    are declared in (ord) counts.
    """
    spark = imports.sparkSession
    base = imports.select("path", "from_spec").distinct().withColumn("own", import_target(F.col("path"), F.col("from_spec")))
    head = F.regexp_extract("from_spec", "^((?:@[^/]+/)?[^/]+)", 1)
    base = base.withColumn("head", head).withColumn("system", F.array_contains(F.array(*[F.startswith("from_spec", F.lit(x)) for x in SYSTEM_IMPORTS]), True))
    named = (sdks if sdks is not None else spark.createDataFrame([], "name string")).select(F.col("name").alias("head"), F.lit(True).alias("is_sdk")).distinct()
    given = packages if packages is not None else spark.createDataFrame([], "name string, target string, ord int")
    last = given.groupBy(F.col("name").alias("head")).agg(F.max_by("target", "ord").alias("target"))
    both = base.join(named, "head", "left").join(last, "head", "left")
    rest = F.expr("substring(from_spec, length(head) + 1)")
    kind = F.when(F.col("own").isNotNull(), "own").when(F.col("system"), "system").when(F.col("is_sdk"), "sdk").when(F.col("target").isNotNull(), "dependency").otherwise("unknown")
    file = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("system") | F.col("is_sdk"), F.col("from_spec")).when(F.col("target").isNotNull(), F.concat("target", rest))
    return both.select("path", "from_spec", kind.alias("kind"), file.alias("file"))


def import_target(path: Column, spec: Column) -> Column:
    """The project path that a relative import names, without extension; null for other imports."""
    from ..functions.text import posix_path, without_extension

    folder = F.regexp_replace(path, "[^/]*$", "")
    return F.when(spec.rlike(r"^\.\.?/"), posix_path(F.concat(folder, without_extension(spec))))


# --- JSON5
JSON5 = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|([-+]?(?:0x[\da-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|Infinity|NaN))(?![\w$])|([A-Za-z_$][\w$]*)|([{}\[\]:,])""", re.S)


def read_json5(text: str):
    """The value of a JSON5 text, numbers as their text; the first object where the root is an array; None for anything else."""
    toks, at = [], 0
    while at < len(text):
        m = JSON5.match(text, at)
        if not m:
            return None
        at = m.end()
        if m.lastgroup or m.lastindex:
            toks.append((m.lastindex, m[m.lastindex]))
    toks.reverse()

    def value():
        kind, t = toks.pop()
        if kind == 1:
            return json.loads('"' + re.sub(r'\\\n|(?<!\\)"', lambda x: "" if x[0] != '"' else '\\"', re.sub(r"\\'", "'", t[1:-1])) + '"')
        if kind == 2:
            return t
        if kind == 3:
            return {"true": True, "false": False}.get(t)
        if t == "{":
            out = {}
            while toks[-1][1] != "}":
                k, name = toks.pop()
                out[name[1:-1] if k == 1 else name] = (toks.pop(), value())[1]
                if toks[-1][1] == ",":
                    toks.pop()
            toks.pop()
            return out
        if t == "[":
            out = []
            while toks[-1][1] != "]":
                out.append(value())
                if toks[-1][1] == ",":
                    toks.pop()
            toks.pop()
            return out
        raise IndexError

    try:
        found = value()
    except (IndexError, ValueError):
        return None
    if isinstance(found, list):
        found = next((x for x in found if isinstance(x, dict)), None)
    return found if isinstance(found, dict) else None


def read_packages(text: str, keys: list[str]):
    """A function for ``mapInArrow`` that replaces the JSON5 text in column ``text``, the last, by the values at dotted ``keys``, as text, null where there is none."""

    def at(value, key: str) -> str | None:
        for k in key.split("."):
            value = value.get(k) if isinstance(value, dict) else None
        return value if value is None or isinstance(value, str) else json.dumps(value)

    def run(batches):
        for batch in batches:
            found = [read_json5(t) if t is not None else None for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            others = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in others], *[pa.array([at(v, k) for v in found], pa.string()) for k in keys]], [*others, *keys])

    return run


# --- source maps
DIGITS = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}


def decode_mappings(text: str) -> list[tuple[int, int, int, int]]:
    """(line, column, original line, original column) of a source map's mappings; lines from 1, columns from 0."""
    out, source_line, source_col = [], 0, 0
    for line, part in enumerate(text.split(";"), 1):
        column = 0
        for seg in filter(None, part.split(",")):
            values, value, shift = [], 0, 0
            for c in seg:
                d = DIGITS[c]
                value |= (d & 31) << shift
                shift += 5
                if not d & 32:
                    values.append(-(value >> 1) if value & 1 else value >> 1)
                    value = shift = 0
            column += values[0]
            if len(values) >= 4:
                source_line += values[2]
                source_col += values[3]
                out.append((line, column, source_line + 1, source_col))
    return out


def original_positions(positions: DataFrame, maps: DataFrame) -> DataFrame:
    """(path, line, col, original_line, original_col): each position's first mapping at or after it on its line, (0, 0) if none.

    ``maps`` are (path, mappings), the text of each file's mappings.
    """
    from ..operators.resolve import next_position

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(f"{path}\n{a}", b, c << 32 | d) for a, b, c, d in decode_mappings(text or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["k", "at", "v"])

    marks = maps.select("path", "mappings").mapInArrow(run, "k string, at long, v long").groupBy("k", "at").agg(F.min("v").alias("v"))
    asked = positions.select("path", "line", "col", F.concat_ws("\n", "path", "line").alias("k"), F.col("col").cast("long").alias("at"))
    found = next_position(asked, marks, "k", "at", "v").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
    return found.select("path", "line", "col", F.shiftrightunsigned("v", 32).cast("int").alias("original_line"), F.col("v").bitwiseAND(0xFFFFFFFF).cast("int").alias("original_col"))
