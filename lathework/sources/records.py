"""Readers and writers of record files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.operators import dedup


def _files(spark: SparkSession, path: str) -> list[tuple[str, bytes]]:
    """(path, first bytes) of every file under ``path``, through the file system the path names; four bytes of each are read."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    each = fs.listFiles(root, True)
    while each.hasNext():
        at = each.next().getPath()
        if at.getName().startswith(("_", ".")):
            continue
        stream = fs.open(at)
        try:
            found.append((at.toString(), bytes(b for b in (stream.read() for _ in range(4)) if b >= 0)))
        finally:
            stream.close()
    return found


def is_parquet(spark: SparkSession, path: str) -> bool:
    """Look at the first bytes of every file: a file may carry the ending of the other format."""
    heads = [head == b"PAR1" for _, head in _files(spark, path)]
    return bool(heads) and all(heads)


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines or parquet, whichever the bytes of each file are. Strict raises on a malformed line, otherwise it is dropped."""
    files = _files(spark, path)
    columnar, plain = [p for p, head in files if head == b"PAR1"], [p for p, head in files if head != b"PAR1"]
    lines = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(plain or [path]) if plain or not files else None
    if not columnar:
        return lines
    table = spark.read.parquet(*columnar)
    return table if lines is None else table.unionByName(lines, allowMissingColumns=True)


def write_records(df: DataFrame, path: str, columnar: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path) if columnar else df.write.mode(mode).json(path)


# Where a run keeps its tables, first to last resort, and what of it may leave the house.
ATTEMPTS = ("attempts.jsonl", "attempts.parquet", "run/attempts.jsonl", "run/attempts.parquet")
RESULTS = ("instance_results.jsonl", "validation.jsonl", "eval/instance_results.jsonl", "eval/validation.jsonl")
SOURCE_ADJACENT = ("attempts.jsonl", "instance_results.jsonl", "router_train.parquet", "report.html")


def located(spark: SparkSession, folder: str, names: Sequence[str]) -> str:
    """The first of ``names`` that the folder has; none, or several of one rank in different folders, is an error."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    have = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, n))]
    if not have:
        raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")
    if "/" not in have[0] and any("/" in n for n in have):
        raise ValueError(f"{folder} holds several tables of the kind: {', '.join(have)}")
    return f"{folder.rstrip('/')}/{have[0]}"


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A plan's configuration (JSON): its solvers as a table, and the rest as a dictionary."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small configuration file
    config = json.loads(text)
    solvers = [(s["id"], s.get("provider", ""), s.get("model", "")) for s in config.pop("solvers", [])]
    if len({s[0] for s in solvers}) != len(solvers) or any(not s[0] for s in solvers):
        raise ValueError("a solver without an id, or two of one id")
    return spark.createDataFrame(solvers, "solver_id string, provider string, model_name string"), config


def read_listing(spark: SparkSession, path: str, key: str, schema: str, wrapper: str | None = None, last: bool = True) -> DataFrame:
    """Rows out of a JSON array, an object holding the array under ``wrapper``, or JSON lines; one row an id.

    ``schema`` is the DDL of one row and holds ``key``. The last (or first) row of an id counts,
    by file and by position in it. A listing is a small hand-made file, read whole.
    """
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"), F.input_file_name().alias("file"))
    row = f"STRUCT<{', '.join(': '.join(c.strip().split(' ', 1)) for c in schema.split(','))}>"
    array = F.from_json("value", f"ARRAY<{row}>")
    if wrapper:
        array = F.coalesce(F.from_json("value", f"STRUCT<{wrapper}: ARRAY<{row}>>")[wrapper], array)
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, row))
    is_array = F.col("value").startswith("[")
    wrapped = F.from_json("value", f"STRUCT<{wrapper}: ARRAY<{row}>>")[wrapper].isNotNull() if wrapper else F.lit(False)
    rows = whole.select("file", F.posexplode(F.when(is_array | wrapped, array).otherwise(lines)).alias("pos", "r")).select(F.struct("file", "pos").alias("pos"), "r.*").filter(F.col(key).isNotNull() & (F.col(key) != ""))
    pick = dedup.last_per if last else dedup.first_per
    return pick(rows, [key], ["pos"]).drop("pos")


def require_filled(df: DataFrame, key: str) -> DataFrame:
    """Fail the job where ``key`` is blank."""
    return df.withColumn(key, F.when(F.coalesce(F.trim(key), F.lit("")) == "", F.raise_error(F.lit(f"blank {key}"))).otherwise(F.col(key)))


def predictions(runs: DataFrame) -> DataFrame:
    """The rows with a patch and both ids, in the three columns a harness reads."""
    ok = "coalesce(length(model_patch), 0) > 0 and coalesce(solver_id, '') <> '' and coalesce(instance_id, '') <> ''"
    return runs.filter(ok).select("instance_id", F.col("solver_id").alias("model_name_or_path"), "model_patch")


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report of a few rows as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row report as one JSON object."""
    df.coalesce(1).write.mode("overwrite").json(path)


def bundle_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, privacy_class) of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    near = F.substring_index("path", "/", -1).isin(*SOURCE_ADJACENT)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.when(near, "source_adjacent").otherwise("metadata").alias("privacy_class"))


def bundle_id(manifest: DataFrame) -> str:
    """One id for the whole bundle out of its files' hashes, in order of path (a bundle is a handful of files)."""
    rows = manifest.orderBy("path").select(F.substring_index("path", "/", -1).alias("path"), "sha256", "bytes").collect()
    body = json.dumps([{"path": r[0], "sha256": r[1], "byte_size": r[2]} for r in rows], sort_keys=True, separators=(",", ":"))
    return "art_" + hashlib.sha256(body.encode()).hexdigest()[:24]


def dataset_version(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One hash of a whole table whatever its order: the sum and the xor of its rows' hashes, hashed, so nothing is collected."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    whole = rows.agg(F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"), F.count("*").alias("n"))
    return whole.select(F.sha2(F.concat_ws("|", F.col("s").cast("string"), F.col("x").cast("string"), F.col("n").cast("string")), 256).alias("version"))
