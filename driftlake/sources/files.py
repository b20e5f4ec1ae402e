"""Readers and writers of results: logs, metrics, sweeps, findings and tables.

Schemas are stated, so nothing is inferred from the files; malformed rows are dropped or
kept apart as asked."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = (
    "concept_re_id_accuracy assignment_entropy wrong_memory_reuse_rate assignment_switch_rate avg_clients_per_concept singleton_group_ratio"
    " memory_reuse_rate routing_consistency worst_window_dip worst_window_recovery accuracy_auc final_accuracy budget_normalized_score total_bytes"
).split()
LOG_SCHEMA = "method string, ground_truth array<array<int>>, predicted array<array<int>>, accuracy_curve array<array<double>>, total_bytes double, soft_assignments array<array<array<double>>>"
METRICS_SCHEMA = ", ".join(f"{m} double" for m in METRICS)
CONFIG_SCHEMA = "generator_type string, rho string, alpha double, delta double, K int, T int, seed long, method string"
FINDING_SCHEMA = "id string, kind string, title string, status string, dataset string, tags array<string>, created_at string, body string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An experiment log as a grid (method, client, t, gt, pred, acc)."""
    log = spark.read.schema(LOG_SCHEMA).option("multiLine", True).json(path)
    rows = log.select("method", "total_bytes", F.posexplode(F.arrays_zip("ground_truth", "predicted", "accuracy_curve")).alias("client", "r"))
    cells = rows.select("method", "total_bytes", F.col("client").cast("long").alias("client"), F.posexplode(F.arrays_zip(F.col("r.ground_truth").alias("gt"), F.col("r.predicted").alias("pred"), F.col("r.accuracy_curve").alias("acc"))).alias("t", "c"))
    return cells.select("method", "total_bytes", "client", F.col("t").cast("long").alias("t"), F.col("c.gt").cast("long").alias("gt"), F.col("c.pred").cast("long").alias("pred"), F.col("c.acc").alias("acc"))


def read_soft(spark: SparkSession, path: str) -> DataFrame:
    """Its soft assignments in sparse long form (client, t, concept, p)."""
    log = spark.read.schema(LOG_SCHEMA).option("multiLine", True).json(path)
    by = log.select(F.posexplode("soft_assignments").alias("client", "a")).select("client", F.posexplode("a").alias("t", "b")).select("client", "t", F.posexplode("b").alias("concept", "p"))
    return by.select(*[F.col(c).cast("long").alias(c) for c in ("client", "t", "concept")], "p").where("p > 0")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a results folder: each subfolder's config.json joined to its metrics.json; malformed files are left out."""

    def read(name: str, schema: str) -> DataFrame:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(folder)
        return rows.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))

    both = read("config.json", CONFIG_SCHEMA).join(read("metrics.json", METRICS_SCHEMA), "run")
    return both.withColumn("rho", F.when(F.lower("rho") == "inf", F.lit(float("inf"))).otherwise(F.col("rho").try_cast("double")))


def read_sweep_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("positiveInf", "inf").option("negativeInf", "-inf").option("nanValue", "nan").csv(path)


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """Doubles with fixed digits, empty for null."""
    at = lambda c: F.col(f"`{c}`")
    shown = [F.when(at(c).isNull(), "").otherwise(F.format_string(f"%.{digits}f", at(c))).alias(c) if t in ("double", "float") else at(c) for c, t in df.dtypes]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nulls are written out; infinities as the text "inf"."""
    text = lambda c: F.when(F.col(c) == float("inf"), F.lit("inf")).when(F.col(c) == float("-inf"), F.lit("-inf")).otherwise(F.col(c).cast("string"))
    has = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) == float("inf"))
    doubles = [c for c, t in df.dtypes if t == "double"]
    found = df.agg(*[F.max(has(c)).alias(c) for c in doubles]).first() if doubles else None
    odd = {c for c in doubles if found[c]}
    df.select(*[text(c).alias(c) if c in odd else F.col(c) for c in df.columns]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_log(grid: DataFrame, path: str, about: dict) -> None:
    """A run's log: its cells as Parquet and what is known of it (method, bytes and so on) as one JSON row."""
    grid.write.mode("overwrite").parquet(f"{path}/cells")
    write_json(grid.sparkSession.createDataFrame([about]), f"{path}/about")


def write_phase_diagram(diagram: DataFrame, path: str, about: dict) -> None:
    """A phase diagram as Parquet beside one JSON row of what its axes and metric are."""
    diagram.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    write_json(diagram.sparkSession.createDataFrame([about]), f"{path}/about")


def read_phase_diagram(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/cells"), spark.read.json(f"{path}/about").first().asDict()


def write_conditions(rows: DataFrame, path: str, condition: list[str]) -> None:
    """CSV files, a folder for each condition; all rows of a condition are in one file."""
    rows.repartition(*condition).sortWithinPartitions(*condition).write.mode("overwrite").option("header", True).partitionBy(*condition).csv(path)


def promote_findings(rows: DataFrame, path: str, ids: list[str]) -> int:
    """Writes findings as one markdown file each below ``path``; returns how many."""
    text = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    chosen = rows.where(F.col("id").isin(*ids)).select(F.regexp_replace("id", "[^A-Za-z0-9_-]", "-").alias("name"), text.alias("value"))
    chosen.write.mode("overwrite").partitionBy("name").text(path)
    return chosen.count()


def write_dataset(samples: DataFrame, path: str) -> None:
    """Samples placed and partitioned by client and step, one file each."""
    samples.repartition("client", "t").write.mode("overwrite").partitionBy("client", "t").parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(F.col("client").cast("long").alias("client"), F.col("t").cast("long").alias("t"), *[c for c in rows.columns if c not in ("client", "t")])


def with_held_out(train: DataFrame, test: DataFrame) -> DataFrame:
    """Evaluation rows: a cell's test rows where it has some, else its training rows."""
    cells = test.select("client", "t").distinct()
    return test.unionByName(train.join(cells, ["client", "t"], "left_anti"))


def findings(spark: SparkSession, path: str, kind: str | None = None, status: str | None = None, dataset: str | None = None, tag: str | None = None, text: str | None = None) -> DataFrame:
    rows = spark.read.schema(FINDING_SCHEMA).json(path)
    for column, value in (("kind", kind), ("status", status), ("dataset", dataset)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if tag is not None:
        rows = rows.where(F.array_contains("tags", tag))
    if text is not None:
        rows = rows.where(F.lower(F.concat_ws(" ", "title", "body")).contains(text.lower()))
    return rows


def add_finding(spark: SparkSession, path: str, finding: dict) -> None:
    spark.createDataFrame([json.dumps(finding)], "string").select(F.from_json("value", FINDING_SCHEMA).alias("f")).select("f.*").write.mode("append").json(path)


def audit_findings(rows: DataFrame, known_files: DataFrame, references: DataFrame) -> DataFrame:
    """(issue, id): repeated ids, missing titles, references to unknown ids or files."""
    twice = rows.groupBy("id").count().where("count > 1").select(F.lit("repeated id").alias("issue"), "id")
    bare = rows.where("title is null or trim(title) = ''").select(F.lit("no title").alias("issue"), "id")
    unknown = references.where("kind = 'finding'").join(rows.select(F.col("id").alias("target")), "target", "left_anti").select(F.lit("unknown id").alias("issue"), "id")
    lost = references.where("kind = 'file'").join(known_files.select(F.col("path").alias("target")), "target", "left_anti").select(F.lit("missing file").alias("issue"), "id")
    return twice.unionByName(bare).unionByName(unknown).unionByName(lost)


def latex_table(df: DataFrame, row: str, column: str, mean: str = "mean", std: str = "std", digits: int = 3) -> str:
    """A small result as LaTeX, the best of each column bold. The table is bounded by its methods and settings."""
    cells = df.select(row, column, mean, std).toPandas()
    rows, columns = sorted(cells[row].unique()), sorted(cells[column].unique())
    best = cells.groupby(column)[mean].max()
    lines = ["\\begin{tabular}{l" + "c" * len(columns) + "}", " & ".join(["", *map(str, columns)]) + " \\\\"]
    at = {(r[row], r[column]): r for r in cells.to_dict("records")}
    for r in rows:
        texts = [str(r)]
        for c in columns:
            cell = at.get((r, c))
            if cell is None or cell[mean] != cell[mean]:
                texts.append("--")
                continue
            text = f"{cell[mean]:.{digits}f} $\\pm$ {(cell[std] or 0.0):.{digits}f}"
            texts.append(f"\\textbf{{{text}}}" if cell[mean] == best[c] else text)
        lines.append(" & ".join(texts) + " \\\\")
    return "\n".join([*lines, "\\end{tabular}"])
