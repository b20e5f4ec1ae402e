"""Command line: python -m driftlake.cli COMMAND … (or by spark-submit)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftlake.operators import budget, identity, sweep
from driftlake.plans import rounds
from driftlake.sources import files, generators


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    c = generators.GeneratorConfig(a.clients, a.steps, a.samples, float(a.rho), a.alpha, a.delta, a.kind, a.seed)
    grid = generators.concept_grid(spark, c)
    files.write_dataset(generators.samples(grid, c), f"{a.out}/{c.name}/samples")
    grid.write.mode("overwrite").parquet(f"{a.out}/{c.name}/grid")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    grid = files.read_log(spark, a.log)
    one = identity.overall(grid).crossJoin(identity.switch_rate(grid)).crossJoin(identity.group_metrics(grid)).crossJoin(budget.accuracy_auc(grid)).crossJoin(budget.worst_dip(grid))  # one row each
    files.write_json(one, a.out)


def phase(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.read_results(spark, a.folder).withColumn("value", F.col(a.metric)).withColumn("nth", F.col("run"))
    # the values become columns; Spark sorts infinity last
    values = [r[0] for r in rows.select(a.column).distinct().orderBy(a.column).collect()]
    files.write_csv(sweep.phase_diagram(rows, a.row, a.column, values, "nth").orderBy(a.row), a.out)


def run_sweep(spark: SparkSession, a: argparse.Namespace) -> None:
    settings = spark.createDataFrame(
        [(f"rho{r}_seed{s}", m, s, a.clients, a.steps, a.samples, float(r), a.alpha, a.delta, a.kind, e) for m in a.methods for r in a.rhos for s in a.seeds for e in a.every],
        "run string, method string, seed long, K long, T long, n long, rho double, alpha double, delta double, kind string, every long",
    )
    rounds.simulate(settings).write.mode("overwrite").partitionBy("method").parquet(a.out)


def budget_sweep(spark: SparkSession, a: argparse.Namespace) -> None:
    grid = spark.read.parquet(a.grid)
    curve = grid.groupBy("method", "t").agg(F.avg("acc").alias("acc"), F.sum("bytes").alias("bytes"))
    auc = F.sum("acc") - (F.min_by("acc", "t") + F.max_by("acc", "t")) / 2
    files.write_json(budget.pareto(curve.groupBy("method").agg(F.sum("bytes").alias("total_bytes"), auc.alias("accuracy_auc"))), a.out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="driftlake")
    sub = p.add_subparsers(required=True)

    def command(name: str, f, *, data: bool = False) -> argparse.ArgumentParser:
        q = sub.add_parser(name)
        q.set_defaults(run=f)
        q.add_argument("--out", required=True)
        if data:
            q.add_argument("--clients", type=int, default=5)
            q.add_argument("--steps", type=int, default=10)
            q.add_argument("--samples", type=int, default=100)
            q.add_argument("--alpha", type=float, default=0.5)
            q.add_argument("--delta", type=float, default=0.5)
            q.add_argument("--kind", choices=generators.KINDS, default="sine")
        return q

    g = command("generate", generate, data=True)
    g.add_argument("--rho", default="5")
    g.add_argument("--seed", type=int, default=42)
    e = command("evaluate", evaluate)
    e.add_argument("log")
    d = command("phase-diagram", phase)
    d.add_argument("folder")
    d.add_argument("--metric", choices=files.METRICS, default="concept_re_id_accuracy")
    d.add_argument("--row", default="rho")
    d.add_argument("--column", default="delta")
    s = command("sweep", run_sweep, data=True)
    s.add_argument("--methods", nargs="+", choices=list(rounds.METHODS), default=["FedAvg", "Oracle"])
    s.add_argument("--rhos", nargs="+", default=["5"])
    s.add_argument("--seeds", nargs="+", type=int, default=[42])
    s.add_argument("--every", nargs="+", type=int, default=[1])
    b = command("budget-sweep", budget_sweep)
    b.add_argument("grid")
    a = p.parse_args(argv)
    a.run(SparkSession.builder.appName("driftlake").getOrCreate(), a)


if __name__ == "__main__":
    main()
