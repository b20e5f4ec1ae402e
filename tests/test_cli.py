"""The command line end to end on small data."""

import json

from driftlake import cli


def test_generate_and_sweep(spark, tmp_path):
    cli.main(["generate", "--out", str(tmp_path / "data"), "--clients", "2", "--steps", "3", "--samples", "10", "--rho", "inf"])
    assert spark.read.parquet(str(tmp_path / "data/sine_rhoinf_alpha0.50_delta0.50_seed42/samples")).count() == 60
    cli.main(["sweep", "--out", str(tmp_path / "grid"), "--clients", "3", "--steps", "4", "--samples", "20", "--methods", "FedAvg", "LocalOnly", "--seeds", "1", "2"])
    assert spark.read.parquet(str(tmp_path / "grid")).count() == 48
    cli.main(["budget-sweep", str(tmp_path / "grid"), "--out", str(tmp_path / "front")])
    assert spark.read.json(str(tmp_path / "front")).count() >= 1


def test_evaluate_and_phase_diagram(spark, tmp_path):
    log = {"method": "m", "ground_truth": [[0, 1, 1], [0, 0, 1]], "predicted": [[1, 0, 0], [1, 1, 0]], "accuracy_curve": [[0.5, 0.75, 0.8], [0.6, 0.7, 0.9]]}
    (tmp_path / "log.json").write_text(json.dumps(log))
    cli.main(["evaluate", str(tmp_path / "log.json"), "--out", str(tmp_path / "metrics")])
    assert spark.read.json(str(tmp_path / "metrics")).first()["re_id"] == 1.0
    for i, delta in enumerate((0.3, 0.7)):
        (tmp_path / f"r/{i}").mkdir(parents=True)
        (tmp_path / f"r/{i}/config.json").write_text(json.dumps({"rho": "2", "delta": delta}))
        (tmp_path / f"r/{i}/metrics.json").write_text(json.dumps({"accuracy_auc": 1.0 + i}))
    cli.main(["phase-diagram", str(tmp_path / "r"), "--metric", "accuracy_auc", "--out", str(tmp_path / "table")])
    assert spark.read.option("header", True).csv(str(tmp_path / "table")).columns == ["rho", "c0.3", "c0.7"]
