"""Model registry and holdout ledger as append-only tables next to the saved models."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.operators.learn import ENSEMBLES, Calibrator, Fitted
from contestry.operators.trees import Ensemble
from contestry.sources.files import check_fingerprint, fingerprint


def _save_fitted(spark: SparkSession, m: Fitted, path: str) -> dict:
    meta = {"name": m.name, "params": m.params, "columns": m.columns, "tier": m.tier, "scales": m.scales}
    if m.name == "blend":
        meta["parts"] = [_save_fitted(spark, p, f"{path}/part{i}") for i, p in enumerate(m.parts)]
    elif m.name in ENSEMBLES:
        m.model.save(spark, f"{path}/model")
    else:
        m.model.write().overwrite().save(f"{path}/model")
    return meta


def _load_fitted(spark: SparkSession, meta: dict, path: str) -> Fitted:
    if meta["name"] == "blend":
        parts = [_load_fitted(spark, p, f"{path}/part{i}") for i, p in enumerate(meta["parts"])]
        return Fitted("blend", meta["params"], meta["columns"], meta["tier"], None, [], parts)
    model = Ensemble.load(spark, f"{path}/model") if meta["name"] in ENSEMBLES else LogisticRegressionModel.load(f"{path}/model")
    return Fitted(meta["name"], meta["params"], meta["columns"], meta["tier"], model, meta["scales"])


def register(spark: SparkSession, base: str, tier: str, model: Fitted, calibrator: Calibrator, trained_through: int, metrics: dict | None = None, activate: bool = True) -> str:
    """Save a model with its calibrator; the registry row is written last and holds the content hash."""
    run_id = uuid.uuid4().hex[:12]
    path = f"{base}/runs/{tier}-{run_id}"
    meta = {"model": _save_fitted(spark, model, path), "calibrator": {"method": calibrator.method, "a": calibrator.a, "b": calibrator.b}}
    if calibrator.method == "isotonic":
        spark.createDataFrame(calibrator.knots, "x double, y double").write.mode("overwrite").parquet(f"{path}/isotonic")
    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(tier).alias("tier"), F.lit(model.name).alias("model"), F.lit(path).alias("path"),
        F.lit(json.dumps(meta, sort_keys=True)).alias("meta_json"), F.lit(json.dumps(metrics or {}, sort_keys=True)).alias("metrics_json"),
        F.lit(int(trained_through)).alias("trained_through"), F.lit(fingerprint(spark, path, "part-*")).alias("fingerprint"),
        F.current_timestamp().alias("created_at"),
    )
    row.write.mode("append").parquet(f"{base}/registry")
    if activate:
        set_active(spark, base, run_id)
    return run_id


def set_active(spark: SparkSession, base: str, run_id: str) -> None:
    known = spark.read.parquet(f"{base}/registry").where(F.col("run_id") == run_id)
    row = known.select("tier").first()
    if row is None:
        raise ValueError(f"unknown run {run_id}")
    spark.range(1).select(F.lit(row.tier).alias("tier"), F.lit(run_id).alias("run_id"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{base}/active")


def runs(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/registry").orderBy(F.desc("created_at"))


def load_active(spark: SparkSession, base: str, tier: str) -> tuple[Fitted, Calibrator, str]:
    """The tier's active model, after its files are checked against the registered hash."""
    active = spark.read.parquet(f"{base}/active").where(F.col("tier") == tier).agg(F.max_by("run_id", "at")).first()[0]
    if active is None:
        raise ValueError(f"no active model for {tier}")
    row = spark.read.parquet(f"{base}/registry").where(F.col("run_id") == active).first()
    check_fingerprint(spark, row.path, row.fingerprint, "part-*")
    meta = json.loads(row.meta_json)
    cal = Calibrator(**meta["calibrator"])
    if cal.method == "isotonic":
        cal.knots = [tuple(r) for r in spark.read.parquet(f"{row.path}/isotonic").orderBy("x").toLocalIterator()]
    return _load_fitted(spark, meta["model"], row.path), cal, active


def log_holdout_access(spark: SparkSession, path: str, tier: str, selection: dict) -> DataFrame:
    """Append one access and return the tier's counts for this selection."""
    text = json.dumps(selection, sort_keys=True, default=str)
    row = spark.range(1).select(
        F.lit(tier).alias("tier"), F.substring(F.sha2(F.lit(text), 256), 1, 16).alias("selection_hash"), F.lit(text).alias("selection"), F.current_timestamp().alias("at")
    )
    row.write.mode("append").parquet(path)
    h = row.select("selection_hash").first()[0]
    return ledger(spark.read.parquet(path)).where((F.col("tier") == tier) & (F.col("selection_hash") == h))


def ledger(accesses: DataFrame) -> DataFrame:
    """(tier, selection_hash, first_evaluated_at, evaluations, distinct_selections, reused)."""
    per = accesses.groupBy("tier", "selection_hash").agg(F.min("at").alias("first_evaluated_at"), F.count(F.lit(1)).alias("evaluations"))
    n = per.groupBy("tier").agg(F.count(F.lit(1)).alias("distinct_selections"))
    return per.join(n, "tier").withColumn("reused_with_new_selection", F.col("distinct_selections") > 1)


def ledger_or_empty(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return ledger(spark.read.parquet(path))
    except AnalysisException:
        return None
