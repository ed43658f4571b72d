"""End-to-end preprocessing (F4): clean -> dedup -> timestamp -> encode -> features ->
stratified split -> scale (fit on train) -> optional parquet sink partitioned by split."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators import clean, scale, split


@dataclass
class PrepResult:
    data: DataFrame          # key, pass-through columns, label_id, scaled features, split
    label_map: DataFrame     # (label, label_id)
    scaler: DataFrame        # (feature, mean, std)
    features: list


def prep_pipeline(df: DataFrame, key: str, label_col: str | None = None,
                  rate_cols=clean.RATE_COLUMNS, test_size: float = 0.2, seed: int = 42,
                  passthrough=("ts",), output_dir: str | None = None, materialize: str | None = "persist") -> PrepResult:
    """``materialize``: None (lazy), "persist" (memory+disk, recomputed from lineage if an
    executor is lost) or "checkpoint" (reliable copy in spark.checkpoint.dir, lineage cut)."""
    label_col = label_col or clean.resolve_label_column(df)
    d = clean.dedup_rows(clean.remove_infinite_values(df, rate_cols), key)
    if clean.resolve_column(d, clean.TIMESTAMP_CANDIDATES) is not None:
        d = clean.parse_ts(d)
    if materialize == "persist":
        d = d.persist(StorageLevel.MEMORY_AND_DISK)
    elif materialize == "checkpoint":
        d = d.checkpoint(eager=True)
    enc, lm = clean.label_encode(d, label_col, "label_id")
    keep = [c for c in passthrough if c in enc.columns]
    features = clean.numeric_columns(enc, exclude=[key, "label_id", *keep])
    sp = split.stratified_split(enc, key, "label_id", test_size, seed)
    stats = scale.scaler_fit(sp.where("split = 'train'"), features)
    scaled = scale.scaler_apply(sp, scale.collect_stats(stats))
    out = scaled.select(key, *keep, F_label(label_col), "label_id", *features, "split")
    if output_dir:
        out.write.mode("overwrite").partitionBy("split").parquet(f"{output_dir}/data")
        lm.coalesce(1).write.mode("overwrite").json(f"{output_dir}/label_map")
        stats.coalesce(1).write.mode("overwrite").json(f"{output_dir}/scaler")
    return PrepResult(out, lm, stats, features)


def F_label(label_col):
    from pyspark.sql import functions as F
    return F.col(f"`{label_col}`").alias("label")
