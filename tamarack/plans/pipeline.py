"""A resumable stage runner and the build-splits flow."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ManifestError
from ..operators import splits, validate, vocab
from ..sources.records import write_json_file
from .staging import stage

class Stages:
    """Runs named stages once; a stage is complete when its status file says so and its check holds."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def status(self, name: str) -> dict | None:
        path = self.folder / name / "status.json"
        return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None

    def run(self, name: str, work: Callable[[Path], dict], check: Callable[[Path], bool] | None = None, after: tuple[str, ...] = ()) -> dict:
        missing = [a for a in after if (self.status(a) or {}).get("status") != "complete"]
        if missing:
            raise ManifestError(f"stages not complete: {', '.join(missing)}")
        done = self.status(name)
        if done and done.get("status") == "complete" and (check is None or check(self.folder / name)):
            return done
        (self.folder / name).mkdir(parents=True, exist_ok=True)
        report = work(self.folder / name) or {}
        report = {"status": "complete", "completed_at": datetime.now(timezone.utc).isoformat(), **report}
        write_json_file(self.folder / name / "status.json", report)
        return report


def build_splits(fields: DataFrame, order: str, out: str, fraction: float = 0.1, seed: int = 42, languages=validate.LANGUAGES) -> dict:
    """Scan, canonicalise, reject, split and write manifest, rejects, vocabulary and report as tables."""
    records = stage(validate.check_records(fields, languages), "records")  # read twice below, worked out once
    checked = stage(validate.reject_duplicates(records, order), "checked")
    accepted = checked.where("reason IS NULL").drop("reason")
    if accepted.isEmpty():
        raise ManifestError("no record was accepted")
    splits.require_groups(accepted, languages)
    split = stage(splits.grouped_split(accepted, fraction, seed).withColumn("split", F.col("new_split")).drop("new_split"), "split")
    if not splits.leaking_groups(split, split="split").isEmpty():
        raise ManifestError("a group stands in two splits")
    split.drop("group").write.mode("overwrite").parquet(f"{out}/manifest")
    checked.where("reason IS NOT NULL").select(F.col(order).alias("row_number"), "reason").write.mode("overwrite").parquet(f"{out}/rejected")
    vocab.require_characters(split.where("split = 'train'"), "transcription").write.mode("overwrite").parquet(f"{out}/vocabulary")
    splits.split_counts(split).write.mode("overwrite").parquet(f"{out}/report_rows")
    splits.split_hours(split).write.mode("overwrite").parquet(f"{out}/report_hours")
    return {"accepted": split.count(), "rejected": checked.where("reason IS NOT NULL").count()}
