"""Relation schemas as DDL, and an idempotent bootstrap of empty parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS: dict[str, str] = {
    "assets": "id BIGINT, name STRING, source STRING, url STRING, category STRING, license STRING, variant STRING, file_path STRING, created_at TIMESTAMP",
    "removal_reasons": "id BIGINT, code STRING, description STRING",
    "removals": "id BIGINT, asset_id BIGINT, reason_id BIGINT, details STRING, removed_at TIMESTAMP",
    "checks": "id BIGINT, asset_id BIGINT, completeness_score DOUBLE, missing_glyphs STRING, is_duplicate BOOLEAN, duplicate_group_id BIGINT, keep_in_group BOOLEAN, connectivity_score DOUBLE, contextual_score DOUBLE, is_cursive BOOLEAN, prefilter_image_path STRING, prefilter_ocr_text STRING, prefilter_confidence DOUBLE, prefilter_passed BOOLEAN, updated_at TIMESTAMP",
    "characters": "id BIGINT, asset_id BIGINT, char STRING, image_path STRING, strokes_raw STRING, strokes_processed STRING, point_count INT, best_ocr_result STRING, best_ocr_confidence DOUBLE, best_ocr_match BOOLEAN, quality_score DOUBLE, created_at TIMESTAMP, markers STRING, shape_params_cache STRING, template_variant STRING",
    "ocr_runs": "id BIGINT, character_id BIGINT, stage STRING, image_path STRING, ocr_result STRING, ocr_confidence DOUBLE, ocr_match BOOLEAN, model STRING, created_at TIMESTAMP",
    "test_runs": "id BIGINT, asset_id BIGINT, run_date STRING, chars_tested INT, chars_ok INT, avg_score DOUBLE, avg_coverage DOUBLE, avg_overshoot DOUBLE, avg_stroke_count DOUBLE, avg_topology DOUBLE, results_json STRING",
    "test_run_images": "id BIGINT, run_id BIGINT, char STRING, image_data BINARY",
    "jobs": "id BIGINT, source STRING, status STRING, current_category STRING, current_page INT, categories_total INT, categories_done INT, found INT, downloaded INT, failed INT, started_at TIMESTAMP, completed_at TIMESTAMP, error_message STRING, created_at TIMESTAMP",
    "staged": "id BIGINT, job_id BIGINT, name STRING, url STRING, download_url STRING, category STRING, status STRING, file_path STRING, error_message STRING, created_at TIMESTAMP",
    "logs": "id BIGINT, job_id BIGINT, level STRING, message STRING, created_at TIMESTAMP",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def bootstrap(spark: SparkSession, database: str = "default") -> None:
    """Create every table that does not exist yet."""
    for name, ddl in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")


def migrate(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the columns (name -> type) that are absent, as nulls."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
