"""Data-quality checks: one pass of conditional counts over the staged events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstream.functions.scalar import ADDRESS


@dataclass
class CheckResult:
    name: str
    passed: bool
    detail: str


def dq_checks(staged: DataFrame, raw: DataFrame, expected_token: str) -> DataFrame:
    """One row a check: name, violations.  Null addresses do not violate their format."""
    keys = F.concat("transaction_hash", F.lit("-"), F.col("log_index").cast("string"))
    odd = lambda c: F.count_if(~F.col(c).rlike(ADDRESS))
    counted = {
        "transaction_hash_not_null": F.count_if(F.col("transaction_hash").isNull()),
        "block_number_nonnegative": F.count_if(F.col("block_number") < 0),
        "log_index_nonnegative": F.count_if(F.col("log_index") < 0),
        "from_address_format_valid": odd("from_address"),
        "to_address_format_valid": odd("to_address"),
        "amount_nonnegative": F.count_if((F.col("amount") < 0) | (F.col("raw_amount") < 0)),
        "token_contract_matches_expected": F.count_if(F.col("token_address") != expected_token.lower()),
        "block_timestamp_not_null": F.count_if(F.col("block_timestamp").isNull()),
    }
    # Repeats of ids and keys come from one grouping instead of a distinct count each.
    one = staged.agg(*(c.alias(n) for n, c in counted.items()), F.count("*").alias("_rows"))
    by_key = staged.groupBy("transaction_hash", "log_index").agg(F.count("*").alias("n"), F.count("event_id").alias("ids"))
    keyed = by_key.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, 1)), F.lit(0)).alias("no_duplicate_transaction_hash_log_index"), F.sum("n").alias("_n"), F.count_if(F.col("ids") > 0).alias("_ids"))
    raw_keys = raw.select(keys.alias("k")).where("k IS NOT NULL").distinct().agg(F.count("*").alias("_raw"))
    both = one.crossJoin(keyed).crossJoin(raw_keys)
    both = both.withColumn("event_id_unique", F.col("_rows") - F.col("_ids")).withColumn("normalized_row_count_matches_deduped_raw", F.abs(F.col("_rows") - F.col("_raw")))
    names = [*counted, "event_id_unique", "no_duplicate_transaction_hash_log_index", "normalized_row_count_matches_deduped_raw"]
    return both.select(*(F.col(n).cast("long").alias(n) for n in names)).unpivot([], names, "check_name", "violations").withColumn("passed", F.col("violations") == 0)


def run_checks(staged: DataFrame, raw: DataFrame, expected_token: str) -> list[CheckResult]:
    return [CheckResult(r["check_name"], r["passed"], f"{r['violations']} violations") for r in dq_checks(staged, raw, expected_token).collect()]


def all_passed(results: list[CheckResult]) -> bool:
    return all(r.passed for r in results)
