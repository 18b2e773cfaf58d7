"""Clean-dataset jobs: check, clean, add features, fit on train, apply to both, write, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.config import CommentConfig, TicketConfig
from voxtable.functions.values import to_long
from voxtable.operators import checks, profiling
from voxtable.operators.categories import EvidenceImputer, RareGrouping
from voxtable.operators.cleaning import clean_comments, clean_tickets, gate_no_phone
from voxtable.operators.features import (
    comment_features, ordered_comment_columns, ordered_ticket_columns, ticket_features,
)
from voxtable.operators.schema import contract_rows, rename_comment_columns, require_contract
from voxtable.sources.tables import numbered_rows, read_csv, write_clean, write_report


@dataclass(frozen=True)
class CleanPair:
    train: DataFrame
    test: DataFrame
    summary: DataFrame


def check_ticket_tables(train: DataFrame, test: DataFrame, template: DataFrame, cfg: TicketConfig, pos_col: str | None = None) -> DataFrame:
    """Column contract (raises at once) and one row per data check.

    ``pos_col`` numbers the rows of ``test`` and ``template``; with it their order is compared too.
    """
    ordered = [checks.same_order(template, test, cfg.id_col_raw, pos_col)] if pos_col else []
    train, test, template = (df.drop(pos_col) if pos_col else df for df in (train, test, template))
    require_contract(
        contract_rows(train.columns, test.columns, template.columns, cfg.target_col_raw, list(cfg.raw_to_canon), cfg.id_col_raw)
    )
    i = cfg.id_col_raw
    reports = [checks.null_ids(df, i, df.columns[1] if len(df.columns) > 1 else i, f"null_id_{n}") for n, df in (("train", train), ("test", test), ("template", template))]
    reports += [checks.duplicate_ids(df, i, f"duplicate_id_{n}") for n, df in (("train", train), ("test", test))]
    reports += [checks.same_ids(template, test, i, ("template", "test")), checks.numeric_target(train, cfg.target_col_raw, i)]
    return checks.run_all(reports + ordered)


def prepare_tickets(df: DataFrame, cfg: TicketConfig, is_train: bool) -> DataFrame:
    """Raw tickets to cleaned, typed, featured and ordered columns."""
    out = gate_no_phone(clean_tickets(df, cfg), cfg.text_col, cfg.id_col)
    typed = {cfg.id_col: to_long(F.col(cfg.id_col))}
    if is_train and cfg.target_col in out.columns:
        typed[cfg.target_col] = to_long(F.col(cfg.target_col))
    return ordered_ticket_columns(ticket_features(out.withColumns(typed), cfg), cfg, is_train)


def clean_ticket_dataset(
    train: DataFrame, test: DataFrame, template: DataFrame, cfg: TicketConfig | None = None, out_dir: str | None = None,
    fmt: str = "parquet", pos_col: str | None = None,
) -> CleanPair:
    """Everything from raw ticket tables to written clean tables and a summary.

    ``pos_col`` as in ``check_ticket_tables``; ``clean_ticket_files`` takes it from the files.
    """
    cfg = cfg or TicketConfig()
    checks.require(check_ticket_tables(train, test, template, cfg, pos_col))
    train, test = (df.drop(pos_col) if pos_col else df for df in (train, test))
    a, b = prepare_tickets(train, cfg, True), prepare_tickets(test, cfg, False)
    rare = RareGrouping.fit(a, cfg.rare_group_cols, cfg.rare_min_count, cfg.rare_token)
    a, b = rare.transform(a), rare.transform(b)
    imputer = EvidenceImputer.fit(a, "service_type", "subs_level")
    a, b = imputer.transform(a, "subs_level_missing"), imputer.transform(b, "subs_level_missing")
    # Joins put their key first; the written contract has its own order.
    a, b = ordered_ticket_columns(a, cfg, True), ordered_ticket_columns(b, cfg, False)
    if out_dir:
        a, b = _written(a, f"{out_dir}/train", fmt), _written(b, f"{out_dir}/test", fmt)
    summary = profiling.run_summary(a, b, cfg.datetime_col)
    if out_dir:
        write_report(summary, f"{out_dir}/summary")
    return CleanPair(a, b, summary)


def clean_ticket_files(
    spark: SparkSession, train: str, test: str, template: str, cfg: TicketConfig | None = None, out_dir: str | None = None, fmt: str = "parquet",
) -> CleanPair:
    """The same from three CSV files; the template has to name the test rows in their order."""
    position = "__position"
    tables = [numbered_rows(read_csv(spark, path), position) for path in (train, test, template)]
    return clean_ticket_dataset(*tables, cfg, out_dir, fmt, position)


def prepare_comments(df: DataFrame, cfg: CommentConfig, is_train: bool, compat: bool = False) -> DataFrame:
    out = gate_no_phone(clean_comments(df, cfg, is_train, compat), cfg.text_col, cfg.id_col)
    return ordered_comment_columns(comment_features(out, cfg), cfg, is_train)


def clean_comment_dataset(
    train: DataFrame, test: DataFrame, cfg: CommentConfig | None = None, out_dir: str | None = None, fmt: str = "parquet",
    compat: bool = False,
) -> CleanPair:
    cfg = cfg or CommentConfig()
    for name, df, is_train in (("train", train, True), ("test", test, False)):
        ids = rename_comment_columns(df, cfg, is_train)
        found = [checks.null_ids(ids, cfg.id_col, cfg.platform_col, f"null_id_{name}"), checks.duplicate_ids(ids, cfg.id_col, f"duplicate_id_{name}")]
        if is_train:
            found.append(checks.numeric_target(ids, cfg.target_col, cfg.id_col))
        checks.require(checks.run_all(found))
    a, b = prepare_comments(train, cfg, True, compat), prepare_comments(test, cfg, False, compat)
    if out_dir:
        a, b = _written(a, f"{out_dir}/train", fmt), _written(b, f"{out_dir}/test", fmt)
    summary = profiling.run_summary(a, b, cfg.text_col)
    if out_dir:
        write_report(summary, f"{out_dir}/summary")
    return CleanPair(a, b, summary)


def _written(df: DataFrame, path: str, fmt: str) -> DataFrame:
    """Write once and go on from the written table, so later passes do not clean again."""
    write_clean(df, path, fmt)
    reader = df.sparkSession.read.schema(df.schema)
    return reader.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else reader.format(fmt).load(path)
