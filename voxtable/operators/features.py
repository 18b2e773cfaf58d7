"""Feature tables and the specs that say which columns a model sees."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable import lexicon as lx
from voxtable.config import UNK, CommentConfig, TicketConfig
from voxtable.functions import features as fx


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns are id, target, time, categorical, text and numeric."""

    id_col: str
    target_col: str
    text_col: str
    cat_cols: tuple = ()
    num_cols: tuple = ()
    datetime_col: str | None = None
    extra_cols: tuple = field(default_factory=tuple)

    @property
    def feature_cols(self) -> list[str]:
        return [*self.cat_cols, self.text_col, *self.num_cols, *self.extra_cols]

    def to_json(self) -> str:
        return json.dumps({**asdict(self), "text_cols": [self.text_col], "feature_cols": self.feature_cols})


def ticket_spec(cfg: TicketConfig, with_sn: bool = False, with_time: bool = False) -> FeatureSpec:
    flags = tuple(name for name, _ in lx.TICKET_KEYWORDS)
    extra = ((cfg.datetime_col,) if with_time else ()) + (("sn",) if with_sn else ())
    return FeatureSpec(
        cfg.id_col, cfg.target_col, cfg.text_col, tuple(cfg.cat_cols),
        (*lx.TIME_FEATURES, *lx.TICKET_TEXT_FEATURES, *flags, *lx.TICKET_MISSING_FEATURES),
        cfg.datetime_col, extra,
    )


def comment_spec(cfg: CommentConfig) -> FeatureSpec:
    flags = tuple(name for name, _ in lx.COMMENT_KEYWORDS)
    return FeatureSpec(
        cfg.id_col, cfg.target_col, cfg.text_col, (cfg.platform_col,),
        (*lx.COMMENT_TEXT_FEATURES, *flags, "n_tech_flags"),
    )


def read_spec(saved: str | dict, cfg: TicketConfig) -> FeatureSpec:
    """Spec from JSON: current form, or the older one with ``text_cols`` and no feature list."""
    data = json.loads(saved) if isinstance(saved, str) else dict(saved)
    if not isinstance(data, dict):
        raise ValueError("a feature spec must be a JSON object")
    base = ticket_spec(cfg)
    text = data.get("text_col") or next(iter(data.get("text_cols") or []), None) or cfg.text_col
    cats = tuple(data.get("cat_cols") or base.cat_cols)
    nums = tuple(data["num_cols"]) if "num_cols" in data else base.num_cols
    listed = data.get("feature_cols") or []
    extra = tuple(c for c in listed if c not in (*cats, text, *nums))
    if listed:
        cats = tuple(c for c in cats if c in listed)
        nums = tuple(c for c in nums if c in listed)
    return FeatureSpec(
        data.get("id_col", cfg.id_col), data.get("target_col", cfg.target_col), text, cats, nums,
        data.get("datetime_col", cfg.datetime_col), extra,
    )


def ticket_features(df: DataFrame, cfg: TicketConfig) -> DataFrame:
    """All ticket features in one projection over the cleaned table."""
    made = {**fx.time_features(F.col(cfg.datetime_col)), **fx.ticket_text_features(F.col(cfg.text_col))}
    has_level = "subs_level" in df.columns
    made["subs_level_missing"] = fx.unknown_flag(F.col("subs_level")) if has_level else F.lit(None).cast("float")
    return df.withColumns(made)


def comment_features(df: DataFrame, cfg: CommentConfig) -> DataFrame:
    out = df.withColumns(fx.comment_text_features(F.col(cfg.text_col), cfg))
    return out.withColumn("n_tech_flags", fx.flag_total(name for name, _ in lx.COMMENT_KEYWORDS))


def apply_spec(df: DataFrame, spec: FeatureSpec, strict: bool = True, keep: tuple = ()) -> DataFrame:
    """Select the spec's columns; missing ones raise (strict) or come back as NULL.

    Categorical and text NULLs become UNK, as model inputs must not hold NULL strings.
    """
    missing = [c for c in spec.feature_cols if c not in df.columns]
    if missing and strict:
        raise KeyError(f"missing feature columns: {missing}")
    filled = {*spec.cat_cols, spec.text_col}

    def column(name: str):
        source = F.lit(None).cast("string" if name in filled else "float") if name in missing else F.col(name)
        return (F.coalesce(source.cast("string"), F.lit(UNK)) if name in filled else source).alias(name)

    return df.select(*keep, *[column(c) for c in spec.feature_cols])


def aligned_features(
    train: DataFrame, test: DataFrame, spec: FeatureSpec, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Train (with id and target) and test (with id) features: same columns, same order."""
    if spec.target_col not in train.columns:
        raise KeyError(f"train lacks the target column {spec.target_col}")
    return (
        apply_spec(train, spec, strict, (spec.id_col, F.col(spec.target_col).try_cast("double").alias(spec.target_col))),
        apply_spec(test, spec, strict, (spec.id_col,)),
    )


def model_frame(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Model input: text NULL to empty, categories to UNK, numbers to float with 0 for NULL."""
    return df.withColumns({
        spec.text_col: F.coalesce(F.col(spec.text_col).cast("string"), F.lit("")),
        **{c: F.coalesce(F.col(c).cast("string"), F.lit(UNK)) for c in spec.cat_cols},
        **{c: F.coalesce(F.col(c).try_cast("float"), F.lit(0.0).cast("float")) for c in spec.num_cols},
    })


def ordered_ticket_columns(df: DataFrame, cfg: TicketConfig, is_train: bool) -> DataFrame:
    """Output contract: id, target, kept columns, engineered numbers."""
    kept = [c for c in cfg.keep_cols if cfg.keep_sn_in_outputs or c != "sn"]
    order = [cfg.id_col, *([cfg.target_col] if is_train else []), *kept, *ticket_spec(cfg).num_cols]
    return df.select(*dict.fromkeys(c for c in order if c in df.columns))


def ordered_comment_columns(df: DataFrame, cfg: CommentConfig, is_train: bool) -> DataFrame:
    raw = [f"{cfg.platform_col}_raw", f"{cfg.text_col}_raw"] if cfg.keep_raw_cols else []
    order = [
        cfg.id_col, *([cfg.target_col] if is_train else []), *raw, cfg.platform_col, cfg.text_col,
        *comment_spec(cfg).num_cols,
    ]
    return df.select(*dict.fromkeys(c for c in order if c in df.columns))
