"""Column contracts and cleaning switches for the two kinds of feedback table.

The field names, header names, column lists and defaults are fixed values: saved
configurations and downstream files are keyed by them.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

UNK = "UNK"

# ---- fixed values: ticket headers, canonical names, categorical and kept columns ----
TICKET_HEADERS = {
    "id": "id",
    "SN": "sn",
    "Handle time": "handle_time",
    "TT status": "tt_status",
    "Dept. for initial handling": "dept_initial",
    "Service request type": "service_request_type",
    "Subs Level": "subs_level",
    "Customer level": "customer_level",
    "Service content": "service_content",
    "Département de traitement": "dept_traitement",
    "Tech/Comm": "tech_comm",
    "Type": "service_type",
    "DOT": "dot",
    "ACTEL's": "actel",
    "class_int": "class_int",
}
TICKET_CATEGORICALS = (
    "tt_status", "dept_initial", "service_request_type", "subs_level", "customer_level",
    "dept_traitement", "tech_comm", "service_type", "dot", "actel", "actel_code",
)
TICKET_KEPT = ("id", "sn", "handle_time", "service_content", *TICKET_CATEGORICALS)
# ---- end of fixed values ----


class _RoundTrip:
    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, saved: dict):
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(saved) - known)
        if unknown:
            raise ValueError(f"unknown configuration keys: {unknown}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in saved.items()})


@dataclass(frozen=True)
class TicketConfig(_RoundTrip):
    """Call-centre tickets: a structured record plus one free-text field."""

    id_col_raw: str = "id"
    target_col_raw: str = "class_int"
    raw_to_canon: dict = field(default_factory=lambda: dict(TICKET_HEADERS))
    id_col: str = "id"
    target_col: str = "class_int"
    datetime_col: str = "handle_time"
    text_col: str = "service_content"
    cat_cols: tuple = TICKET_CATEGORICALS
    keep_cols: tuple = TICKET_KEPT
    lower: bool = True
    remove_accents: bool = True
    keep_sn_in_outputs: bool = True
    rare_min_count: int = 20
    rare_token: str = "RARE"
    rare_group_cols: tuple = ("actel", "dot", "actel_code")
    clean_train_name: str = "train_clean.csv"
    clean_test_name: str = "test_clean.csv"
    run_summary_name: str = "run_summary.json"


@dataclass(frozen=True)
class CommentConfig(_RoundTrip):
    """Social-media comments: a platform and one multilingual free-text field."""

    id_col: str = "id"
    platform_col: str = "platform"
    text_col: str = "comment"
    target_col: str = "label"
    clean_train_name: str = "train_clean.csv"
    clean_test_name: str = "test_clean.csv"
    run_summary_name: str = "run_summary.json"
    lower: bool = True
    remove_accents_latin: bool = True
    normalize_arabic: bool = True
    mask_pii: bool = True
    mask_long_ids: bool = True
    long_id_min_digits: int = 6
    reduce_elongations: bool = True
    canonicalize_telecom: bool = True
    collapse_whitespace: bool = True
    keep_raw_cols: bool = True
    phone_token: str = "<PHONE>"
    email_token: str = "<EMAIL>"
    url_token: str = "<URL>"
    id_token: str = "<ID>"

    @property
    def tokens(self) -> tuple:
        return (self.phone_token, self.email_token, self.url_token, self.id_token)
