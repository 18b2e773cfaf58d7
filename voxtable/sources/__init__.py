from voxtable.sources.tables import (
    load_scores, read_csv, read_csv_robust, read_table, save_scores, write_clean, write_report,
)

__all__ = ["load_scores", "read_csv", "read_csv_robust", "read_table", "save_scores", "write_clean", "write_report"]
