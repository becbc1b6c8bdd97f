"""What the cleaning and feature steps should do to which columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from storeflow import columns as C


@dataclass(frozen=True)
class SalesSpec:
    """Column roles of one sales feed. The defaults describe the retail feed.

    ``row_id`` names a unique column that breaks ties between rows of the same
    time when the first non-null value of a group is picked. Feeds without one
    break ties by the value itself, which is just as repeatable.
    """

    group_keys: tuple[str, ...] = C.GROUP_KEYS
    time_column: str = C.TIME_COLUMN
    date_columns: tuple[str, ...] = C.DATE_COLUMNS
    target: str = C.TARGET
    gross: str = C.GROSS
    price: str = C.PRICE
    promotion: str = C.PROMOTION
    promotion_quantity: str = C.PROMOTION_QUANTITY
    row_id: str | None = None
    sum_columns: tuple[str, ...] = C.SUM_COLUMNS
    mean_columns: tuple[str, ...] = C.MEAN_COLUMNS
    numeric_columns: tuple[str, ...] = C.NUMERIC_COLUMNS
    categorical_columns: tuple[str, ...] = C.CATEGORICAL_COLUMNS
    flag_columns: tuple[str, ...] = C.FLAG_COLUMNS
    truthy: tuple[str, ...] = ("Y",)
    flag_values: tuple[int, int] = (1, 0)  # for a truthy text, for any other
    drop_columns: tuple[str, ...] = C.DROP_COLUMNS
    fills: Mapping[str, object] = field(default_factory=lambda: dict(C.FILLS))
    calendar: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(C.CALENDAR))
    scaled_columns: tuple[str, ...] = C.NUMERIC_COLUMNS
    log_target: bool = True
    log_column: str | None = None  # the column of ``log_target``, if it is not the target
    label_categoricals: bool = True
    roles: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(C.ROLES))
    history: int = C.HISTORY
    horizon: int = C.HORIZON

    @property
    def features_to_scale(self) -> tuple[str, ...]:
        """Scaled columns, then the target; repeats, flags and columns that are never scaled left out."""
        wanted = dict.fromkeys((*self.scaled_columns, self.target))
        return tuple(c for c in wanted if c not in {*self.flag_columns, *C.NEVER_SCALED})

    @classmethod
    def from_config(cls, config: Mapping) -> "SalesSpec":
        """Read the nested configuration layout that the jobs accept.

        In the map of the binary encoding the first text is the one tested for:
        its value marks it, the other value (0 without one) everything else.
        ``truthy`` beside the map lists several such texts. ``row_id``,
        ``time_column`` and ``date_columns`` stand at the top level.
        """
        features = config.get("Features", {})
        encoding = features.get("categorical_encoding", {})
        covariates = features.get("tft_covariates", {})
        transforms = covariates.get("transformations", {})
        numeric_scaling = transforms.get("numerical_scaling", {})
        target_scaling = transforms.get("target_scaling", {})
        binary = encoding.get("binary_encoding", {})
        flags = binary.get("map") or {"Y": 1, "N": 0}
        marks = [int(v) for v in flags.values()]
        training = features.get("training", config.get("training", {}))
        target = config.get("target", C.TARGET)
        scaled = numeric_scaling.get("columns", ()) if numeric_scaling.get("method") == "standard" else ()
        return cls(
            group_keys=tuple(config.get("group_ids", C.GROUP_KEYS)),
            row_id=config.get("row_id"),
            time_column=config.get("time_column", C.TIME_COLUMN),
            date_columns=tuple(config.get("date_columns", C.DATE_COLUMNS)),
            target=target,
            sum_columns=tuple(dict.fromkeys((target, C.GROSS, "promo_amount"))),
            numeric_columns=tuple(features.get("numerical", ())),
            categorical_columns=tuple(encoding.get("columns", ())),
            flag_columns=tuple(binary.get("columns", ())),
            truthy=tuple(str(v) for v in binary.get("truthy") or list(flags)[:1]),
            flag_values=(marks[0], marks[1] if len(marks) > 1 else 0),
            drop_columns=tuple(features.get("drop_columns", ())),
            fills=dict(encoding.get("fill_na", {})),
            calendar={
                name: tuple(entry.get("extract", ()))
                for name, entry in features.get("date_time_features", {}).items()
            },
            scaled_columns=tuple(scaled),
            log_target=target_scaling.get("method") == "log1p" and bool(target_scaling.get("column")),
            log_column=target_scaling.get("column"),
            label_categoricals=encoding.get("method") == "label",
            roles={k: tuple(v) for k, v in covariates.items() if k != "transformations"},
            history=int(training.get("max_encoder_length", C.HISTORY)),
            horizon=int(training.get("max_prediction_length", C.HORIZON)),
        )
