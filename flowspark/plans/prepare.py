"""From a raw labelled table to train and test sides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.names import drop_metadata, numeric_columns, resolve_label
from flowspark.functions.text import select_features
from flowspark.operators.clean import drop_unusable, scale, scale_stats
from flowspark.operators.encode import align_columns, category_values, encode_label, label_index, one_hot
from flowspark.operators.ordering import numbered_copies
from flowspark.operators.sample import capped_sample, stratified_split


@dataclass
class Prepared:
    """Both sides, and what was learned on the training side."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    label_index: DataFrame | None
    stats: dict[str, tuple[float, float]]


def prepare(train: DataFrame, test: DataFrame | None = None, label: str | None = None, features: Sequence[str] | None = None,
            keys: Sequence[str] = (), test_share: float = 0.25, seed: int = 42, rule: str = "main", scaled: bool = True,
            sample_rows: int | None = None) -> Prepared:
    """Drop identifiers, pick features, clean, split, encode, scale; learn on train only.

    Without a test table the one table is split by class. `keys` identify a row; they order
    the split and are carried along, not used as features. Without keys, equal rows are
    numbered for the split. The label is encoded as `label_index` unless it is
    a number already.
    """
    label = label or resolve_label(train, rule)
    if label is None:
        raise ValueError("no label column found")

    def ready(df: DataFrame) -> DataFrame:
        d = drop_metadata(df)
        if features:
            d = select_features(d, [*dict.fromkeys([*keys, *features, label])], "strict")
        return drop_unusable(d)

    whole = ready(train)
    order = list(keys)
    if not order and (sample_rows or test is None):
        whole = numbered_copies(whole, "_copy")
        order = whole.columns
    if test is None:
        parts = stratified_split(whole, label, order, test_share, seed)
        left, right = (parts.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
    else:
        left, right = whole, ready(test)
    if sample_rows:  # bounds what is fitted on; every test row stays
        left = capped_sample(left, order, sample_rows, seed)
    left, right = left.drop("_copy"), right.drop("_copy")
    carried = [*keys, label]
    texts = [c for c, t in left.dtypes if t in ("string", "boolean") and c not in carried]
    values = category_values(left, texts) if texts else {}
    coded_left = one_hot(left, values)
    coded_right = align_columns(one_hot(right, values), coded_left.columns)
    names = [c for c in coded_left.columns if c not in carried]
    stats = scale_stats(coded_left, [c for c in names if c in numeric_columns(coded_left)]) if scaled else {}
    left, right = (scale(d, stats) for d in (coded_left, coded_right))
    index = None
    if label not in numeric_columns(left):
        index = label_index(left, label)
        left, right = (encode_label(d, label, index, "label_index") for d in (left, right))
    return Prepared(left, right, names, index, stats)
