"""Label and categorical-feature indexing.

Both indexers are fitted on **all** prepared rows, train and test, as the
reference does (so every class and category is known to every fold).  Each fit
is one distributed aggregation whose result is bounded by the model: the number
of classes for labels, ``max_categories + 1`` values per slot for features.
"""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorIndexer
from pyspark.ml.feature import VectorIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trackml.functions import columns
from trackml.operators.prepare import FEATURES
from trackml.sources.files import LABEL

INDEXED_LABEL = "indexedLabel"
INDEXED_FEATURES = "indexedFeatures"
PREDICTION = "prediction"
PREDICTED_LABEL = "predictedLabel"
MAX_CATEGORIES = 4


def fit_label_indexer(df: DataFrame, input_col: str = LABEL, output_col: str = INDEXED_LABEL,
                      handle_invalid: str = "error") -> StringIndexerModel:
    """label → index by descending frequency; equal counts go alphabetically."""
    return StringIndexer(inputCol=input_col, outputCol=output_col,
                         stringOrderType="frequencyDesc",
                         handleInvalid=handle_invalid).fit(df)


def label_order(counts: dict[str, int]) -> list[str]:
    """Labels by descending count, equal counts in the string order Spark's
    ``StringIndexer`` uses (UTF-16 code units)."""
    return [lab for lab, _ in sorted(counts.items(),
                                     key=lambda kv: (-kv[1], kv[0].encode("utf-16-be")))]


def label_model_from_counts(counts: dict[str, int], input_col: str = LABEL,
                            output_col: str = INDEXED_LABEL,
                            handle_invalid: str = "error") -> StringIndexerModel:
    """F2 from label counts already aggregated elsewhere (same model as
    :func:`fit_label_indexer` on the rows the counts came from)."""
    return StringIndexerModel.from_labels(label_order(counts), inputCol=input_col,
                                          outputCol=output_col, handleInvalid=handle_invalid)


def label_index_frame(spark: SparkSession, model: StringIndexerModel) -> DataFrame:
    """The fitted label order as data: ``label, idx``."""
    schema = T.StructType([T.StructField(LABEL, T.StringType()),
                           T.StructField("idx", T.DoubleType())])
    return spark.createDataFrame([(lab, float(i)) for i, lab in enumerate(model.labels)], schema)


def fit_feature_indexer(df: DataFrame, input_col: str = FEATURES,
                        output_col: str = INDEXED_FEATURES,
                        max_categories: int = MAX_CATEGORIES,
                        handle_invalid: str = "error") -> VectorIndexerModel:
    """slots with at most ``max_categories`` distinct values become categorical.

    Category index: 0.0 first when present, then ascending values.
    """
    return VectorIndexer(inputCol=input_col, outputCol=output_col,
                         maxCategories=max_categories,
                         handleInvalid=handle_invalid).fit(df)


def category_frame(spark: SparkSession, model: VectorIndexerModel,
                   slot_names: list[str] | None = None) -> DataFrame:
    """A3 result as data: ``slot, feature, value, idx`` for every categorical slot."""
    rows = []
    for slot, mapping in sorted(model.categoryMaps.items()):
        name = slot_names[slot] if slot_names else f"f{slot}"
        for value, idx in sorted(mapping.items(), key=lambda kv: kv[1]):
            rows.append((int(slot), name, float(value), int(idx)))
    schema = T.StructType([T.StructField("slot", T.IntegerType()),
                           T.StructField("feature", T.StringType()),
                           T.StructField("value", T.DoubleType()),
                           T.StructField("idx", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


def label_decoder(label_model: StringIndexerModel, input_col: str = PREDICTION,
                  output_col: str = PREDICTED_LABEL) -> IndexToString:
    """index → label string with the fitted label order."""
    return IndexToString(inputCol=input_col, outputCol=output_col, labels=label_model.labels)


def vector_slots(df: DataFrame, vector_col: str, names: list[str]) -> DataFrame:
    """Replace a vector column by one DOUBLE column per slot (for reports and checks)."""
    others = [c for c in df.columns if c != vector_col]
    return df.select(*others, *columns.vector_slots(vector_col, names))


def slot_names(df: DataFrame, vector_col: str = FEATURES) -> list[str] | None:
    """Feature names stored by ``VectorAssembler`` in the column metadata."""
    meta = df.schema[vector_col].metadata.get("ml_attr", {})
    attrs = meta.get("attrs", {})
    named = [a for group in attrs.values() for a in group]
    if not named:
        return None
    return [a["name"] for a in sorted(named, key=lambda a: a["idx"])]
