"""Table schemas and fixed column orders."""

from __future__ import annotations

from pyspark.sql import types as T

USERS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("has_label", T.BooleanType()),
        T.StructField("first_found_in", T.StringType()),
    ]
)

CONTENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("has_pattern", T.BooleanType()),
        T.StructField("has_media", T.BooleanType()),
    ]
)

MEDIA = T.StructType(
    [
        T.StructField("content_id", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

FLAGS = T.StructType(
    [T.StructField("content_id", T.StringType()), T.StructField("image", T.StringType())]
)

_IMAGE_SOURCE = T.StructType([T.StructField("url", T.StringType())])
_PREVIEW = T.StructType(
    [
        T.StructField(
            "images", T.ArrayType(T.StructType([T.StructField("source", _IMAGE_SOURCE)]))
        )
    ]
)
_GALLERY = T.StructType(
    [
        T.StructField(
            "items", T.ArrayType(T.StructType([T.StructField("media_id", T.StringType())]))
        )
    ]
)
_VARIANT = T.StructType([T.StructField("u", T.StringType())])
_MEDIA_META = T.StructType(
    [
        T.StructField("e", T.StringType()),
        T.StructField(
            "s",
            T.StructType(
                [
                    T.StructField("u", T.StringType()),
                    T.StructField("variants", T.MapType(T.StringType(), _VARIANT)),
                ]
            ),
        ),
    ]
)

LISTING_ITEM = T.StructType(
    [
        T.StructField("author", T.StringType()),
        T.StructField("distinguished", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("subreddit_name_prefixed", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("is_self", T.BooleanType()),
        T.StructField("url", T.StringType()),
        T.StructField("url_overridden_by_dest", T.StringType()),
        T.StructField("preview", _PREVIEW),
        T.StructField("is_gallery", T.BooleanType()),
        T.StructField("gallery_data", _GALLERY),
        T.StructField("media_metadata", T.MapType(T.StringType(), _MEDIA_META)),
    ]
)

LISTING_PAGE = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "children", T.ArrayType(T.StructType([T.StructField("data", LISTING_ITEM)]))
                    ),
                    T.StructField("after", T.StringType()),
                    T.StructField("dist", T.LongType()),
                ]
            ),
        )
    ]
)

PREDICTION_ROWS = T.StructType(
    [
        T.StructField("experiment_name", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("true_label", T.BooleanType()),
        T.StructField("predicted_probability", T.DoubleType()),
        T.StructField("predicted_label", T.BooleanType()),
        T.StructField("dataset", T.StringType()),
    ]
)

AUTHOR_PREDICTIONS = ["author", "true_label", "predicted_probability", "predicted_label", "dataset"]

RESULT = T.StructType(
    [
        T.StructField("experiment_type", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("experiment_name", T.StringType()),
        T.StructField("best_threshold", T.DoubleType()),
        T.StructField("val_accuracy", T.DoubleType()),
        T.StructField("val_f1", T.DoubleType()),
        T.StructField("val_precision", T.DoubleType()),
        T.StructField("val_recall", T.DoubleType()),
        T.StructField("val_roc_auc", T.DoubleType()),
        T.StructField("test_accuracy", T.DoubleType()),
        T.StructField("test_f1", T.DoubleType()),
        T.StructField("test_precision", T.DoubleType()),
        T.StructField("test_recall", T.DoubleType()),
        T.StructField("test_roc_auc", T.DoubleType()),
        T.StructField("test_confusion_matrix", T.StringType()),
        T.StructField("num_users_test", T.LongType()),
        T.StructField("num_users_val", T.LongType()),
    ]
)
