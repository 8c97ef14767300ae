"""Spark types of the data model."""

from pyspark.sql import types as T

BOX = T.ArrayType(T.ArrayType(T.IntegerType()))
ITEM = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("box", BOX), T.StructField("label", T.StringType()),
])
ITEMS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("item_idx", T.IntegerType()), *ITEM.fields])
CORRECTION = T.StructType([T.StructField("original", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("engine", T.StringType())])
FIELDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("occurrence", T.IntegerType()), T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("box", BOX),
    T.StructField("corrections", CORRECTION),
])
CANDIDATE = T.StructType([
    T.StructField("cin", T.StringType()), T.StructField("nom", T.StringType()), T.StructField("prenom", T.StringType()),
    T.StructField("session_year", T.StringType()), T.StructField("classe", T.StringType()), T.StructField("created_at", T.TimestampType()),
])
BARCODES = T.ArrayType(T.StructType([T.StructField("data", T.StringType()), T.StructField("type", T.StringType()), T.StructField("box", BOX)]))
STORED_DOCUMENT = "original_filename string, stored_path string, year string, identifier string, barcode string, cin string, sha256 string, size_bytes long, page_count int, encrypted boolean, status string, match_score double, match_details struct<weights: map<string,int>, fields_checked: array<string>>, created_at timestamp"
GRID_REPLY = "rows array<struct<row:int,text:string,confidence:double>>"
FIELD_REPLY = "text string, confidence double"
