"""Declared schemas: of the corpus index, provisions, documents of record and the embedding cache."""

from pyspark.sql import types as T

#: The corpus index: the inner map tells a key that is absent from one that is null.
INDEX_JSON = T.StructType().add("acts", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))

CORPUS = (
    T.StructType()
    .add("act_ord", T.IntegerType())
    .add("slug", T.StringType())
    .add("name", T.StringType())
    .add("xml_path", T.StringType())
    .add("frbr_expression_uri", T.StringType())
)

#: What the parser makes of a file; order within the corpus is (act_ord, kind_ord, prov_ord).
PARSED = (
    T.StructType()
    .add("act_ord", T.IntegerType())
    .add("act_name", T.StringType())
    .add("frbr_uri", T.StringType())
    .add("kind_ord", T.IntegerType())
    .add("prov_ord", T.IntegerType())
    .add("eid", T.StringType())
    .add("provision_num", T.StringType())
    .add("provision_type", T.StringType())
    .add("heading", T.StringType())
    .add("text", T.StringType())
)

ORDER = ("act_ord", "kind_ord", "prov_ord")

CACHE = T.StructType().add("id", T.StringType(), False).add("vector", T.ArrayType(T.FloatType()), False)
