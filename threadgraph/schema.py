"""Explicit schemas of the tables the operators exchange."""

from pyspark.sql import types as T


def _s(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


TRIPLES = T.StructType(
    _s("graph_id", "seq", "subject_id", "subject_label", "predicate", "object_id", "object_label", "origin")
    + [T.StructField("similarity", T.DoubleType())]
    + _s("domain_type")
)
NODES = T.StructType(_s("graph_id", "id", "label", "group", "origin_label", "domain_type", "type"))
LINKS = T.StructType(_s("graph_id", "seq", "source", "target", "label", "origin"))
ONTOLOGY = T.StructType(_s("doc_id", "sub", "relation", "obj"))
RDF = T.StructType(_s("s", "p", "o", "o_kind", "datatype", "lang"))
PROMPTS = T.StructType(_s("prompt_id", "domain", "title", "prompt"))
RESPONSES = T.StructType(_s("prompt_id", "model", "text"))
EVAL_LONG = T.StructType(_s("eval_id", "domain", "model", "metric") + [T.StructField("value", T.DoubleType())])
STEP = T.StructType(_s("subject_id", "subject_label", "predicate", "object_id", "object_label"))
