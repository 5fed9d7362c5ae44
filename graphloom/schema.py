"""Record types, closed vocabularies and domain dispatch of the code graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed vocabularies of the data model.
DOMAINS = ["code", "doc", "legal", "compliance", "contract"]
REL_TYPES = ["CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "CONTAINS", "DEPENDS_ON", "REFERENCES", "OVERRIDES", "DERIVED_FROM", "GOVERNED_BY", "CITES"]
TRAVERSED = ["CALLS", "IMPLEMENTS", "EXTENDS", "OVERRIDES", "DEPENDS_ON", "IMPORTS"]
SINK_NODE_TYPES = ["File", "Class", "Interface", "Method", "Function"]
FULLTEXT_NODE_TYPES = ["Method", "Function", "Class", "File"]
NODE_TYPES = {
    "code": ["Module", "Package", "File", "Class", "Interface", "Method", "Function", "Parameter", "Field", "CallSite"],
    "doc": ["Document", "Section", "Paragraph"],
    "legal": ["Contract", "Clause", "Policy", "Regulation"],
}
AGGREGATE_TYPES = ["CodeNode", "CodeRelation", "CodeChunk", "CodeEmbedding"]
EVENT_TYPES = ["UPSERT", "DELETE"]
SHA256_HEX = "^[a-f0-9]{64}$"

PROVENANCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("repo", "tenant_id", "acl_group", "commit_sha", "path")]
    + [T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line")]
    + [T.StructField("source_system", T.StringType())]
)
NODE_PAYLOAD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "domain", "name", "ast_hash", "node_type", "label")] + [T.StructField("provenance", PROVENANCE)])
RELATION_PAYLOAD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "domain", "rel_type", "from_id", "to_id")] + [T.StructField("weight", T.LongType()), T.StructField("provenance", PROVENANCE)])
CHUNK_PAYLOAD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "domain", "entity_id", "text")] + [T.StructField("chunk_index", T.IntegerType()), T.StructField("char_count", T.IntegerType())])
EMBEDDING_PAYLOAD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "chunk_id", "entity_id", "model_id")] + [T.StructField("vector", T.ArrayType(T.FloatType()))])
PAYLOADS = {"CodeNode": NODE_PAYLOAD, "CodeRelation": RELATION_PAYLOAD, "CodeChunk": CHUNK_PAYLOAD, "CodeEmbedding": EMBEDDING_PAYLOAD}


def extension_outcome(domain: Column, ext: Column) -> Column:
    """What the domain's extension is worth: accepted, missing_ext, invalid_json, unknown_node_type or unsupported_domain.

    Domains without a typed extension are unsupported. Evaluated per row; nothing is raised in a task.
    """
    node_type = F.get_json_object(ext, "$.node_type")
    allowed = F.lit(False)
    for name, kinds in NODE_TYPES.items():
        allowed = allowed | ((domain == name) & node_type.isin(kinds))
    return (
        F.when(~F.coalesce(domain.isin(list(NODE_TYPES)), F.lit(False)), "unsupported_domain")
        .when(ext.isNull(), "missing_ext")
        .when(F.get_json_object(ext, "$").isNull(), "invalid_json")
        .when(~F.coalesce(allowed, F.lit(False)), "unknown_node_type")
        .otherwise("accepted")
    )


def specific_label(labels: Column, general: str = "CodeNode") -> Column:
    """The first label other than the general one, null if there is none."""
    return F.get(F.filter(labels, lambda x: x != general), 0)
