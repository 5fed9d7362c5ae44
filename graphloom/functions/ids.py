"""Canonical identifiers: digests over length-prefixed parts, as column expressions.

Each takes the version tag that heads the digest; systems that share identifiers must share the tag.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of vector point ids.
POINT_NAMESPACE = "5f3e8a1c-9b6d-4e2a-8c7f-1a2b3c4d5e6f"


def _prefixed(col: Column, width: int) -> Column:
    data = F.encode(col, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(col)), width * 2, "0")), data)


def sha256_parts(tag: str, parts: list[Column], width: int = 8) -> Column:
    """Hex digest of tag and the parts, each headed by its byte length in width bytes, big-endian. Null if a part is."""
    return F.sha2(F.concat(F.encode(F.lit(tag), "UTF-8"), *(_prefixed(p, width) for p in parts)), 256)


def parser_id(path: Column, qualified_name: Column) -> Column:
    return F.sha2(F.concat(path, F.lit(":"), qualified_name), 256)


def scoped_node_id(tenant: Column, repo: Column, parser: Column, tag: str = "node-id-v2") -> Column:
    """Identity of a node within tenant and repository; the access group is left out on purpose."""
    return sha256_parts(tag, [tenant, repo, parser])


def command_fingerprint(parts: list[Column]) -> Column:
    """Over tenant, repository, group, commit, path, source digest and size."""
    return sha256_parts("", parts)


def cache_key(entity: Column, ast_hash: Column, logic: Column, acl_scope: Column, tag: str = "semantic-cache-key-v2", prefix: str = "scache:v2:") -> Column:
    return F.concat(F.lit(prefix), sha256_parts(tag, [entity, ast_hash, logic, acl_scope], 4))


def point_id(embedding_id: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """UUID version 5 of the id in the namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(embedding_id, "UTF-8")))
    variant = F.lower(F.conv(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def list_fingerprint(tag: str, head: str, lists: list[list[str]]) -> str:
    """Driver-side digest of a head value and sorted lists, all with 4-byte lengths."""
    out = bytearray(tag.encode())

    def put(value: str) -> None:
        data = value.encode()
        out.extend(struct.pack(">I", len(data)) + data)

    put(head)
    for values in lists:
        out.extend(struct.pack(">I", len(values)))
        for v in values:
            put(v)
    return hashlib.sha256(bytes(out)).hexdigest()
