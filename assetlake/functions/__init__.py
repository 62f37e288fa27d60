"""Scalar functions: Column in, Column out, built-in expressions only.

Most are inside whole-stage code generation; those with lambdas (``let``, ``transform``, ``filter``, ``exists``) are
interpreted row by row in the JVM.
"""

from assetlake.functions.addresses import ip_hex, ip_text, in_networks
from assetlake.functions.digests import (
    canonical_json, fingerprint, hex32, multiset_digest, sha256_text, valid_digest,
)
from assetlake.functions.names import (
    compress_clones, container_key, fix_file_name, join_ext, loose, snake_case, split_ext,
    with_extension,
)
from assetlake.functions.paths import (
    ascii_lower, ancestors, cdn_root_ok, component, encode_segments, public_base_ok,
    safe_path, safe_relative, valid_key,
)
from assetlake.functions.texts import catalog_hash, empty_mesh, escape_line, latency_text
