"""Schemas of the graph's tables and the domains of their kinds. Fixed values."""

from __future__ import annotations

NODE_SCHEMA = "id string NOT NULL, kind string NOT NULL, name string NOT NULL, qualified_name string NOT NULL, file_path string NOT NULL, language string NOT NULL, start_line int NOT NULL, end_line int NOT NULL, start_column int NOT NULL, end_column int NOT NULL, docstring string, signature string, visibility string, is_exported boolean NOT NULL, is_async boolean NOT NULL, is_static boolean NOT NULL, is_abstract boolean NOT NULL, decorators array<string>, type_parameters array<string>, return_type string, updated_at bigint NOT NULL"
EDGE_SCHEMA = "id bigint NOT NULL, source string NOT NULL, target string NOT NULL, kind string NOT NULL, metadata map<string,string>, line int, col int, provenance string"
FILE_SCHEMA = "path string NOT NULL, content_hash string NOT NULL, language string NOT NULL, size bigint NOT NULL, modified_at bigint NOT NULL, indexed_at bigint NOT NULL, node_count int, errors string"
REF_SCHEMA = "id bigint, from_node_id string NOT NULL, reference_name string NOT NULL, reference_kind string NOT NULL, line int, col int, candidates string, file_path string NOT NULL, language string NOT NULL"

NODE_KINDS = ("file", "module", "class", "struct", "interface", "trait", "protocol", "function", "method", "property", "field", "variable", "constant", "enum", "enum_member", "type_alias", "namespace", "parameter", "import", "export", "route", "component")
EDGE_KINDS = ("contains", "calls", "imports", "exports", "extends", "implements", "references", "type_of", "returns", "instantiates", "overrides", "decorates")
VISIBILITIES = ("PUBLIC", "PRIVATE", "PROTECTED", "INTERNAL")
#: Edge kinds by use.
CALL_KINDS = ("calls", "references", "imports", "instantiates")
TYPE_KINDS = ("extends", "implements")
DEPENDENCY_KINDS = ("calls", "references", "extends", "implements", "instantiates")
NOISY_KINDS = ("imports", "exports", "references")
RANK_KINDS = ("calls", "references", "imports", "extends", "implements", "instantiates", "overrides", "type_of", "returns")
#: Node kinds whose contained nodes an impact takes along.
CONTAINER_KINDS = ("class", "interface", "struct", "enum", "module", "file")
CALLABLE_KINDS = ("method", "function", "component", "constructor")
