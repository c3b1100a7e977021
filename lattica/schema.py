"""Labels, relations and table schemas of the property graph."""

from __future__ import annotations

class EngineError(Exception):
    """Base of the engine's errors."""


class InvalidRequest(EngineError):
    """A parameter is missing or malformed."""


class NotFound(EngineError):
    """A node, a repository or a path doesn't exist."""


class Busy(EngineError):
    """Another writer holds the repository."""


class Conflict(EngineError):
    """The repository exists and replacing it wasn't asked for."""


class LimitExceeded(EngineError):
    """A traversal met more nodes than its limit allows."""


class VectorsMissing(EngineError):
    """Hybrid search without attached vectors."""


class Closed(EngineError):
    """The engine has been closed."""


_BOTH = "Class Constructor Delegate Enum Function Impl Interface Macro Method Module Namespace Record Struct Template Trait Type TypeAlias Typedef Union"
ACTIONABLE = frozenset(_BOTH.split()) | {"Import", "Route"}
SYMBOLS = frozenset(_BOTH.split()) | {"Annotation", "CodeElement", "Const", "Decorator", "Property", "Static", "Variable"}
EMBEDDABLE = SYMBOLS - {"CodeElement"}

IMPACT_RELATIONS = frozenset("CALLS IMPORTS EXTENDS IMPLEMENTS INHERITS OVERRIDES WRAPS DISPATCHES_TO METHOD_IMPLEMENTS METHOD_OVERRIDES HANDLES_ROUTE HANDLES_TOOL EMITS_EVENT BINDS_EVENT_HANDLER".split())
CONTEXT_RELATIONS = IMPACT_RELATIONS | {"HAS_METHOD", "HAS_PROPERTY", "DECORATES"}
NO_SELF = frozenset("EXTENDS IMPLEMENTS IMPORTS INHERITS METHOD_IMPLEMENTS METHOD_OVERRIDES".split())
INHERITANCE = frozenset({"EXTENDS", "INHERITS"})

_ALIASES = {
    "out": " out outgoing forward down downstream call calls callee callees",
    "in": "in incoming reverse backward back up upstream caller callers",
    "both": "both any all bidirectional two-way twoway",
}


def direction(name: str | None) -> str:
    """``out``, ``in`` or ``both`` for any of their names; blank means out."""
    word = (name or "").strip().lower()
    for to, names in _ALIASES.items():
        if word in names.split(" "):
            return to
    raise InvalidRequest(f"unknown direction {name!r}")


def relations(names, default=frozenset()) -> frozenset[str]:
    """Trimmed, upper-cased relation names; the default where none are given."""
    own = frozenset(n.strip().upper() for n in names or () if n and n.strip())
    return own or frozenset(default)


NODES = (
    "id string, label string, name string, file_path string, language string, start_line int, end_line int, is_exported boolean, "
    "content string, description string, parameter_count int, return_type string, extra map<string,string>"
)
EDGES = "id string, type string, source string, target string, confidence double, reason string, step int, extra map<string,string>"
FILES = "path string, ext string, language string, kind string, size long, content string"
DEFINITIONS = "file_path string, name string, node_id string, type string, parameter_count int, return_type string, owner_id string, start_byte long, end_byte long, ord long"
RAW_CALLS = "call_id long, file_path string, language string, call_name string, receiver_name string, receiver_type string, call_form string, arg_count int, start_byte long"
RAW_IMPORTS = "file_path string, import_path string, language string, named_binding string, exported_name string, ord long"
RAW_HERITAGE = "file_path string, child_name string, parent_name string, heritage_type string, start_byte long"
