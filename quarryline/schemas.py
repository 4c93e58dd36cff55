"""Kinds, languages and limits of the data model."""

from __future__ import annotations

#: File extension to language (fixed values, case-sensitive).
LANGUAGE_OF = {
    "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "c": "c", "h": "c", "kt": "kotlin", "kts": "kotlin", "py": "python", "pyi": "python", "java": "java", "rs": "rust",
    "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "md": "markdown", "markdown": "markdown", "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json",
}
CODE_LANGUAGES = ("go", "typescript", "javascript", "c", "kotlin", "python", "java", "rust", "ruby")

#: Directories that a walk leaves out (fixed values).
SKIP_DIRS = (".git", "node_modules", "vendor", ".venv", "__pycache__", ".next", "dist", "build", "target", ".gradle", ".idea", ".terraform")

#: Chunk kinds and their codes, which are part of chunk keys (fixed values).
KIND_CODE = {"unknown": 0, "function": 1, "method": 2, "class": 3, "struct": 4, "interface": 5, "window": 6, "section": 7, "key": 8}
KIND_NAME = {code: name for name, code in KIND_CODE.items()}

SYMBOL_NODES = ("function", "method", "class", "struct", "interface")
NODE_KINDS = ("file", "module", *SYMBOL_NODES)
EDGE_KINDS = ("DEFINES", "CONTAINS", "CALLS", "IMPORTS", "INHERITS", "REFERENCES")

WINDOW_LINES = 50
SECTION_LINES = 200
SNIPPET_BYTES = 399
BODY_BYTES = 65536
FILE_BYTES = 65536


class UnknownKind(ValueError):
    """A kind that isn't declared; the filter is never switched off silently."""


def kind_code(name: str | None) -> int | None:
    """Code of a kind by name in any case; None for no filter."""
    if not name:
        return None
    if name.lower() not in KIND_CODE or name.lower() == "unknown":
        raise UnknownKind(name)
    return KIND_CODE[name.lower()]


def node_kinds(mask: str | None) -> tuple[str, ...] | None:
    """Node kinds that a mask names: one kind, `symbol` for the five definitions, None for any."""
    if not mask:
        return None
    if mask.lower() == "symbol":
        return SYMBOL_NODES
    if mask.lower() not in NODE_KINDS:
        raise UnknownKind(mask)
    return (mask.lower(),)


def edge_kinds(mask: str | None) -> tuple[str, ...] | None:
    if not mask:
        return None
    if mask.upper() not in EDGE_KINDS:
        raise UnknownKind(mask)
    return (mask.upper(),)
