"""The judged languages: which names of files and languages mean them, and their grammars."""

from __future__ import annotations

from functools import cache

from siltline.llm import grammars, line_grammars

#: File extensions and language names of the judged languages.
EXTENSIONS = {
    "py": "python", "pyw": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "tsx": "typescript", "java": "java", "go": "go", "c": "c", "h": "c", "php": "php", "phtml": "php", "sh": "shell", "bash": "shell", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml",
}
NAMES = {"python3": "python", "py": "python", "node": "javascript", "bash": "shell", "sh": "shell", "golang": "go", "yml": "yaml"}
JUDGED = ("python", "javascript", "typescript", "java", "go", "c", "php", "shell", "json", "yaml", "xml")

_BUILDERS = line_grammars.BUILDERS | {
    "javascript": lambda: grammars._javascript("javascript", grammars._JS_ONLY, ""),
    "typescript": lambda: grammars._javascript("typescript", grammars._TS_ONLY, grammars._TS_RULES.lstrip("\n")),
    "java": grammars._java, "go": grammars._go, "c": grammars._c, "php": grammars._php,
}


@cache
def language(name: str) -> grammars.Language:
    """Compiled once per worker process."""
    return _BUILDERS[name]()
