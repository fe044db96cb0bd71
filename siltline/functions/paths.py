"""Paths: parts, languages, project types and ignore patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of each language, and the file names of some.
LANGUAGES = {
    "javascript": ("js", "mjs", "cjs", "jsx"),
    "typescript": ("ts", "mts", "cts", "tsx"),
    "python": ("py", "pyw"),
    "php": ("php", "phtml"),
    "go": ("go",),
    "java": ("java",),
    "kotlin": ("kt",),
    "rust": ("rs",),
    "ruby": ("rb",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp"),
    "csharp": ("cs",),
    "shell": ("sh", "bash", "zsh"),
    "powershell": ("ps1", "psm1"),
    "batch": ("bat", "cmd"),
    "html": ("html", "htm"),
    "css": ("css", "scss", "sass"),
    "json": ("json",),
    "yaml": ("yaml", "yml"),
    "xml": ("xml",),
    "sql": ("sql",),
    "terraform": ("tf", "tfvars"),
    "dockerfile": ("dockerfile",),
    "toml": ("toml",),
    "ini": ("ini",),
    "dotenv": ("env",),
    "properties": ("properties",),
}
FILE_NAMES = {
    "dockerfile": ("Dockerfile",),
    "yaml": ("docker-compose.yml", "docker-compose.yaml"),
    "makefile": ("Makefile",),
    "groovy": ("Jenkinsfile",),
    "ruby": ("Vagrantfile", "Gemfile", "Rakefile"),
}

# Names that tell a project's type, as manifest or lock file.
MANIFESTS = {
    "nodejs": ("package.json",),
    "python": ("requirements.txt", "setup.py", "pyproject.toml", "Pipfile"),
    "php": ("composer.json",),
    "go": ("go.mod",),
    "java": ("pom.xml", "build.gradle", "build.gradle.kts"),
    "ruby": ("Gemfile",),
    "rust": ("Cargo.toml",),
}
LOCKFILES = {
    "nodejs": ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json"),
    "python": ("poetry.lock", "Pipfile.lock"),
    "php": ("composer.lock",),
    "go": ("go.sum",),
    "ruby": ("Gemfile.lock",),
    "rust": ("Cargo.lock",),
}

# Path parts that are never looked into, and ignored patterns.
HARD_IGNORED = (
    "node_modules", ".git", ".svn", ".hg", "coverage", ".cache", ".next", ".nuxt", "__pycache__",
)
DEFAULT_IGNORED = (
    "node_modules/**", "node_modules", ".git/**", ".git", ".svn/**", ".svn", ".hg/**", ".hg", "dist/**", "dist", "build/**", "build", "coverage/**", "coverage", ".cache/**", ".cache", ".next/**", ".next", ".nuxt/**", ".nuxt", "vendor/**", "vendor", "target/**", "target", "*.pyc", "__pycache__/**", ".turbo/**", ".gradle/**", "out/**", "bin/**", "obj/**",
)
IGNORE_FILES = (".siltlineignore", ".gitignore")


def normalised(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(normalised(path), "/"), -1)


def extension(path: Column) -> Column:
    """Lower case, without dot; empty for names like .env and Dockerfile."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def _lookup(table: dict[str, tuple[str, ...]]) -> Column:
    pairs = [(name, value) for value, names in table.items() for name in names]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def language(path: Column) -> Column:
    """By file name, then by the name's beginning, then by extension; null if unknown."""
    base = basename(path)
    return F.coalesce(
        F.try_element_at(_lookup(FILE_NAMES), base),
        F.when(F.lower(base).startswith("dockerfile"), "dockerfile"),
        F.when(base.startswith(".env"), "dotenv"),
        F.try_element_at(_lookup(LANGUAGES), extension(path)),
    )


def project_type(path: Column) -> Column:
    """Types that this file's name gives, as an array."""
    base = basename(path)
    kinds = [F.when(base.isin(*MANIFESTS.get(t, ()), *LOCKFILES.get(t, ())), t) for t in dict.fromkeys([*MANIFESTS, *LOCKFILES])]
    kinds += [
        F.when(base.rlike(r"\.(?:csproj|sln)$"), "csharp"),
        F.when(F.lower(base).startswith("dockerfile") | base.isin("docker-compose.yml", "docker-compose.yaml"), "docker"),
        F.when(base.rlike(r"\.tf(?:vars)?$"), "terraform"),
    ]
    return F.filter(F.array(*kinds), lambda x: x.isNotNull())


def is_manifest(path: Column) -> Column:
    return basename(path).isin(*[name for names in MANIFESTS.values() for name in names]) | basename(path).rlike(r"\.(?:csproj|sln)$")


def is_lockfile(path: Column) -> Column:
    return basename(path).isin(*[name for names in LOCKFILES.values() for name in names])


def in_hard_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(normalised(path), "/"), F.array(*[F.lit(x) for x in HARD_IGNORED]))


def ignore_regex(pattern: str) -> str | None:
    """One regular expression for what a pattern ignores; there is no negation and no inner star.

    ``x``, ``x/`` and ``x/**`` take x and all below it, ``*.ext`` a suffix of the path; without a slash a pattern takes
    base names too, and with a leading star their ends.
    """
    text = pattern.strip()
    if not text or text.startswith("#"):
        return None
    text = text.removeprefix("/")
    root = text.removesuffix("/**").removesuffix("/") if text.endswith(("/**", "/")) else text
    options = [f"^{re.escape(text)}(?:/.*)?$", f"^{re.escape(root)}(?:/.*)?$"]
    if text.startswith("*."):
        options.append(f"{re.escape(text[1:])}$")
    if "/" not in text:
        options.append(f"(?:^|/){re.escape(text)}$")
        if text.startswith("*"):
            options.append(f"(?:^|/)[^/]*{re.escape(text[1:])}$")
    return "|".join(dict.fromkeys(options))


def ignored(path: Column, patterns: Iterable[str] = ()) -> Column:
    """Hard-ignored parts, the default patterns and the given ones, as one regular expression."""
    rules = [r for r in map(ignore_regex, [*DEFAULT_IGNORED, *patterns]) if r]
    return in_hard_ignored(path) | normalised(path).rlike("|".join(rules))


def ignores(path: str, patterns: Iterable[str] = ()) -> bool:
    """The same for one path, on the driver."""
    norm = path.replace("\\", "/")
    if set(norm.split("/")) & set(HARD_IGNORED):
        return True
    return any(re.search(r, norm) for r in map(ignore_regex, [*DEFAULT_IGNORED, *patterns]) if r)
