"""Rules on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by extension.
LANGUAGES = {
    ".py": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".go": "Go",
    ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin", ".cs": "C#", ".c": "C", ".h": "C/C++", ".cpp": "C++",
    ".php": "PHP", ".rb": "Ruby", ".swift": "Swift", ".scala": "Scala",
}
# Parts of paths that are no code; anywhere in the path, case matters.
NON_CODE = [
    ".json", ".yml", ".yaml", ".xml", ".toml", ".ini", ".cfg", ".csproj", ".props", ".targets", ".sln", ".slnx",
    "Directory.Packages.", "Directory.Build.", "packages.config", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "Cargo.lock", "go.sum", "Gemfile.lock", "Pipfile.lock", "CMakeLists.txt", "Makefile", "Dockerfile", ".dockerignore",
    ".gitignore", ".gitattributes", ".editorconfig", ".md", ".rst", ".txt", "README", "CHANGELOG", "CONTRIBUTING",
    "LICENSE", "NOTICE", "AUTHORS", ".verified.", "CompatibilitySuppressions.xml", ".xlf", ".resx", ".Designer.cs", ".g.cs",
    ".g.i.cs", ".razor", ".css", ".scss", ".svg", ".png", ".ico", ".woff", ".module.bicep", "launchSettings.json",
    "appsettings.", "devcontainer.json", "tsconfig.json", ".snap", ".lock", "generated", "__pycache__",
]
# Keys of languages in replayed changes, by extension.
REPLAY_LANGUAGES = {
    ".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".vue": "vue", ".rs": "rust",
    ".java": "java", ".kt": "kotlin", ".php": "php", ".rb": "ruby", ".cs": "csharp", ".c": "c", ".h": "c", ".cpp": "cpp",
}
# Linters by extension.
LINTERS = {".py": "ruff,mypy", ".ts": "oxlint", ".tsx": "oxlint", ".mjs": "oxlint", ".js": "oxlint", ".vue": "oxlint", ".go": "golangci-lint"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    return F.try_element_at(_map(LANGUAGES), extension(path))


def replay_language(path: Column) -> Column:
    return F.try_element_at(_map(REPLAY_LANGUAGES), extension(path))


def linters(path: Column) -> Column:
    return F.try_element_at(_map(LINTERS), extension(path))


def is_non_code(path: Column) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in NON_CODE]), lambda p: F.contains(path, p))
