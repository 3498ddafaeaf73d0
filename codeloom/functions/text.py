"""Scalar functions as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of each file extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust", ".java": "java",
    ".cpp": "cpp", ".c": "c", ".rb": "ruby", ".php": "php", ".cs": "csharp",
}
# Directories of each layer, in the order in which they are tried, and the layers' ranks.
LAYERS = (
    ("presentation", ("frontend", "ui", "components", "views")),
    ("controller", ("controllers", "controller", "routers", "routes")),
    ("service", ("services", "service", "usecases", "use_cases")),
    ("repository", ("repositories", "repository", "dao")),
    ("database", ("database", "db", "storage", "models")),
)
LAYER_RANK = {name: i for i, (name, _) in enumerate(LAYERS)}
# Decorators of entry points.
ENTRY_DECORATORS = "route get post put delete patch options head websocket on_event middleware exception_handler fixture task".split()
# Directories that are not scanned, and suffixes of binary files.
IGNORED_DIRS = ".git node_modules dist build venv .venv __pycache__ target vendor .next .egg-info".split()
BINARY_SUFFIXES = ".png .jpg .jpeg .gif .ico .svg .webp .bmp .woff .woff2 .ttf .eot .otf .pdf .zip .gz .tar .7z .lock .map .min.js .pyc .so .dll .exe .bin".split()
TEXT_SUFFIXES = ".md .txt .rst .json .yaml .yml .toml .cfg .ini .env.example .xml .html .css".split()


def normal_path(path: Column) -> Column:
    """FN1: forward slashes."""
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last suffix of the base name with its dot, as given; empty for dot files and names without one."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


def language(path: Column) -> Column:
    """SRC7-8: docker and compose by name, others by extension; null if unknown."""
    name = F.lower(base_name(normal_path(path)))
    docker = name.isin("dockerfile", "containerfile") | name.startswith("dockerfile.") | name.startswith("containerfile.") | name.endswith(".dockerfile") | name.endswith(".containerfile")
    compose = name.rlike(r"^(?:docker-)?compose(?:\.[^.]+)*\.ya?ml$")
    ext = F.lower(extension(path))
    by_ext = F.coalesce(*[F.when(ext == e, F.lit(x)) for e, x in LANGUAGES.items()])
    return F.when(docker, "dockerfile").when(compose, "docker-compose").otherwise(by_ext)


def in_ignored_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def is_skipped(path: Column) -> Column:
    """FN3: the rule scan's suffix test on the lower-case path."""
    return F.lower(path).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in BINARY_SUFFIXES) + ")$")


def in_folder(path: Column, folder: str) -> Column:
    """FN2: a plain prefix, which the Parquet reader can push down."""
    return path.startswith(folder.rstrip("/"))


def tokenize(text: Column) -> Column:
    """FN4: camel case split, then words and numbers in lower case."""
    split = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(split, F.lit("[A-Za-z][A-Za-z0-9_]*|[0-9]+"), F.lit(0)), F.lower)


def layer(path: Column) -> Column:
    """FN5: the first layer one of whose directories lies on the path."""
    p = F.concat(F.lit("/"), F.lower(path), F.lit("/"))
    return F.coalesce(*[F.when(p.rlike("/(?:" + "|".join(dirs) + ")/"), F.lit(name)) for name, dirs in LAYERS])


def layer_rank(name: Column) -> Column:
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in LAYER_RANK.items()])


def is_entrypoint(name: Column, decorators: Column) -> Column:
    """FN6."""
    return name.rlike("^(?:main|__init__|test_.*|.*_test)$") | F.coalesce(F.arrays_overlap(decorators, F.array(*[F.lit(d) for d in ENTRY_DECORATORS])), F.lit(False))


def is_test(key: Column) -> Column:
    """FN7: by a symbol key ``path::name``."""
    k = F.lower(key)
    path, name = F.split(k, "::")[0], F.element_at(F.split(k, "::"), -1)
    return name.startswith("test_") | path.contains("/tests/") | path.startswith("tests/") | path.rlike(r"(?:_test\.py|\.test\.js|\.test\.ts)$")


def relative_module(module: Column, level: Column, target: Column) -> Column:
    """FN8: the absolute module of ``from {level dots}{target} import``."""
    parts = F.split(module, r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - level, F.lit(0))), ".")
    return F.array_join(F.filter(F.array(base, F.coalesce(target, F.lit(""))), lambda x: x != ""), ".")


def dotted_module(path: Column) -> Column:
    return F.translate(F.regexp_replace(path, r"\.py$", ""), "/", ".")


def join_path(directory: Column, relative: Column) -> Column:
    """FN10: directory and relative path joined, with . and .. resolved; leading .. beyond the root are dropped."""
    parts = F.split(F.concat_ws("/", F.when(directory != "", directory), relative), "/")
    step = lambda acc, x: (
        F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def normal_url(url: Column) -> Column:
    """FN12: scheme, host and .git removed from a repository url, in lower case."""
    u = F.rtrim(F.lower(F.regexp_replace(url, r"^\s+|\s+$", "")), F.lit("/"))
    u = F.regexp_replace(u, r"\.git$", "")
    u = F.regexp_replace(u, r"^(?:https://|http://|ssh://git@github\.com/|git@github\.com:)", "")
    return F.regexp_replace(u, r"^github\.com/", "")


def uuid5(name: Column, namespace: str = "6ba7b8129dad11d180b400c04fd430c8") -> Column:
    """SNK3: the name-based UUID of a string (namespace of object ids by default)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def bounded(v: Column) -> Column:
    """FN15: rounded half to even and held within 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(v)))


def without_nul(text: Column) -> Column:
    return F.translate(text, "\u0000", "")


def branch_of_ref(ref: Column) -> Column:
    """SRC22."""
    return F.when(ref.startswith("refs/heads/"), F.substring(ref, 12, 1_000_000))


def clean_npm_version(v: Column) -> Column:
    return F.nullif(F.regexp_replace(v, "^[^0-9]+", ""), F.lit(""))


def clean_pyproject_version(v: Column) -> Column:
    return F.nullif(F.regexp_replace(v, "^[\\^~>=< ]+", ""), F.lit(""))
