"""Column expressions over paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of files that are indexed, and directories and file names that are not.
SCRIPT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]
OTHER_EXTENSIONS = [
    ".py", ".go", ".rs", ".rb", ".java", ".cs", ".cpp", ".c", ".h", ".hpp", ".sh", ".bash", ".zsh", ".ps1", ".psm1", ".psd1",
    ".yaml", ".yml", ".json", ".toml", ".ini", ".env", ".tf", ".hcl", ".bicep", ".md", ".mdx", ".dockerfile", ".containerfile",
    ".proto", ".lua", ".php", ".kt", ".swift", ".scala", ".clj",
]
EXCLUDED_DIRECTORIES = [
    "node_modules", "bower_components", "dist", "build", "out", "coverage", ".next", ".nuxt", ".svelte-kit", ".angular",
    ".parcel-cache", ".turbo", ".cache", ".vercel", ".netlify", ".docusaurus", ".expo", "storybook-static", "obj", "bin",
    "target", ".gradle", "_framework", "vendor", ".bundle", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache",
    ".pytest_cache", ".eggs", "Pods", "DerivedData", ".build", "Carthage", ".dart_tool", "_build", "deps", "dist-newstyle",
    ".stack-work", ".cpcache", "cmake-build-debug", "cmake-build-release", "CMakeFiles", ".terraform", ".git", ".svn", ".hg",
    ".idea", ".vs",
]
GENERATED_NAMES = [
    r"\.min\.(js|css)$", r"\.bundle\.js$", r"\.map$", r"\.g\.cs$", r"\.g\.i\.cs$", r"\.designer\.cs$", r"\.assemblyinfo\.cs$",
    r"\.assemblyattributes\.cs$", r"(^|/)dotnet(\.[\w.-]+)?\.js$", r"(^|/)blazor\.[\w.-]+\.js$", r"\.pb\.go$", r"_pb2(_grpc)?\.py$",
    r"\.pb\.(cc|h)$", r"\.pb\.js$", r"\.generated\.(cs|ts|js|go|java|kt)$", r"(^|/)(package-lock\.json|npm-shrinkwrap\.json)$",
    r"(^|/)pnpm-lock\.yaml$",
]


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What is before the last slash, ``.`` if there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; that of a Dockerfile is ``.dockerfile``."""
    name = F.lower(basename(path))
    return F.when(name.isin("dockerfile", "containerfile"), F.concat(F.lit("."), name)).otherwise(F.regexp_extract(name, r"\.[^.]*$", 0))


def normalized(path: Column) -> Column:
    """Without empty and ``.`` segments, and with each ``..`` taking away the segment before it, if there is one."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(kept, "/")


def is_generated(path: Column) -> Column:
    return F.lower(posix(path)).rlike("(" + "|".join(GENERATED_NAMES) + ")")


def in_excluded_directory(path: Column) -> Column:
    return F.arrays_overlap(F.split(posix(path), "/"), F.array(*[F.lit(x) for x in EXCLUDED_DIRECTORIES]))


def is_script(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(ts|tsx|js|jsx)$")


def is_supported(path: Column) -> Column:
    return ~in_excluded_directory(path) & ~is_generated(path) & extension(posix(path)).isin(*SCRIPT_EXTENSIONS, *OTHER_EXTENSIONS)


def is_test(path: Column) -> Column:
    return path.rlike(r"(__tests__/|\.(spec|test)\.[tj]sx?$)")


def test_stem(path: Column) -> Column:
    """The lower-case base name without a test and a script suffix."""
    return F.lower(F.regexp_replace(F.regexp_replace(basename(path), r"\.(spec|test)\.[tj]sx?$", ""), r"\.[tj]sx?$", ""))


def top_segment(path: Column) -> Column:
    """The first directory, below ``src`` if that comes first."""
    parts = F.split(path, "/")
    return F.when((F.get(parts, F.lit(0)) == "src") & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))


def ancestors(path: Column) -> Column:
    """All directories above a file, the outermost first."""
    parts = F.filter(F.split(dirname(path), "/"), lambda s: ~s.isin("", "."))
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def suffixes(path: Column) -> Column:
    """The path itself and what is left of it as leading segments are dropped."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    n = F.size(parts)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "/"))).otherwise(F.array().cast("array<string>"))
