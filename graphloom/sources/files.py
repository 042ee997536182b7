"""Source trees as tables (SRC-01 to SRC-04): binary scan, hashes, line counts, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_TEXT_BYTES = 2 * 1024 * 1024
MAX_PATH = 1024
MAX_DEPTH = 64
MAX_FILES = 100_000
MAX_TOTAL_BYTES = 2 * 1024**3
#: Folders that are no source.
IGNORED = [".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", "target", ".idea", ".vscode", ".gradle", ".m2", "vendor", "coverage", ".next", ".nuget"]
#: Language of file extensions.
EXTENSIONS = {
    "py": "python",
    "pyw": "python",
    "js": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "java": "java",
    "go": "go",
    "rs": "rust",
    "kt": "kotlin",
    "kts": "kotlin",
    "swift": "swift",
    "cs": "csharp",
    "scala": "scala",
    "dart": "dart",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cxx": "cpp",
    "cc": "cpp",
    "hpp": "cpp",
    "hxx": "cpp",
    "cob": "cobol",
    "cbl": "cobol",
    "cpy": "cobol",
    "f": "fortran",
    "for": "fortran",
    "f90": "fortran",
    "f95": "fortran",
    "pas": "pascal",
    "pp": "pascal",
    "vb": "visual_basic",
    "vbs": "visual_basic",
    "pl": "perl",
    "pm": "perl",
    "php": "php",
    "rb": "ruby",
    "adb": "ada",
    "ads": "ada",
    "sh": "bash",
    "bash": "bash",
    "ps1": "powershell",
    "psm1": "powershell",
    "sql": "sql",
    "pls": "plsql",
    "yaml": "yaml",
    "yml": "yaml",
    "json": "json",
    "xml": "xml",
    "toml": "toml",
    "tf": "terraform",
    "graphql": "graphql",
    "gql": "graphql",
}
#: Whole file names by language.
FILE_NAMES = {"dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "makefile", "cmakelists.txt": "cmake", "gemfile": "ruby", "rakefile": "ruby", "vagrantfile": "ruby"}


def language_of(path: Column) -> Column:
    """DSC-01: language of a path by whole name, else extension, else a ``dockerfile.`` prefix; null if unknown."""
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    extension = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1))
    by_name = F.create_map(*(F.lit(x) for pair in FILE_NAMES.items() for x in pair))
    by_extension = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.element_at(by_name, name), F.element_at(by_extension, extension), F.when(name.startswith("dockerfile."), "dockerfile"))


def is_binary(content: Column) -> Column:
    """SRC-02: a NUL byte, or over 30 percent control bytes, among the first 1024."""
    head = F.substring(content, 1, 1024)
    digits = F.hex(head)
    nul = digits.rlike("^(..)*00")
    odd = F.length(F.regexp_replace(F.regexp_replace(digits, r"(..)", "$1 "), r"(?:0[0-689BCEF]|1[0-9A-F]|7F) ", "")) / 3
    total = F.octet_length(head)
    return F.coalesce(nul | ((total > 0) & ((total - odd) / total > 0.3)), F.lit(False))


def line_count(text: Column) -> Column:
    """SRC-03: line feeds of a text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """SRC-01: ``path, file_name, language, size_bytes, sha256, is_binary, line_count, text, skipped`` of the files under a folder.

    Ignored and hidden folders are left out. Files above a limit are listed with the reason in ``skipped`` (``file_size, path_length, depth``) and
    without content; binary files and texts above two megabytes have no text and no lines. See ``scan_report`` for limits on the whole tree.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = "/" + root.removeprefix("file:").strip("/") + "/"
    relative = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(prefix) + 1, 2**31 - 1)
    skipped = F.when(F.col("size_bytes") > MAX_FILE_BYTES, "file_size").when(F.length("path") > MAX_PATH, "path_length").when(F.size(F.split("path", "/")) > MAX_DEPTH, "depth")
    rows = raw.select(relative.alias("path"), F.col("length").alias("size_bytes"), "content").withColumn("skipped", skipped)
    rows = rows.withColumn("content", F.when(F.col("skipped").isNull(), F.col("content")))
    hidden = F.col("path").rlike(r"(^|/)(\.[^/]+|" + "|".join(n.replace(".", r"\.") for n in IGNORED if not n.startswith(".")) + ")/")
    rows = rows.where(~hidden)
    binary = F.when(F.col("skipped").isNull(), is_binary(F.col("content")) | (F.col("size_bytes") > MAX_TEXT_BYTES))
    text = F.when(~binary, F.decode("content", "UTF-8"))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), language_of(F.col("path")).alias("language"), "size_bytes", F.sha2("content", 256).alias("sha256"), binary.alias("is_binary"), F.coalesce(line_count(text), F.lit(0)).alias("line_count"), text.alias("text"), "skipped")


def scan_report(files: DataFrame, max_files: int | None = MAX_FILES, max_bytes: int | None = MAX_TOTAL_BYTES) -> DataFrame:
    """SRC-01: one row: files, bytes, files skipped by reason, and whether the tree exceeds a limit (None: no limit). Nothing is dropped for it."""
    sums = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"), *(F.count_if(F.col("skipped") == r).alias(f"skipped_{r}") for r in ("file_size", "path_length", "depth")))
    over = F.lit(False)
    for column, limit in (("n_files", max_files), ("n_bytes", max_bytes)):
        over = over | (F.col(column) > limit) if limit is not None else over
    return sums.withColumn("over_limit", over)
