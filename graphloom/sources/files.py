"""Directory trees as graph tables: files, Python functions and imports, similarity links."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector
from ..graph import NODE_NAMES
from .tables import spread

# What an extension is, its content format and language.
EXTENSIONS = {
    "py": ("CODE_FILE", "code", "python"), "js": ("CODE_FILE", "code", "javascript"), "jsx": ("CODE_FILE", "code", "javascript"), "ts": ("CODE_FILE", "code", "typescript"), "tsx": ("CODE_FILE", "code", "typescript"),
    "rs": ("CODE_FILE", "code", "rust"), "go": ("CODE_FILE", "code", "go"), "sh": ("CODE_FILE", "code", "bash"), "md": ("DOC", "text", None), "txt": ("DOC", "text", None), "rst": ("DOC", "text", None),
    "json": ("CONFIG", "json", None), "yaml": ("CONFIG", "json", None), "yml": ("CONFIG", "json", None), "toml": ("CONFIG", "text", None), "ini": ("CONFIG", "text", None), "cfg": ("CONFIG", "text", None),
}
# Directories that are passed over.
IGNORED = (".git", "__pycache__", "node_modules", "venv", ".venv", "dist", "build", ".pytest_cache", ".mypy_cache", "backups", "test_reports", ".next", "coverage", "htmlcov")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, type_id, format, language, modified) of known files below root, or of one file; paths
    are relative to root. Ignored directories are passed over."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    bare = "/" + base.split(":", 1)[-1].lstrip("/")
    rel = F.when(plain == bare, F.element_at(F.split(plain, "/"), -1)).otherwise(F.substr(plain, F.lit(len(bare) + 2)))
    known = F.create_map(*(x for ext, (t, f, lang) in EXTENSIONS.items() for x in (F.lit(ext), F.struct(F.lit(t).alias("type_id"), F.lit(f).alias("format"), F.lit(lang).cast("string").alias("language")))))
    kind = F.try_element_at(known, F.lower(F.regexp_extract(F.col("rel"), r"\.([A-Za-z]+)$", 1)))
    inside = ~F.exists(F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1), lambda d: d.isin(*IGNORED))
    return files.withColumn("rel", rel).where(inside).withColumn("kind", kind).where("kind is not null").select(F.col("rel").alias("path"), "content", "kind.*", F.col("modificationTime").cast("timestamp_ntz").alias("modified"))


def contents(files: DataFrame, *keep: str) -> DataFrame:
    """Content rows, with these columns of files; the id and hash are the SHA-256 of the bytes and path, and of the bytes."""
    return files.select(
        F.sha2(F.concat(F.encode("path", "UTF-8"), F.col("content")), 256).alias("id"), "format", F.col("content").alias("data"), F.sha2("content", 256).alias("hash"), F.lit("utf-8").alias("encoding"), F.col("path").alias("source_uri"),
        F.col("modified").alias("extracted_at"), F.array().cast("array<string>").alias("chunks"), *keep,
    )


def _node(rows: DataFrame, node_id: Column, type_id: Column, label: Column, text: Column, properties: Column, confidence: float) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        node_id.alias("id"), type_id.alias("type_id"), label.alias("label"), vector.hash_embedding(text).alias("embedding"), properties.alias("properties"), F.lit(None).cast("string").alias("content_ref"), F.lit(confidence).alias("confidence"), F.lit(1).alias("version"),
        F.col("modified").alias("created_at"), F.col("modified").alias("updated_at"), none.cast("timestamp_ntz").alias("valid_until"), F.lit(False).alias("deprecated"), F.concat(F.lit("file:"), F.col("path")).alias("provenance_id"),
    ).select(*NODE_NAMES)


def file_nodes(files: DataFrame) -> DataFrame:
    """A node for each file, with the properties of its type and an embedding of type, path and beginning."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    text = F.decode("content", "UTF-8")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    code = F.to_json(F.struct("path", "language", lines.alias("line_count"), stem.alias("module")))
    doc = F.to_json(F.struct("path", stem.alias("title"), stem.alias("topic")))
    config = F.to_json(F.struct("path", stem.alias("key")))
    properties = F.when(F.col("type_id") == "CODE_FILE", code).when(F.col("type_id") == "DOC", doc).otherwise(config)
    snippet = F.substring(F.decode(F.substring("content", 1, 2000), "UTF-8"), 1, 500)
    return _node(files, F.concat(F.lit("file:"), F.col("path")), F.col("type_id"), F.col("path"), F.concat_ws(" ", "type_id", "path", snippet), properties, 0.9)


def symbols_in(content: bytes | bytearray | str | None) -> Iterator[tuple[str, str, int, int, str | None, bool]]:
    """(kind, name, nth, line, inside, is_async) of a Python text's classes, functions and imported modules; nth counts
    the tree's nodes breadth first. Nothing of a text that doesn't parse."""
    if content is None:
        return
    try:
        tree = ast.parse(content if isinstance(content, str) else bytes(content).decode("utf-8", "replace"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    above: dict[ast.AST, str | None] = {tree: None}
    for nth, node in enumerate(ast.walk(tree)):
        inside = above.pop(node)
        named = isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)
        below = (f"{inside}.{node.name}" if inside else node.name) if named else inside
        for child in ast.iter_child_nodes(node):
            above[child] = below
        if named:
            yield "class" if isinstance(node, ast.ClassDef) else "function", node.name, nth, node.lineno, inside, isinstance(node, ast.AsyncFunctionDef)
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield "import", a.name, nth, node.lineno, inside, False
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield "import", node.module, nth, node.lineno, inside, False


SYMBOLS = "path string, modified timestamp_ntz, kind string, name string, nth int"


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, modified, kind, name, nth): functions, nested ones and methods too, and imported modules
    of each Python file; files with syntax errors have none. Parsing needs Python: batches of files."""

    def parse(it):
        import pyarrow as pa

        for b in it:
            out = [(path, modified, *s[:3]) for path, content, modified in zip(*(c.to_pylist() for c in b.columns)) for s in symbols_in(content) if s[0] != "class"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.timestamp("us"), pa.string(), pa.string(), pa.int32()))], names=["path", "modified", "kind", "name", "nth"])

    return files.where("language = 'python'").select("path", "content", "modified").mapInArrow(parse, SYMBOLS)


def function_nodes(symbols: DataFrame) -> DataFrame:
    f = symbols.where("kind = 'function'")
    properties = F.to_json(F.struct("name", F.concat("name", F.lit("(...)")).alias("signature")))
    return _node(f, F.concat_ws(":", F.lit("function"), "path", "name", F.col("nth").cast("string")), F.lit("FUNCTION"), F.col("name"), F.concat_ws(" ", F.lit("FUNCTION"), "name", "path"), properties, 0.85)


def _edge(rows: DataFrame, source: Column, target: Column, type_id: str, confidence: Column) -> DataFrame:
    return rows.select(F.concat_ws(">", source, F.lit(type_id), target).alias("id"), source.alias("source"), target.alias("target"), F.lit(type_id).alias("type_id"), F.when(F.lit(type_id == "SIMILAR_TO"), confidence).otherwise(1.0).alias("weight"), confidence.alias("confidence"), F.lit(False).alias("deprecated"))


def defines(symbols: DataFrame) -> DataFrame:
    f = symbols.where("kind = 'function'")
    return _edge(f, F.concat(F.lit("file:"), F.col("path")), F.concat_ws(":", F.lit("function"), "path", "name", F.col("nth").cast("string")), "DEFINES", F.lit(0.95))


def imports(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS edges: a module a.b is the file a/b.py, else the first path, in order, that ends with b.py.

    Both are equi-joins: the ending is looked up by the text after every place it can begin,
    so no pair of module and path is compared. All sides are dealt over all cores: packed, they are so small that
    adaptive execution would put very many rows in one task. An ending names a module, so it is longer than `.py`.
    """
    wanted = spread(symbols.where("kind = 'import'").select("path", "name"), "name").distinct().withColumn("exact", F.concat(F.replace("name", F.lit("."), F.lit("/")), F.lit(".py"))).withColumn("ending", F.concat(F.element_at(F.split("name", r"\."), -1), F.lit(".py")))
    py = files.where("language = 'python'").select(F.col("path").alias("target"))
    found = spread(wanted, "exact").join(spread(py, "target"), F.col("exact") == F.col("target"), "left")
    file_name = F.element_at(F.split("target", "/"), -1)
    endings = py.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(file_name) - 3, F.lit(1))), lambda i: F.substr(file_name, i))).alias("ending"))
    first = spread(endings, "ending").groupBy("ending").agg(F.min("target").alias("fallback"))
    resolved = spread(found, "ending").join(first, "ending", "left").withColumn("to", F.coalesce("target", "fallback")).where("to is not null")
    return _edge(resolved, F.concat(F.lit("file:"), F.col("path")), F.concat(F.lit("file:"), F.col("to")), "IMPORTS", F.lit(0.9))


def similar_to(nodes: DataFrame, k: int = 5, threshold: float = 0.65) -> DataFrame:
    """SIMILAR_TO edges from each node to its k nearest older ones (by created_at, id), weight and
    confidence the cosine rounded to four places."""
    seq = F.unix_micros(F.col("created_at").cast("timestamp"))
    return links(nodes.where("embedding is not null").select("id", seq.alias("seq"), "embedding"), k, threshold)


def links(vectors: DataFrame, k: int = 5, threshold: float = 0.65) -> DataFrame:
    near = vector.nearest_older(vectors, k, threshold)
    return _edge(near.where(F.col("score") >= threshold), F.col("id"), F.col("older"), "SIMILAR_TO", F.round("score", 4))
