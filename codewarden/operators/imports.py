"""Import and export statements, module resolution and the import graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsregex import js
from ..functions.spans import matches, rewrite
from ..functions.text import is_relative, normalize_path, trim
from ..session import cut_lineage
from .classify import language
from .rules import mentions

# A quoted string (kept) or a comment (dropped); the first to start wins.
_STRING_OR_COMMENT = (r'''"[^"\\]*+(?:\\[\s\S]?[^"\\]*+)*+"?|'[^'\\]*+(?:\\[\s\S]?[^'\\]*+)*+'?'''
                      r'''|`[^`\\]*+(?:\\[\s\S]?[^`\\]*+)*+`?|/\*[\s\S]*?(?:\*/|\z)|//[^\n]*''')

# Import forms, tried in this order on a trimmed line.
# (pattern, group of the module, group of the symbols, symbols are a list, type only)
IMPORT_FORMS = [
    (r"""^export\s+(?:type\s+)?\{\s*([^}]*)\}\s+from\s+(['"])([^'"]+)\2""", 3, 1, True, None),
    (r"""^import\s+type\s+\{\s*([^}]*)\}\s+from\s+(['"])([^'"]+)\2""", 3, 1, True, True),
    (r"""^import\s+type\s+(\w+)\s+from\s+(['"])([^'"]+)\2""", 3, 1, False, True),
    (r"""^import\s+\*\s+as\s+\w+\s+from\s+(['"])([^'"]+)\1""", 2, 0, False, False),
    (r"""^import\s+\w+\s*,\s*\{\s*([^}]*)\}\s+from\s+(['"])([^'"]+)\2""", 3, 1, True, False),
    (r"""^import\s+\{\s*([^}]*)\}\s+from\s+(['"])([^'"]+)\2""", 3, 1, True, False),
    (r"""^import\s+(\w+)\s+from\s+(['"])([^'"]+)\2""", 3, 1, False, False),
    (r"""^import\s+(['"])([^'"]+)\1\s*;?$""", 2, 0, False, False),
    (r"""^export\s+\*(?:\s+as\s+\w+)?\s+from\s+(['"])([^'"]+)\1""", 2, 0, False, False),
]
REQUIRE = js(r"""require\s*\(\s*(['"])([^'"]+)\1\s*\)""")

# Export forms in order: (pattern, kind), name in group 1.
EXPORT_FORMS = [
    (r"^export\s+(?:type|interface)\s+(\w+)", "type"),
    (r"^export\s+(?:async\s+)?function\s+(\w+)", "function"),
    (r"^export\s+(?:abstract\s+)?class\s+(\w+)", "class"),
    (r"^export\s+(?:const\s+)?enum\s+(\w+)", "other"),
    (r"^export\s+(?:const|let|var)\s+(\w+)", "const"),
]
# Endings tried for a relative import, in order.
RESOLVE_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"]

_IMPORT_TYPE = "array<struct<module:string,symbols:array<string>,type_only:boolean>>"
_EXPORT_TYPE = "array<struct<name:string,kind:string>>"


def strip_comments(source: Column) -> Column:
    """Drop comments, keep strings and line breaks."""
    return rewrite(source, _STRING_OR_COMMENT,
                   lambda m: F.when(m.startswith("/"), F.regexp_replace(m, r"[^\n]", "")).otherwise(m))


def join_imports(source: Column) -> Column:
    """Put an import statement that spans lines on one line."""
    return rewrite(source, js(r"import\b[^;]+;"), lambda m: F.regexp_replace(m, js(r"\s*\n\s*"), " "))


def symbol_list(raw: Column) -> Column:
    names = F.transform(F.split(raw, ","), lambda s: trim(F.regexp_replace(trim(s), js(r"\s+as\s+\S+$"), "")))
    return F.filter(names, lambda s: s != "")


def _imports_of(line: Column) -> Column:
    found = None
    for pattern, module, symbols, is_list, type_only in IMPORT_FORMS:
        p = js(pattern)
        if symbols == 0:
            names = F.lit(None).cast("array<string>")
        elif is_list:
            names = symbol_list(F.regexp_extract(line, p, symbols))
        else:
            names = F.array(F.regexp_extract(line, p, symbols))
        typed = line.rlike(js(r"^export\s+type\s+")) if type_only is None else F.lit(type_only)
        one = F.array(F.struct(F.regexp_extract(line, p, module).alias("module"), names.alias("symbols"),
                               typed.alias("type_only"))).cast(_IMPORT_TYPE)
        found = F.when(line.rlike(p), one) if found is None else found.when(line.rlike(p), one)
    required = F.transform(matches(line, REQUIRE, 2), lambda m: F.struct(
        m.alias("module"), F.lit(None).cast("array<string>").alias("symbols"), F.lit(False).alias("type_only")))
    return found.otherwise(required.cast(_IMPORT_TYPE))


def _exports_of(line: Column) -> Column:
    def one(name: Column, kind: str) -> Column:
        return F.array(F.struct(name.alias("name"), F.lit(kind).alias("kind"))).cast(_EXPORT_TYPE)

    found = F.when(line.rlike(js(r"^export\s+default\b")), one(F.lit("default"), "default"))
    for pattern, kind in EXPORT_FORMS:
        p = js(pattern)
        found = found.when(line.rlike(p), one(F.regexp_extract(line, p, 1), kind))
    listed = js(r"^export\s+\{\s*([^}]+)\}")
    names = F.transform(symbol_list(F.regexp_extract(line, listed, 1)),
                        lambda n: F.struct(n.alias("name"), F.lit("other").alias("kind")))
    return found.when(line.rlike(listed) & ~line.rlike(js(r"\bfrom\b")), names.cast(_EXPORT_TYPE)).otherwise(
        F.array().cast(_EXPORT_TYPE))


def _statements(source: Column, words: list[str], parse) -> Column:
    lines = F.filter(F.split(source, "\n"), lambda x: F.exists(
        F.array(*[F.lit(w) for w in words]), lambda w: x.contains(w)))
    return F.flatten(F.transform(lines, lambda x: parse(trim(x))))


def parse_imports(files: DataFrame) -> DataFrame:
    """One row per import: (repo, path, ord, module, symbols, type_only)."""
    seen = files.filter(mentions(F.col("content"), ["import", "require", "export"]))
    src = seen.select("repo", "path", F.explode_outer(F.array(strip_comments(F.col("content")))).alias("_s"))
    src = src.select("repo", "path", F.explode_outer(F.array(join_imports(F.col("_s")))).alias("_s"))
    return (src.select("repo", "path", F.posexplode_outer(_statements(
        F.col("_s"), ["import", "export", "require"], _imports_of)).alias("ord", "i"))
        .filter(F.col("i").isNotNull())
        .select("repo", "path", "ord", "i.*"))


def parse_exports(files: DataFrame) -> DataFrame:
    src = files.filter(F.col("content").contains("export")).select(
        "repo", "path", F.explode_outer(F.array(strip_comments(F.col("content")))).alias("_s"))
    return (src.select("repo", "path", F.posexplode_outer(_statements(F.col("_s"), ["export"], _exports_of))
                       .alias("ord", "e"))
            .filter(F.col("e").isNotNull()).select("repo", "path", "ord", "e.*"))


def resolve_imports(imports: DataFrame, tree: DataFrame) -> DataFrame:
    """Add ``target`` and ``external``; ``tree`` is (repo, path) of every file.

    Relative specs are joined to their directory once per distinct (repo, base
    path); the file list is met by an equi-join, candidates carry their order.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*\z", 1)
    spec = F.regexp_replace("module", r"^\./", "")
    d = imports.withColumn("external", ~is_relative(F.col("module"))).withColumn(
        "_base", F.when(~F.col("external"), normalize_path(F.concat(folder, F.lit("/"), spec))))
    wanted = d.filter("not external").select("repo", "_base").distinct()
    tries = wanted.select("repo", "_base", F.posexplode(F.transform(
        F.array(*[F.lit(e) for e in RESOLVE_ENDINGS]), lambda e: F.concat(F.col("_base"), e))).alias("_o", "_path"))
    hits = (tries.join(tree.select("repo", F.col("path").alias("_path")).distinct(), ["repo", "_path"])
            .groupBy("repo", "_base").agg(F.min_by("_path", "_o").alias("_found")))
    # Packages need no look-up and would all meet in one join key.
    inner = (d.filter("not external").join(hits, ["repo", "_base"], "left")
             .withColumn("target", F.coalesce("_found", "module")).withColumn("resolved", F.col("_found").isNotNull()).drop("_base", "_found"))
    outer = d.filter("external").withColumn("target", F.col("module")).withColumn("resolved", F.lit(True)).drop("_base")
    return inner.unionByName(outer)


def import_edges(files: DataFrame) -> DataFrame:
    """(repo, src, dst, symbols, external, ord) of all script files."""
    scripts = files.filter(language(F.col("path")).isin("ts", "js"))
    done = resolve_imports(parse_imports(scripts), files.select("repo", "path"))
    return done.select("repo", F.col("path").alias("src"), F.col("target").alias("dst"), "symbols",
                       "external", "resolved", "type_only", "ord")


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge forward, and internal edges backward, as one table."""
    forward = edges.select("repo", F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("way"), "external")
    back = edges.filter("not external").select(
        "repo", F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("way"), "external")
    return forward.unionByName(back)


def neighbourhood(edges: DataFrame, changed: DataFrame, hops: int = 2) -> DataFrame:
    """Files within ``hops`` of the changed ones: (repo, node, hop).

    One join per hop against a table with both directions; rows already found
    are removed by an anti-join, so each file is expanded once.
    """
    steps = edges.filter("not external").select("repo", F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(
        edges.filter("not external").select("repo", F.col("dst").alias("node"), F.col("src").alias("next"))).distinct()
    found = changed.select("repo", "node").distinct().withColumn("hop", F.lit(0))
    frontier = found
    for hop in range(1, hops + 1):
        reached = (frontier.join(steps, ["repo", "node"]).select("repo", F.col("next").alias("node")).distinct()
                   .join(found, ["repo", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        frontier = cut_lineage(reached)
        found = found.unionByName(frontier)
    return found


def restrict_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that leave or (when internal) enter one of the found files."""
    keep = nodes.select("repo", F.col("node"))
    out = edges.join(keep.withColumnRenamed("node", "src"), ["repo", "src"], "left_semi")
    back = edges.filter("not external").join(keep.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_semi")
    return out.select("repo", "src", "dst", F.lit("out").alias("way")).unionByName(
        back.select("repo", "src", "dst", F.lit("in").alias("way")))
