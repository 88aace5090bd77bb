"""Path classification and file selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import SINK_PACKAGES, SOURCE_PACKAGES
from ..functions.jsregex import any_of
from ..functions.text import trim, units
from .ordered import first_k
from .rules import mentions

# Priority rules in the order they are tried; (pattern, flags).
PRIORITY_RULES = [
    (4, [(r"(?:^|\/)test\/", ""), (r"(?:^|\/)spec\/", ""), (r"(?:^|\/)__tests__\/", ""), (r"(?:^|\/)scripts\/", ""),
         (r"(?:^|\/)docs\/", ""), (r"(?:^|\/)README", ""), (r"(?:^|\/)LICENSE", "")]),
    (0, [("auth", "i"), ("login", "i"), ("session", "i"), (r"\bjwt\b", "i"), ("oauth", "i"), ("permission", "i"),
         (r"\brbac\b", "i"), (r"\bacl\b", "i"), (r"middleware[./].*auth", "i"), (r"\bcrypto\b", "i")]),
    (1, [(r"(?:^|\/)\.env(?:\.|$)", ""), (r"(?:^|\/)Dockerfile", ""), (r"(?:^|\/)docker-compose", ""),
         (r"(?:^|\/)\.github\/workflows\/", ""), (r"(?:^|\/)config\/", ""), (r"\.key$", ""), (r"\.pem$", ""),
         (r"\.cert$", ""), ("credentials", "i"), ("secrets", "i")]),
    (2, [(r"(?:^|\/)routes\/", ""), (r"(?:^|\/)controllers\/", ""), (r"(?:^|\/)handlers\/", ""), (r"(?:^|\/)api\/", ""),
         (r"(?:^|\/)graphql\/", ""), (r"(?:^|\/)mutations\/", ""), (r"(?:^|\/)validators\/", ""), (r"(?:^|\/)middleware\/", "")]),
    (3, [(r"(?:^|\/)models\/", ""), (r"(?:^|\/)services\/", ""), (r"(?:^|\/)repositories\/", ""), (r"(?:^|\/)database\/", ""),
         (r"(?:^|\/)migrations\/", "")]),
]
DEFAULT_PRIORITY = 4

# Domain rules in the order they are tried, same layout.
DOMAIN_RULES = [
    ("auth", [("auth", "i"), ("login", "i"), ("session", "i"), (r"\bjwt\b", "i"), ("oauth", "i"), ("permission", "i"),
              (r"\brbac\b", "i"), (r"\bacl\b", "i")]),
    ("secrets", [(r"(?:^|\/)\.env(?:\.|$)", ""), ("credentials", "i"), ("secret", "i"), (r"\.key$", ""), (r"\.pem$", ""),
                 (r"(?:^|\/)docker-compose.*\.ya?ml$", "")]),
    ("injection", [(r"(?:^|\/)routes\/", ""), (r"(?:^|\/)controllers\/", ""), (r"(?:^|\/)handlers\/", ""), (r"(?:^|\/)api\/", ""),
                   (r"(?:^|\/)graphql\/", ""), ("query", "i"), (r"(?:^|\/)validators\/", "")]),
    ("config", [(r"(?:^|\/)Dockerfile", ""), (r"(?:^|\/)docker-compose", ""), (r"(?:^|\/)terraform\/.*\.tf$", ""),
                (r"(?:^|\/)k8s\/", ""), (r"\.hcl$", ""), (r"nginx\.conf$", ""), (r"(?:^|\/)\.github\/workflows\/", "")]),
    ("deps", [(r"(?:^|\/)package\.json$", ""), (r"(?:^|\/)requirements\.txt$", ""), (r"(?:^|\/)go\.mod$", ""),
              (r"(?:^|\/)Cargo\.toml$", ""), (r"(?:^|\/)Gemfile$", ""), (r"(?:^|\/)pom\.xml$", ""),
              (r"(?:^|\/)build\.gradle$", ""), (r"(?:^|\/)pyproject\.toml$", "")]),
    ("crypto", [("crypto", "i"), ("crypt", "i"), ("cipher", "i"), (r"\bhash\b", "i"), (r"\bsign\b", "i"), ("certificate", "i"),
                (r"\btls\b", "i"), (r"\bssl\b", "i")]),
    ("data-flow", [("pipe", "i"), ("stream", "i"), ("transform", "i"), (r"\betl\b", "i"), ("queue", "i"), ("worker", "i"),
                   ("consumer", "i"), ("producer", "i")]),
]
DEFAULT_DOMAIN = "general"

# Words that put a changed file first when a diff is packed.
SECURITY_WORDS = ["auth", "password", "token", "secret", "key", "crypt", "login", "session", "permission",
                  "role", "access", "credential"]


def _first_rule(path: Column, rules, default) -> Column:
    chain = None
    for value, patterns in rules:
        # Patterns of one flag are tried as one alternation.
        tests = [path.rlike(any_of([p for p, f in patterns if f == flag], flag)) for flag in ("i", "") if any(f == flag for _, f in patterns)]
        cond = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        chain = F.when(cond, F.lit(value)) if chain is None else chain.when(cond, F.lit(value))
    return chain.otherwise(F.lit(default))


def priority(path: Column) -> Column:
    """0 (look first) to 4 (look last)."""
    return _first_rule(path, PRIORITY_RULES, DEFAULT_PRIORITY)


def domain(path: Column) -> Column:
    return _first_rule(path, DOMAIN_RULES, DEFAULT_DOMAIN)


def language(path: Column) -> Column:
    """ts, js, py or other, from the extension."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^.]*)\z", 1))
    return (F.when(ext.isin(".ts", ".tsx"), "ts").when(ext.isin(".js", ".jsx", ".mjs", ".cjs"), "js")
            .when(ext == ".py", "py").otherwise("other"))


def security_relevant(path: Column) -> Column:
    return mentions(F.lower(path), SECURITY_WORDS)


def discover(files: DataFrame, focus: list[str] | None = None) -> DataFrame:
    """Add priority and domain; keep the focus domains (none = all)."""
    d = files.withColumns({"priority": priority(F.col("path")), "domain": domain(F.col("path"))})
    return d.filter(F.col("domain").isin(focus)) if focus else d


def top_files(classified: DataFrame, k: int, order: str = "path") -> DataFrame:
    """First ``k`` files of each repository by priority.

    Select paths only, before any content is read; the row limit is applied in
    each map task before the shuffle.
    """
    return first_k(classified, ["repo"], [F.col("priority"), F.col(order)], k)


def profiling_score(path: Column, content: Column) -> Column:
    """Worth of profiling a file: known packages, src folder, size."""
    def has(names):
        return mentions(content, names)

    return (F.when(has(SOURCE_PACKAGES), 100).otherwise(0) + F.when(has(SINK_PACKAGES), 80).otherwise(0)
            + F.when(path.startswith("src/") | path.contains("/src/"), 10).otherwise(0)
            + F.least(units(content) / 1000, F.lit(50.0)))


def profiling_order(files: DataFrame, k: int = 200, order: str = "path") -> DataFrame:
    """The ``k`` non-empty files of each repository most worth profiling."""
    scored = (files.filter(trim(F.col("content")) != "")
              .select("repo", "path", order, profiling_score(F.col("path"), F.col("content")).alias("score"))
              if order != "path" else
              files.filter(trim(F.col("content")) != "")
              .select("repo", "path", profiling_score(F.col("path"), F.col("content")).alias("score")))
    return first_k(scored, ["repo"], [F.desc("score"), F.col(order)], k)
