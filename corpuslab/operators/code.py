"""Profiles of Python sources: does it parse, which scenes does it define, what does it import.

Parsing is the one step the JVM cannot do. A pandas UDF receives the code column alone and returns
a struct; nothing is ever executed.
"""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions.text import derived_prompt, source_case_id

# Base classes that make a class a scene (fixed values).
SCENE_BASES = frozenset({"Scene", "ThreeDScene", "MovingCameraScene", "ZoomedScene"})
# Import prefixes of custom libraries, and the packages a plain example may use (fixed values).
CUSTOM_PREFIXES = ("manim_ml", "manim_chemistry", "manim_physics")
PLAIN_PACKAGES = (
    "manim", "numpy", "np", "math", "random", "itertools", "collections", "typing", "pathlib", "functools",
    "statistics", "decimal", "fractions", "copy", "PIL", "sys", "os",
)

_NAMES = T.ArrayType(T.StringType())
PROFILE = T.StructType([
    T.StructField("syntax_ok", T.BooleanType()),
    T.StructField("syntax_error", T.StringType()),
    T.StructField("syntax_message", T.StringType()),
    T.StructField("scene_name", T.StringType()),
    T.StructField("scene_classes", _NAMES),
    T.StructField("imports", _NAMES),
    T.StructField("local_imports", _NAMES),
])
MODULES = T.StructType([
    T.StructField("imports", _NAMES),
    T.StructField("local_imports", _NAMES),
    T.StructField("modules", T.ArrayType(T.StructType([
        T.StructField("scene", T.StringType()), T.StructField("module", T.StringType()),
    ]))),
])

# Top-level statements every extracted module keeps (fixed values).
SHARED_STATEMENTS = (
    ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.Assign, ast.AnnAssign, ast.AugAssign,
    ast.ClassDef, ast.Try, ast.With, ast.If,
)


def _parse(code: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", SyntaxWarning)
        try:
            return ast.parse(code)
        except (ValueError, RecursionError, MemoryError) as problem:
            raise SyntaxError(str(problem)) from problem


def _base(node: ast.expr, unwrap: bool) -> str:
    while unwrap and isinstance(node, ast.Subscript):
        node = node.value
    return getattr(node, "id", None) or getattr(node, "attr", "") if isinstance(node, (ast.Name, ast.Attribute)) else ""


def _is_scene(node: ast.stmt, unwrap: bool = False) -> bool:
    return isinstance(node, ast.ClassDef) and not SCENE_BASES.isdisjoint(_base(b, unwrap) for b in node.bases)


def _imports(tree: ast.Module) -> tuple[list[str], list[str]]:
    outside, inside = set(), set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            outside.update(alias.name for alias in node.names)
        elif isinstance(node, ast.ImportFrom) and node.level:
            inside.add("." * node.level + (node.module or ""))
        elif isinstance(node, ast.ImportFrom) and node.module:
            outside.add(node.module)
    return sorted(outside), sorted(inside)


def _profile(code: str | None) -> tuple:
    if code is None:
        return (None,) * 7
    try:
        tree = _parse(code)
    except SyntaxError as problem:
        return False, str(problem), f"{problem.msg} at line {problem.lineno}", None, [], [], []
    scenes = [node.name for node in tree.body if _is_scene(node)]
    outside, inside = _imports(tree)
    listed = [node.name for node in tree.body if _is_scene(node, unwrap=True)]
    return True, "", None, scenes[0] if scenes else None, listed, outside, inside


def _scene_modules(code: str | None) -> tuple:
    """Imports of a source and, for each scene, the module that holds it with the shared code only."""
    try:
        tree = _parse(code or "")
    except SyntaxError:
        return [], [], []
    scenes = {node.name for node in tree.body if _is_scene(node)}
    docstring = ast.get_docstring(tree, clean=False)
    head = [ast.Expr(ast.Constant(docstring))] if docstring else []
    kept = [node for node in tree.body if isinstance(node, SHARED_STATEMENTS)]
    modules = []
    for scene in (node for node in tree.body if _is_scene(node)):
        body = head + [node for node in kept if not _is_scene(node) or node is scene]
        modules.append({"scene": scene.name, "module": ast.unparse(ast.Module(body, [])).rstrip() + "\n"})
    outside, inside = _imports(tree) if scenes else ([], [])
    return outside, inside, modules


@F.pandas_udf(PROFILE)
def _profile_udf(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_profile(c) for c in code], columns=PROFILE.names)


@F.pandas_udf(MODULES)
def _modules_udf(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_scene_modules(c) for c in code], columns=MODULES.names)


# A filter on a profile must stay above it: pushed through, it would carry a second copy of the parser
# into the plan. Marked this way the optimizer neither copies nor moves the two functions.
_profile_udf = _profile_udf.asNondeterministic()
_modules_udf = _modules_udf.asNondeterministic()


def profile(df: DataFrame, code: str = "code") -> DataFrame:
    """Add ``syntax_ok``, ``syntax_error``, ``syntax_message``, ``scene_name``, ``scene_classes``,
    ``imports`` and ``local_imports``."""
    kept = [c for c in df.columns if c not in PROFILE.names]
    return df.select(*kept, _profile_udf(F.col(code)).alias("_profile")).select(*kept, "_profile.*")


def custom_imports(imports: Column, local_imports: Column) -> Column:
    custom = F.filter(imports, _is_custom)
    return F.array_sort(F.array_distinct(F.concat(custom, local_imports)))


def _is_custom(name: Column) -> Column:
    verdict = F.lit(False)
    for prefix in CUSTOM_PREFIXES:
        verdict = verdict | F.startswith(name, F.lit(prefix))
    return verdict


def is_plain(imports: Column, local_imports: Column) -> Column:
    """No local import, no custom library, and nothing from outside the allowed packages."""
    allowed = F.forall(imports, lambda n: F.substring_index(n, ".", 1).isin(*PLAIN_PACKAGES) & ~_is_custom(n))
    return (F.size(local_imports) == 0) & allowed


def scene_cases(files: DataFrame) -> DataFrame:
    """One case per scene class of each source file; files that do not parse or hold no scene give none.

    ``files`` has the repository's ``name``, ``repo_url``, ``license``, ``domain`` and ``ref`` beside
    ``path`` and ``code``.
    """
    parsed = files.select("name", "repo_url", "license", "domain", "ref", "path", _modules_udf(F.col("code")).alias("m"))
    exploded = parsed.select(
        "name", "repo_url", "license", "domain", "ref", "path", F.col("m.imports").alias("imports"),
        F.col("m.local_imports").alias("local_imports"), F.explode("m.modules").alias("s"),
    )
    none = F.array().cast("array<string>")
    custom = custom_imports(F.col("imports"), F.col("local_imports"))
    plain = is_plain(F.col("imports"), F.col("local_imports"))
    return exploded.select(
        source_case_id(F.col("name"), F.col("path"), F.col("s.scene")).alias("case_id"),
        derived_prompt(F.col("s.scene"), F.col("domain"), F.col("name")).alias("prompt"),
        F.col("s.module").alias("completion"),
        F.col("s.scene").alias("entry_scene"),
        F.array(F.lit("repo-import"), F.col("domain"), F.lower("name")).alias("tags"),
        none.alias("must_contain"), none.alias("must_not_contain"),
        F.col("name").alias("source_name"), F.col("repo_url").alias("source_url"), "license",
        F.col("domain").alias("source_domain"), F.col("path").alias("source_repo_path"), F.col("ref").alias("source_ref"),
        "imports", "local_imports", custom.alias("custom_imports"),
        (F.size(custom) > 0).alias("uses_custom_library"),
        plain.alias("is_plain_manim_candidate"), (~plain).alias("requires_manual_conversion"),
    )
