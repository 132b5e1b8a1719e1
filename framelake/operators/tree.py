"""Assembling files into one tree: clusters, collisions, mappings, imports."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import text

#: Names of files that are started rather than imported.
ENTRY_POINTS = ("main.py", "__main__.py", "app.py", "cli.py", "conftest.py", "run.py", "manage.py", "setup.py", "wsgi.py", "asgi.py")
CONTENT_TYPES = ("python_code", "markdown_document", "pdf_document", "gui_demo")
CONFIDENCES = ("high", "medium", "low")


def clusters(mappings: DataFrame, path: str = "dst_rel") -> DataFrame:
    """Files by the first part of their path, and the paths themselves, sorted. A tree's listing is made for people, and is as long as it."""
    return mappings.groupBy(text.first_segment(F.col(path)).alias("root")).agg(F.count("*").alias("files"), F.array_sort(F.collect_list(path)).alias("paths"))


def root_distribution(mappings: DataFrame, path: str = "dst_rel") -> DataFrame:
    return mappings.groupBy(text.first_segment(F.col(path), "(root)", False).alias("root")).agg(F.count("*").alias("files"))


def collisions(mappings: DataFrame, path: str = "dst_rel", folder: str = "folder") -> DataFrame:
    """Paths that more than one mapping leads to, with the folders these come from, sorted. Paths of one mapping are dropped before folders are gathered."""
    counts = mappings.groupBy(path).agg(F.count("*").alias("mappings")).where("mappings > 1")
    return mappings.join(counts, path).groupBy(path, "mappings").agg(F.array_sort(F.collect_list(folder)).alias("folders"))


def described(artifacts: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Artifacts with what their run's metadata says of them; defaults where it says nothing."""
    held = artifacts.drop("content_type", "classification_confidence", "description").join(meta.select(*keys, "content_type", "classification_confidence", "description"), keys, "left")
    return held.withColumns({"content_type": F.coalesce("content_type", F.lit("unknown")), "classification_confidence": F.coalesce("classification_confidence", F.lit(0.0)), "description": F.coalesce("description", F.lit(""))})


def backfilled(answers: DataFrame, batch: DataFrame, pos: str = "pos") -> DataFrame:
    """Mappings of a model's answers; folder and source that it leaves out are those of the artifact at the same position. Answers without a target are none."""
    held = batch.select(pos, F.col("folder").alias("own_folder"), F.col("src_rel").alias("own_src"))
    rows = answers.join(held, pos, "left").withColumns({"folder": F.coalesce("folder", "own_folder"), "src_rel": F.coalesce("src_rel", "own_src"), "confidence": F.coalesce("confidence", F.lit("low")), "reasoning": F.coalesce("reasoning", F.lit(""))})
    return rows.where("dst_rel IS NOT NULL").drop("own_folder", "own_src")


def unsure(mappings: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Mappings for people to look at."""
    return mappings.where(F.coalesce(F.col(confidence), F.lit("low")) != "high")


def confidence_counts(mappings: DataFrame, confidence: str = "confidence") -> DataFrame:
    """A row for each level, also those without mappings."""
    counts = mappings.agg(*(F.count_if(F.col(confidence) == c).alias(c) for c in CONFIDENCES))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("confidence"), F.col(c).alias("n")) for c in CONFIDENCES))).alias("x")).select("x.*")


def located(artifacts: DataFrame, mappings: DataFrame, keys: list[str]) -> DataFrame:
    return mappings.join(artifacts, keys)


def missing(artifacts: DataFrame, mappings: DataFrame, keys: list[str]) -> DataFrame:
    return mappings.join(artifacts, keys, "left_anti")


def placed(artifacts: DataFrame, mappings: DataFrame, keys: list[str], path: str = "dst_rel", own: str = "src_rel") -> DataFrame:
    """Each artifact's place: the mapping's, else its own path."""
    return artifacts.join(mappings.select(*keys, path), keys, "left").withColumn(path, F.coalesce(path, own))


def last_writer(mappings: DataFrame, path: str = "dst_rel", order: str = "pos") -> DataFrame:
    rest = [c for c in mappings.columns if c != path]
    return mappings.groupBy(path).agg(F.max_by(F.struct(*rest), order).alias("r")).select(path, "r.*")


def safe_path(path: Column) -> Column:
    """Without leading slashes; null if it leads out of the tree."""
    p = F.regexp_replace(path, "^/+", "")
    return F.when(~F.array_contains(F.split(p, "/"), ".."), p)


def content_type(x: Column) -> Column:
    return F.when(x.isin(*CONTENT_TYPES), x).otherwise("gui_demo")


def module(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def is_entry_point(path: Column) -> Column:
    name = text.basename(path)
    return name.isin(*ENTRY_POINTS) | name.rlike("^(test_|run_)")


def importable(files: DataFrame, path: str = "dst_rel") -> DataFrame:
    """name: every module of the tree, and every package above one."""
    parts = F.split(module(F.col(path)), r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return files.where(F.col(path).endswith(".py")).select(F.explode(names).alias("name")).distinct()


def known_elsewhere() -> list[str]:
    """Modules of the standard library, and yaml."""
    return sorted({*sys.stdlib_module_names, "__future__", "yaml"})


def local_imports(imports: DataFrame) -> DataFrame:
    """Edges (dst_rel, module) whose first part is not a module of the standard library."""
    return imports.where(~F.substring_index("module", ".", 1).isin(known_elsewhere()))


def resolved(imports: DataFrame, names: DataFrame) -> DataFrame:
    return local_imports(imports).join(names, F.col("module") == F.col("name"), "left_semi")


def unresolved(imports: DataFrame, names: DataFrame) -> DataFrame:
    """Imports of a package of the tree that lead to nothing in it."""
    roots = names.select(F.substring_index("name", ".", 1).alias("root")).distinct()
    lost = local_imports(imports).join(names, F.col("module") == F.col("name"), "left_anti")
    return lost.join(roots, F.substring_index("module", ".", 1) == F.col("root"), "left_semi")


def orphans_compat(files: DataFrame, imports: DataFrame, names: DataFrame, path: str = "dst_rel") -> DataFrame:
    """Python files that import nothing of the tree, are no entry points and no packages."""
    return _loose(files, path).join(resolved(imports, names).select(path).distinct(), path, "left_anti").select(path)


def orphans(files: DataFrame, imports: DataFrame, names: DataFrame, path: str = "dst_rel") -> DataFrame:
    """Python files that no other file imports, are no entry points and no packages."""
    used = resolved(imports, names).select("module").distinct()
    return _loose(files, path).withColumn("module", module(F.col(path))).join(used, "module", "left_anti").select(path)


def _loose(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col(path).endswith(".py") & ~is_entry_point(F.col(path)) & ~F.col(path).endswith("__init__.py"))


def importers(imports: DataFrame, names: DataFrame) -> DataFrame:
    return resolved(imports, names).groupBy("module").agg(F.array_sort(F.collect_set("dst_rel")).alias("files"))
