"""Which files there are: by Spark's listing or by git's index, with the same predicates."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karstwell.functions import paths as P

#: Directories that hold no sources of their own.
HEAVY = ("node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build", "target", ".tox", ".mypy_cache", ".pytest_cache")


def light(path: Column, keep: list[str] = ()) -> Column:
    """No directory on the way is a heavy one, unless an include glob names it."""
    named = {part for glob in keep for part in glob.split("/")}
    heavy = [d for d in HEAVY if d not in named]
    return ~F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.array(*[F.lit(d) for d in heavy]))


def selected(path: Column, include: list[str] = (), exclude: list[str] = (), ignore: list[str] = ()) -> Column:
    """The predicate of a discovery: include globs, exclude globs, ignore rules and heavy directories."""
    return P.included(path, list(include)) & ~P.excluded(path, list(exclude)) & ~P.ignored(path, list(ignore)) & light(path, list(include))


def pathspecs(include: list[str]) -> list[str]:
    """What git can select by itself: the globs, with ``**/`` in git's own spelling."""
    return [f":(glob){g}" if "/" in g else f":(glob)**/{g}" for g in include]


def git_listing(spark: SparkSession, root: str, include: list[str] = ()) -> DataFrame:
    """path of tracked files, and of others that git does not ignore; one subprocess on the driver, which gives names only."""
    command = ["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard", "--", *pathspecs(include)]
    found = subprocess.run(command, capture_output=True, check=True).stdout.decode("utf-8", "surrogateescape").split("\0")
    return spark.createDataFrame([(p,) for p in sorted({p for p in found if p})], "path string")


def scan_listing(spark: SparkSession, root: str, include: list[str] = ()) -> DataFrame:
    """path of all files, listed in parallel; contents are not read. Literal directories of the globs are listed alone."""
    root = root.rstrip("/")
    tops = P.include_prefixes(list(include))
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{root}/{t}" for t in tops] or root)
    return df.select(F.substring_index("path", (root if "://" in root else root.split(":", 1)[-1]) + "/", -1).alias("path"))


def discover(spark: SparkSession, root: str, *, backend: str = "auto", include: list[str] = (), exclude: list[str] = (), ignore: list[str] = ()) -> DataFrame:
    """path of the files to index. ``backend``: git, scan, or auto (git where the driver sees a repository)."""
    if backend not in ("auto", "git", "scan"):
        raise ValueError(f"no backend {backend}")
    git = backend == "git" or backend == "auto" and os.path.isdir(os.path.join(root, ".git"))
    listed = git_listing(spark, root, include) if git else scan_listing(spark, root, include)
    return listed.where(selected(F.col("path"), include, exclude, () if git else ignore))
