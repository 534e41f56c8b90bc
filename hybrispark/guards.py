"""Checks of arguments, files, folders and packages, with an error of the package for each."""

from __future__ import annotations

import importlib
import os
import shutil
from types import ModuleType

from pyspark.sql import SparkSession

from hybrispark.errors import InvalidInputError, MissingDependencyError, MissingDirectoryError, MissingInputError, MissingOutputError


def one_of(**given: object) -> str:
    """The name of the only argument that isn't None; an error if there are none or several."""
    named = [name for name, value in given.items() if value is not None]
    if len(named) != 1:
        raise InvalidInputError(f"give exactly one of {', '.join(given)}, not {len(named)}")
    return named[0]


def _found(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names something, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def existing_input(spark: SparkSession, path: str) -> str:
    if not _found(spark, path):
        raise MissingInputError(f"no file {path}")
    return path


def written_output(spark: SparkSession, path: str) -> str:
    if not _found(spark, path):
        raise MissingOutputError(f"{path} wasn't written")
    return path


def folder(spark: SparkSession, path: str, create: bool = False) -> str:
    """A folder that is there, or may be made."""
    if not _found(spark, path):
        if not create:
            raise MissingDirectoryError(f"no folder {path}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return path


def absolute(path: str) -> str:
    """A local path from the root, with ``~`` written out; a path with a scheme as it is."""
    return path if "://" in path else os.path.abspath(os.path.expanduser(path))


def program(name: str) -> str:
    """Where a program lies that is in the search path."""
    place = shutil.which(name)
    if place is None:
        raise MissingDependencyError(f"the program {name} isn't installed")
    return place


def package(name: str) -> ModuleType:
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise MissingDependencyError(f"the package {name} isn't installed") from e
