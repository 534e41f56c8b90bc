"""Errors of the package, by what went wrong."""

from __future__ import annotations


class ProbeDesignError(Exception):
    """Base of all errors of the package."""


class MissingDependencyError(ProbeDesignError):
    """An optional package or program isn't installed."""


class MissingInputError(ProbeDesignError):
    """An input file or table isn't there."""


class MissingOutputError(ProbeDesignError):
    """A step ended without the output it should have written."""


class MissingDirectoryError(ProbeDesignError):
    """A folder isn't there and may not be made."""


class InvalidInputError(ProbeDesignError):
    """Arguments or data that an operator can't work on."""


class ConfigurationError(ProbeDesignError):
    """Settings that contradict each other or name nothing known."""


class PipelineStateError(ProbeDesignError):
    """A step was asked for before the step it builds on."""


class ReferenceIndexError(ProbeDesignError):
    """An index table is missing, or was built with other parameters."""


class EmptyExportError(ProbeDesignError):
    """Nothing to write where an empty file would mislead."""
