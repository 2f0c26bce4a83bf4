"""The subpackage."""

