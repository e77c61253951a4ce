"""Errors with a status, so that callers need not read messages."""

from __future__ import annotations


class PelagiaError(Exception):
    status = 500

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.message = message
        if status is not None:
            self.status = status


class BadRequest(PelagiaError):
    """A parameter can't be used, or asks for what isn't there."""

    status = 400


class Unavailable(PelagiaError):
    """The store has no days yet."""

    status = 503


class ToolError(PelagiaError):
    """A tool's argument or answer can't be used."""

    status = 422


class NotFound(PelagiaError):
    """A tool found nothing for a valid request."""

    status = 404
