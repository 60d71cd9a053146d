"""Errors with a code that a caller can act on."""

from __future__ import annotations

#: What can be wrong with data from outside, and with a request.
SOURCE_CODES = ("network", "timeout", "aborted", "rate-limited", "bad-response", "empty-result", "fixture-missing", "bad-tile")
REQUEST_CODES = ("observer-elevation-unknown", "no-terrain", "incomplete-pose", "internal-inconsistency", "aborted")


class CodedError(Exception):
    """An error of one of ``codes``; anything else about it is in ``detail``."""

    codes: tuple[str, ...] = ()

    def __init__(self, code: str, message: str, **detail):
        if code not in self.codes:
            raise ValueError(f"unknown code {code!r}; there are {self.codes}")
        super().__init__(message)
        self.code, self.detail = code, detail


class SourceError(CodedError):
    codes = SOURCE_CODES


class RequestError(CodedError):
    codes = REQUEST_CODES
