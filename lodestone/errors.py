"""Errors with stable codes, and the process exit codes that they map to."""

from __future__ import annotations

from enum import IntEnum


class ExitCode(IntEnum):
    """Part of the command line's contract."""

    SUCCESS = 0
    INTERNAL = 1
    INVALID_ARGS = 2
    INPUT_NOT_FOUND = 3
    UNSUPPORTED_INPUT = 4
    QUALITY_FAILED = 10
    POLICY_FAILED = 11
    PII_FAILED = 12
    SCHEMA_FAILED = 13
    LINEAGE_INCOMPLETE = 14
    BACKEND_UNAVAILABLE = 20
    AUTH_FAILED = 21
    VERIFICATION_FAILED = 22


class LodestoneError(Exception):
    code, exit_code, label = "internal_error", ExitCode.INTERNAL, "internal error"

    def __init__(self, message: str, remediation: str = "This looks like a bug; please report the command that was run."):
        super().__init__(message)
        self.message, self.remediation = message, remediation

    def __str__(self) -> str:
        return f"{self.label}: {self.message}"

    def to_dict(self) -> dict:
        return {"code": self.code, "exit_code": int(self.exit_code), "message": self.message, "remediation": self.remediation}


class InvalidArgs(LodestoneError):
    code, exit_code, label = "invalid_args", ExitCode.INVALID_ARGS, "invalid arguments"


class InputNotFound(LodestoneError):
    code, exit_code, label = "input_not_found", ExitCode.INPUT_NOT_FOUND, "input not found"


class UnsupportedInput(LodestoneError):
    code, exit_code, label = "unsupported_input", ExitCode.UNSUPPORTED_INPUT, "unsupported input"
